"""Statements in sequence, UPDATE statements, bounded lesson capacity, ids around given ones, the audit of all rules."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.operators import audit, denorm, integrity, rules, scan, statements
from cadenza.sources.schemas import DOMAIN_FOREIGN_KEYS, DOMAIN_RULES, SCHEMAS, columns_of
from cadenza.staging import Stages
from tests.test_rules_property import AS_OF, MIDNIGHT, SCHEMA, _existing_active, _frames, _plus_months


def _judge(active, left, student, instrument, start, expiry, limit, months):
    if active[student] >= limit:
        return "active_rentals"
    if left.get(instrument, 0) <= 0:
        return "out_of_stock"
    return "duration" if expiry > _plus_months(start, months) else None


@pytest.mark.parametrize("seed,size", [(41, 3), (42, 2), (43, 6)])
def test_statements_in_sequence_match_a_sequential_run(spark, seed, size):
    _statements_match(spark, seed, size)


@pytest.mark.parametrize("seed,size", [(41, 3), (43, 6)])
def test_statements_in_sequence_split_keys_of_many_rows(spark, monkeypatch, seed, size):
    monkeypatch.setattr(scan, "HOT_ROWS", 9)
    _statements_match(spark, seed, size)


def test_rounds_of_statements_carry_no_order_columns(spark, monkeypatch):
    """Beside the key columns the tables of the rounds hold counts alone."""
    written, keep = [], Stages.keep

    def noted(self, df):
        written.append(set(df.columns))
        return keep(self, df)

    monkeypatch.setattr(Stages, "keep", noted)
    _statements_match(spark, 42, 2)
    rounds = [c for c in written if {"_fails", "_sure"} <= c]
    assert rounds and not any("seq" in c for c in rounds)


@pytest.mark.parametrize("seed,size,hot", [(41, 3, 1 << 18), (42, 2, 9), (43, 6, 4)])
def test_statements_in_sequence_by_rounds_alone(spark, monkeypatch, seed, size, hot):
    """Without the last step in order; keys of over 9 rows split, and statements of over 4."""
    monkeypatch.setattr(statements, "TAIL_ROWS", 0)
    monkeypatch.setattr(scan, "HOT_ROWS", hot)
    _statements_match(spark, seed, size)


def _rounds(monkeypatch):
    """The tables of the rounds, as number of rows, noted as they are written."""
    written, keep = [], Stages.keep

    def noted(self, df):
        out = keep(self, df)
        if {"_fails", "_sure"} <= set(df.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(Stages, "keep", noted)
    return written


def _rentals_of(spark, rows):
    """(stmt, seq, student, instrument) as rentals that pass the duration rule and are active."""
    return spark.createDataFrame([(seq, stu, ins, dt.datetime(2024, 1, 1), dt.datetime(2024, 9, 1), stmt) for stmt, seq, stu, ins in rows],
                                 SCHEMA + ", stmt int")


def test_a_chain_of_statements_takes_few_rounds(spark, monkeypatch):
    """Statement k rents instruments k and k + 1, of which there is one each, so each waits for the one before it."""
    rounds, n = _rounds(monkeypatch), 14
    batch = _rentals_of(spark, [(k, 2 * k + d, k, k + d) for k in range(n) for d in (0, 1)])
    inst = spark.createDataFrame([(k, 1) for k in range(n + 1)], "instrument_id int, available_stock int")
    got = statements.admit_statements(batch, inst, ["seq"], "stmt", as_of=AS_OF)
    assert {r.stmt: r.accepted for r in got.collect()} == {k: k % 2 == 0 for k in range(n)}
    assert len(rounds) <= 3


def test_rounds_hold_claims_on_short_keys_alone(spark, monkeypatch):
    """One row per statement and student of too many active rentals; instruments with stock for all leave at once."""
    rounds = _rounds(monkeypatch)
    batch = _rentals_of(spark, [(k, 5 * k + d, k % 2, d) for k in range(12) for d in range(5)])
    inst = spark.createDataFrame([(k, 1000) for k in range(5)], "instrument_id int, available_stock int")
    got = statements.admit_statements(batch, inst, ["seq"], "stmt", as_of=AS_OF, limit=12)
    assert {r.stmt: (r.accepted, r.reason, r.failed_seq) for r in got.collect()} == {
        k: (True, None, None) if k < 4 else (False, "active_rentals", 5 * k + 2) for k in range(12)}
    assert rounds[0] == 12 and sum(rounds) <= 24


def test_statements_of_repeated_instruments_and_order_keys(spark):
    """Every row of an instrument judges the rentals; of rows that share an order key the first reason by name counts."""
    inst = spark.createDataFrame([(1, 5), (1, 5), (2, 9)], "instrument_id int, available_stock int")
    got = statements.admit_statements(_rentals_of(spark, [(k, k, k, 1) for k in range(4)]), inst, ["seq"], "stmt", as_of=AS_OF)
    assert {r.stmt: (r.n_rows, r.reason) for r in got.collect()} == {0: (2, None), 1: (2, None), 2: (2, "out_of_stock"), 3: (2, "out_of_stock")}
    late = _rentals_of(spark, [(0, 1, 2, 2)]).withColumn("lease_expiry_time", F.col("lease_expiry_time") + F.expr("make_ym_interval(5)"))
    got = statements.admit_statements(_rentals_of(spark, [(0, 1, 1, 7)]).unionByName(late), inst.distinct(), ["seq"], "stmt", as_of=AS_OF)
    assert [tuple(r) for r in got.collect()] == [(0, 2, False, "duration", 1)]


@pytest.mark.parametrize("slots", [1, 16])
def test_hot_keys_are_those_of_too_many_rows(spark, monkeypatch, slots):
    monkeypatch.setattr(scan, "HOT_ROWS", 9)
    monkeypatch.setattr(scan, "HOT_SLOTS", slots)
    rows = [(k, None if k % 5 else 1) for k in (0, 1, 2, 2, 2) for _ in range(4)] + [(None, 1)] * 10
    df = spark.createDataFrame(rows, "a int, b int")
    assert sorted(map(str, scan.hot_keys(df, ["a", "b"]).collect())) == ["Row(_h_a=2, _h_b=None)", "Row(_h_a=None, _h_b=1)"]
    assert scan.hot_keys(df.filter("a < 2"), ["a", "b"]) is None


def _statements_match(spark, seed, size):
    rnd = random.Random(seed)
    rows, stock, existing, inst, ex, _b = _frames(spark, rnd, 120)
    stock = {i: n + 6 for i, n in stock.items()}
    inst = spark.createDataFrame(list(stock.items()), "instrument_id int, available_stock int")
    rows = [(seq, rnd.randrange(25) if rnd.random() < .7 else 0, ins, st, e) for seq, _s, ins, st, e in rows]
    rows = [r + ((r[0] * 7 % 120) // size,) for r in rows]              # statements whose rows lie apart in seq
    by = defaultdict(list)
    for r in sorted(rows):
        by[r[5]].append(r)
    active, left, want = _existing_active(existing), dict(stock), {}
    for s in sorted(by):
        a, le, failed = dict(active), dict(left), None
        a = defaultdict(int, a)
        for seq, stu, ins, st, e, _s in by[s]:
            why = _judge(a, le, stu, ins, st, e, 3, 12)
            if why:
                failed = (seq, why)
                break
            le[ins] -= 1
            a[stu] += e >= MIDNIGHT
        want[s] = (len(by[s]), failed)
        if failed is None:
            active, left = a, le
    got = statements.admit_statements(spark.createDataFrame(rows, SCHEMA + ", stmt int"), inst, ["seq"], "stmt", ex, AS_OF, 3, 12)
    assert {r.stmt: (r.n_rows, None if r.accepted else (r.failed_seq, r.reason)) for r in got.collect()} == want
    assert {w[1] is None for w in want.values()} == {True, False}


def test_statements_in_sequence_of_an_empty_batch(spark):
    inst = spark.createDataFrame([(0, 1)], "instrument_id int, available_stock int")
    assert statements.admit_statements(spark.createDataFrame([], SCHEMA + ", stmt int"), inst, ["seq"], "stmt").count() == 0


@pytest.mark.parametrize("seed,exclude_self", [(51, False), (51, True), (52, False), (52, True)])
def test_update_statements_match_a_sequential_run(spark, seed, exclude_self):
    rnd = random.Random(seed)

    def version(rid):
        start = dt.datetime(2023, rnd.choice([1, 6, 9]), 1)
        return (rid, rnd.choice([None, 0, 0, 0, 1, 2, 3]), start, _plus_months(start, rnd.choice([6, 9, 12, 13, 18])))

    existing = [version(k) for k in range(40)]
    updates = []
    for stmt in range(12):
        updates += [(*version(k), stmt, rnd.random()) for k in rnd.sample(range(44), 6)]        # some of unknown rentals
    schema = "rental_id int, student_id int, rental_start_time timestamp_ntz, lease_expiry_time timestamp_ntz"
    limit, want = 9, {}
    for stmt in range(12):
        table, failed, n = {r[0]: r[1:] for r in existing}, None, 0
        for rid, stu, st, e, _s, pos in sorted((u for u in updates if u[4] == stmt), key=lambda u: u[5]):
            if rid not in table:
                continue
            n += 1
            has = sum(1 for k, (s2, _st2, e2) in table.items()
                      if s2 is not None and s2 == stu and e2 >= MIDNIGHT and not (exclude_self and k == rid))
            why = "active_rentals" if has >= limit else "duration" if e > _plus_months(st, 12) else None
            if why and failed is None:
                failed = (pos, why)
            table[rid] = (stu, st, e)
        want[stmt] = (n, failed)
    got = statements.rental_update_statements(
        spark.createDataFrame(existing, schema), spark.createDataFrame(updates, schema + ", stmt int, pos double"), ["pos"], "stmt",
        AS_OF, limit, 12, exclude_self)
    assert {r.stmt: (r.n_rows, None if r.accepted else (r.failed_pos, r.reason)) for r in got.collect()} == want
    assert {w[1] and w[1][1] for w in want.values()} >= {"active_rentals", "duration"}


def test_capacity_of_a_crowded_lesson(spark):
    """One lesson has 40 % of the rows; no task needs more of it than its seats, and no prefix count is planned."""
    rnd = random.Random(61)
    batch = [(seq, 0 if rnd.random() < .4 else rnd.randrange(1, 60), rnd.randrange(300)) for seq in range(4000)]
    existing = [(0, 5), (1, 5), (2, 7)]
    caps = {k: 2 + k % 9 for k in range(50)}
    seats, seen, want = defaultdict(int), set(existing), {}
    for les, _s in existing:
        seats[les] += 1
    for seq, les, stu in sorted(batch):
        why = ("no_type" if les not in caps else "full" if seats[les] + 1 > caps[les] else
               "duplicate" if (les, stu) in seen else None)
        want[seq] = why
        if why is None:
            seats[les] += 1
            seen.add((les, stu))
    group = spark.createDataFrame([(k, c, 1) for k, c in caps.items()], "lesson_id int, max_students int, min_students int")
    none = spark.createDataFrame([], "lesson_id int, max_students int")
    out = rules.lesson_capacity(spark.createDataFrame(existing, "lesson_id int, student_id int"),
                                spark.createDataFrame(batch, "seq int, lesson_id int, student_id int"),
                                none.select("lesson_id"), group, none, ["seq"])
    assert {r.seq: r.reason for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "_scan_" not in plan


def test_payment_with_two_rentals_fails(spark):
    payment = spark.createDataFrame([("P1", "R1"), ("P2", None)], "payment_id string, rental_id string")
    day = dt.datetime(2024, 1, 1)
    rental = spark.createDataFrame([("R1", "I1", day, day), ("R1", "I2", day, day)],
                                   "rental_id string, instrument_id string, rental_start_time timestamp_ntz, lease_expiry_time timestamp_ntz")
    inst = spark.createDataFrame([("I1", "piano")], "instrument_id string, instrument_type string")
    with pytest.raises(Exception, match="more than one rental"):
        denorm.payment_denorm(payment, rental, inst).collect()
    one = denorm.payment_denorm(payment, rental.limit(1), inst).collect()
    assert {(r.payment_id, r.rental_duration) for r in one} == {("P1", 0), ("P2", None)}


@pytest.mark.parametrize("seed", [71, 72])
def test_missing_ids_fill_the_gaps(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice([None, None, rnd.randrange(-2, 90)])) for k in range(80)]
    got = integrity.assign_missing_ids(spark.createDataFrame(rows, "k int, id int"), ["k"], "id", start_after=5).collect()
    held = [i for _k, i in rows if i is not None]
    free = iter(n for n in range(6, 1000) if n not in held)
    want = sorted((k, next(free) if i is None else i, i is not None and held.count(i) > 1) for k, i in rows)
    assert sorted(map(tuple, got)) == want
    assert integrity.assign_missing_ids(spark.createDataFrame([], "k int, id int"), ["k"], "id").count() == 0


def test_registry_covers_every_table_and_the_fixtures_pass(fx, spark):
    assert set(DOMAIN_RULES) == set(SCHEMAS) and len(DOMAIN_RULES) == 25
    for t, r in DOMAIN_RULES.items():
        named = {*r.primary_key, *r.unique, *r.not_null, *r.length, *r.domain}
        assert named <= set(columns_of(t)), t
    out = audit.audit(fx, DOMAIN_RULES, DOMAIN_FOREIGN_KEYS).collect()         # foreign keys to tables not given are left out
    assert [tuple(r) for r in out if r.n_rows] == [] and len(out) > 100
    out = audit.audit({t: spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS}, DOMAIN_RULES, DOMAIN_FOREIGN_KEYS).collect()
    assert sum(r.kind == "foreign_key" for r in out) == 29 and sum(r.kind == "primary_key" for r in out) == 25


def test_audit_counts_every_kind_of_broken_row(spark):
    tables = {
        "person": spark.createDataFrame([(1, "1" * 12, "A", "B"), (1, "2" * 13, None, "B"), (None, "1" * 12, "C", "D"), (4, None, "E", "F")],
                                        SCHEMAS["person"]),
        "student": spark.createDataFrame([(1, 1, None), (2, 9, None), (3, 9, None), (4, None, None)], SCHEMAS["student"]),
        "sibling": spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 23), (11, 23)], SCHEMAS["sibling"]),
        "lesson": spark.createDataFrame([("L1", dt.date(2024, 1, 1), "01:00:00", None, "expert", None, 1)], SCHEMAS["lesson"]),
    }
    out = audit.audit(tables, DOMAIN_RULES, DOMAIN_FOREIGN_KEYS)
    got = {(r.table_name, r.kind, r.rule): r.n_rows for r in out.collect()}
    assert {k: n for k, n in got.items() if n} == {
        ("person", "primary_key", "person_id"): 2, ("person", "unique", "person_number"): 2,
        ("person", "not_null", "person_id"): 1, ("person", "not_null", "first_name"): 1, ("person", "not_null", "person_number"): 1,
        ("person", "length", "person_number <= 12"): 1, ("student", "not_null", "person_id"): 1,
        ("student", "foreign_key", "person_id -> person(person_id)"): 2,
        ("sibling", "check", "student_id <> sibling_id"): 1, ("sibling", "primary_key", "student_id, sibling_id"): 2,
        ("sibling", "foreign_key", "student_id -> student(student_id)"): 1,
        ("sibling", "foreign_key", "sibling_id -> student(student_id)"): 2, ("lesson", "enum", "difficulty_level"): 1}
    assert ("student", "foreign_key", "instructor_id -> instructor(instructor_id)") not in got


def test_audit_reads_each_table_once(spark, tmp_path):
    for t, rows in (("person", [(1, "1" * 12, "A", "B")]), ("student", [(1, 1, "x")]), ("sibling", [(1, 1)])):
        spark.createDataFrame(rows, SCHEMAS[t]).write.parquet(str(tmp_path / t))
    tables = {t: spark.read.parquet(str(tmp_path / t)) for t in ("person", "student", "sibling")}
    plan = audit.audit(tables, DOMAIN_RULES, DOMAIN_FOREIGN_KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 3
    assert audit.audit(tables, DOMAIN_RULES, DOMAIN_FOREIGN_KEYS).agg(F.sum("n_rows")).first()[0] == 1
