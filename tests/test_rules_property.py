"""Set-based rules against a sequential row-by-row simulation of the triggers."""

import calendar
import datetime as dt
import random
from collections import defaultdict

import pytest

from cadenza.operators import rules, scan

AS_OF = dt.date(2024, 6, 1)
MIDNIGHT = dt.datetime(2024, 6, 1)


def _plus_months(ts, n):
    m = ts.month - 1 + n
    y, m = ts.year + m // 12, m % 12 + 1
    return ts.replace(year=y, month=m, day=min(ts.day, calendar.monthrange(y, m)[1]))


def _rentals(rnd, n, n_students=4, n_instr=4):
    rows = []
    for seq in range(n):
        start = dt.datetime(2023, rnd.choice([1, 3, 5]), rnd.choice([1, 15, 31 if rnd.random() < 0.2 else 28]),
                            rnd.choice([0, 10]))
        expiry = _plus_months(start, rnd.choice([6, 12, 13])) if rnd.random() < 0.9 else start
        if rnd.random() < 0.1:
            expiry = _plus_months(start, 12)     # equality passes
        student = 0 if rnd.random() < 0.4 else rnd.randrange(n_students)
        instr = 0 if rnd.random() < 0.4 else rnd.randrange(n_instr + 1)   # n_instr = unknown instrument
        rows.append((seq, student, instr, start, expiry))
    rnd.shuffle(rows)
    return rows


SCHEMA = "seq int, student_id int, instrument_id int, rental_start_time timestamp_ntz, lease_expiry_time timestamp_ntz"


def _frames(spark, rnd, n):
    rows = _rentals(rnd, n)
    stock = {i: rnd.randrange(0, 4) for i in range(4)}
    inst = spark.createDataFrame(list(stock.items()), "instrument_id int, available_stock int")
    existing = [(1000 + k, rnd.randrange(4), 0, dt.datetime(2023, 1, 1), dt.datetime(2024, rnd.choice([5, 7]), 1))
                for k in range(rnd.randrange(3))]
    ex = spark.createDataFrame(existing, SCHEMA)
    return rows, stock, existing, inst, ex, spark.createDataFrame(rows, SCHEMA)


def _existing_active(existing):
    c = defaultdict(int)
    for _s, stu, _i, _st, exp in existing:
        if exp >= MIDNIGHT:
            c[stu] += 1
    return c


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_active_limit_and_stock_match_sequential(spark, seed):
    rnd = random.Random(seed)
    rows, stock, existing, inst, ex, batch = _frames(spark, rnd, 120)
    limit = rnd.choice([0, 1, 2])
    active = _existing_active(existing)
    exp_active = {}
    for seq, stu, _i, _st, exp in sorted(rows):
        ok = active[stu] < limit
        exp_active[seq] = ok
        if ok and exp >= MIDNIGHT:
            active[stu] += 1
    got = {r.seq: r.accepted for r in rules.active_rental_limit(ex, batch, ["seq"], AS_OF, limit).collect()}
    assert got == exp_active

    left = dict(stock)
    exp_stock = {}
    for seq, _stu, ins, _st, _e in sorted(rows):
        ok = left.get(ins, 0) > 0
        exp_stock[seq] = ok
        if ok:
            left[ins] -= 1
    got = {r.seq: r.accepted for r in rules.stock_admission(batch, inst, ["seq"]).collect()}
    assert got == exp_stock


def _sequential_admission(rows, stock, existing, limit, months):
    active = _existing_active(existing)
    left = dict(stock)
    out = {}
    for seq, stu, ins, st, exp in sorted(rows):
        if active[stu] >= limit:
            out[seq] = "active_rentals"
        elif left.get(ins, 0) <= 0:
            out[seq] = "out_of_stock"
        elif exp > _plus_months(st, months):
            out[seq] = "duration"
        else:
            out[seq] = None
            left[ins] -= 1
            if exp >= MIDNIGHT:
                active[stu] += 1
    return out


@pytest.mark.parametrize("seed", [4, 5, 15, 16])
def test_rental_admission_row_matches_sequential(spark, seed):
    rnd = random.Random(seed)
    rows, stock, existing, inst, ex, batch = _frames(spark, rnd, 80)
    exp = _sequential_admission(rows, stock, existing, 2, 12)
    got = rules.rental_admission_row(batch, inst, ["seq"], existing=ex, as_of=AS_OF, limit=2, max_months=12)
    assert {r.seq: r.reason for r in got.collect()} == exp


def test_rental_admission_row_null_student_and_empty_batch(spark):
    start, expiry = dt.datetime(2024, 1, 1), dt.datetime(2024, 7, 1)
    rows = [(0, None, 9, start, expiry), (1, None, 1, start, expiry), (2, None, 1, start, expiry)]
    inst = spark.createDataFrame([(9, 0), (1, 5)], "instrument_id int, available_stock int")
    got = rules.rental_admission_row(spark.createDataFrame(rows, SCHEMA), inst, ["seq"], as_of=AS_OF, limit=2)
    assert {r.seq: r.reason for r in got.collect()} == {0: "out_of_stock", 1: None, 2: None}
    none = rules.rental_admission_row(spark.createDataFrame([], SCHEMA), inst, ["seq"], as_of=AS_OF, limit=2)
    assert none.count() == 0


@pytest.mark.parametrize("seed", [4, 15])
def test_rental_admission_row_splits_keys_of_many_rows(spark, monkeypatch, seed):
    monkeypatch.setattr(scan, "HOT_ROWS", 9)
    rnd = random.Random(seed)
    rows, stock, existing, inst, ex, batch = _frames(spark, rnd, 80)
    got = rules.rental_admission_row(batch, inst, ["seq"], existing=ex, as_of=AS_OF, limit=2, max_months=12)
    assert {r.seq: r.reason for r in got.collect()} == _sequential_admission(rows, stock, existing, 2, 12)


def test_rental_admission_row_reads_the_reasons_from_ends(spark):
    """No running count over all rows is left: one join a side, and one shuffle of the rows for both parts of the result."""
    rows, stock, existing, inst, ex, batch = _frames(spark, random.Random(4), 80)
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        got = rules.rental_admission_row(batch, inst, ["seq"], existing=ex, as_of=AS_OF, limit=2, max_months=12)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {r.seq: r.reason for r in got.collect()} == _sequential_admission(rows, stock, existing, 2, 12)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Window" not in plan and "ReusedExchange" in plan


@pytest.mark.parametrize("spare", [0, 1])
def test_rental_admission_row_of_an_instrument_with_as_much_stock_as_rows(spark, spare):
    """A late row of a fully rented instrument is out of stock, not too long; a student's inactive rows count on the instrument."""
    start = dt.datetime(2023, 1, 1)
    rows = [(0, 1, 1, start, _plus_months(start, 6)), (1, 2, 1, start, _plus_months(start, 6)), (2, 3, 1, start, _plus_months(start, 20))]
    inst = spark.createDataFrame([(1, 2 + spare)], "instrument_id int, available_stock int")
    got = rules.rental_admission_row(spark.createDataFrame(rows, SCHEMA), inst, ["seq"], as_of=AS_OF, limit=1)
    assert {r.seq: r.reason for r in got.collect()} == {0: None, 1: None, 2: "duration" if spare else "out_of_stock"}


def _chain(n):
    """Row k shares its student with row k-1 or its instrument, in turn: each waits for the one before."""
    start, expiry = dt.datetime(2024, 1, 1), dt.datetime(2024, 7, 1)
    return [(k, (k + 1) // 2, k // 2, start, expiry) for k in range(n)], {i: 1 for i in range(n)}


@pytest.mark.parametrize("n,rounds", [(10, 3), (500, 3)])
def test_rental_admission_row_follows_a_chain(spark, caplog, n, rounds):
    rows, stock = _chain(n)
    inst = spark.createDataFrame(list(stock.items()), "instrument_id int, available_stock int")
    with caplog.at_level("INFO", logger="cadenza.operators.rules"):
        got = rules.rental_admission_row(spark.createDataFrame(rows, SCHEMA), inst, ["seq"], as_of=AS_OF, limit=1)
    assert {r.seq: r.reason for r in got.collect()} == _sequential_admission(rows, stock, [], 1, 12)
    n_open = [r.args[0] for r in caplog.records if "rows open" in str(r.msg)]
    assert n_open == sorted(n_open, reverse=True) and n_open[-1] == 0 and len(n_open) <= rounds


@pytest.mark.parametrize("seed", [31, 32, 33])
def test_rental_admission_row_long_dependencies(spark, seed):
    """Small stocks and limits over few shared keys: rows wait for one another in long and branching chains."""
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, max(0, k // 3 + rnd.randrange(-1, 2)), max(0, k // 2 + rnd.randrange(-1, 2)), start,
             _plus_months(start, rnd.choice([3, 6, 6, 12, 13]))) for k in range(300)]
    stock = {i: rnd.choice([0, 1, 1, 2]) for i in range(160)}
    limit = rnd.choice([1, 2])
    inst = spark.createDataFrame(list(stock.items()), "instrument_id int, available_stock int")
    got = rules.rental_admission_row(spark.createDataFrame(rows, SCHEMA), inst, ["seq"], as_of=AS_OF, limit=limit)
    assert {r.seq: r.reason for r in got.collect()} == _sequential_admission(rows, stock, [], limit, 12)


@pytest.mark.parametrize("seed", [6, 7])
def test_rental_admission_statement_matches_sequential_abort(spark, seed):
    rnd = random.Random(seed)
    rows, stock, existing, inst, ex, _batch = _frames(spark, rnd, 90)
    rows = [r + (r[0] % 3,) for r in rows]
    batch = spark.createDataFrame(rows, SCHEMA + ", stmt int")
    expected = {}
    for s in range(3):
        part = [r[:5] for r in rows if r[5] == s]
        # all-or-nothing: the statement's first failure, computed as if every earlier row went in
        active = _existing_active(existing)
        left = dict(stock)
        first = None
        for seq, stu, ins, st, e in sorted(part):
            reason = ("active_rentals" if active[stu] >= 2 else "out_of_stock" if left.get(ins, 0) <= 0
                      else "duration" if e > _plus_months(st, 12) else None)
            if reason:
                first = (seq, reason)
                break
            left[ins] -= 1
            if e >= MIDNIGHT:
                active[stu] += 1
        expected[s] = first
    got = rules.rental_admission_statement(batch, inst, ["seq"], "stmt", existing=ex, as_of=AS_OF, limit=2,
                                           max_months=12)
    assert {r.stmt: (None if r.accepted else (r.failed_seq, r.reason)) for r in got.collect()} == expected


@pytest.mark.parametrize("seed", [8, 9, 10])
def test_capacity_matches_sequential(spark, seed):
    rnd = random.Random(seed)
    types = {0: ("group", 3), 1: ("ensemble", 2), 2: ("individual", 1), 3: (None, None)}
    existing = [(rnd.randrange(4), rnd.randrange(5)) for _ in range(3)]
    existing = sorted(set(existing))
    batch = [(seq, 0 if rnd.random() < 0.5 else rnd.randrange(4), rnd.randrange(5)) for seq in range(100)]
    rnd.shuffle(batch)
    target = set(existing)
    counts = defaultdict(int)
    for les, _s in existing:
        counts[les] += 1
    exp = {}
    for seq, les, stu in sorted(batch):
        kind, cap = types[les]
        if kind is None:
            exp[seq] = "no_type"
        elif counts[les] + 1 > cap:
            exp[seq] = "full"
        elif (les, stu) in target:
            exp[seq] = "duplicate"
        else:
            exp[seq] = None
            target.add((les, stu))
            counts[les] += 1
    g = spark.createDataFrame([(0, 3, 1)], "lesson_id int, max_students int, min_students int")
    e = spark.createDataFrame([(1, 2)], "lesson_id int, max_students int")
    i = spark.createDataFrame([(2, "10:00:00")], "lesson_id int, time_slot string")
    ex = spark.createDataFrame(existing, "lesson_id int, student_id int")
    b = spark.createDataFrame(batch, "seq int, lesson_id int, student_id int")
    got = {r.seq: r.reason for r in rules.lesson_capacity(ex, b, i, g, e, ["seq"]).collect()}
    assert got == exp


def _sequential_price(existing, batch, statement_of):
    """Queue semantics: row mode fires after each row; statement mode after the statement, in order."""
    flags = dict(existing)          # id -> (instrument, is_current)
    by_stmt = defaultdict(list)
    for row in sorted(batch):
        by_stmt[statement_of(row)].append(row)
    for s in sorted(by_stmt):
        rows = by_stmt[s]
        for seq, ins, cur in rows:
            flags[("n", seq)] = (ins, cur)
        for seq, ins, cur in rows:          # AFTER ROW triggers, in row order, NEW as inserted
            if cur:
                for k, (i2, c2) in list(flags.items()):
                    if i2 == ins and k != ("n", seq) and c2:
                        flags[k] = (i2, False)
    return flags


@pytest.mark.parametrize("seed,mode", [(11, "row"), (12, "row"), (13, "stmt"), (14, "stmt")])
def test_price_currency_matches_trigger_queue(spark, seed, mode):
    rnd = random.Random(seed)
    existing = {("e", k): (k % 3, rnd.random() < 0.7) for k in range(6)}
    batch = [(seq, rnd.randrange(4), rnd.random() < 0.5) for seq in range(40)]
    stmt_of = (lambda r: r[0]) if mode == "row" else (lambda r: r[0] // 7)
    exp = _sequential_price(existing, batch, stmt_of)
    ex = spark.createDataFrame([(k[1], v[0], v[1]) for k, v in existing.items()],
                               "price_id int, instrument_id int, is_current boolean")
    b = spark.createDataFrame([(s, i, c, stmt_of((s, i, c))) for s, i, c in batch],
                              "seq int, instrument_id int, is_current boolean, stmt int")
    got = rules.current_price_flags(ex, b, ["seq"], statement=None if mode == "row" else "stmt").collect()
    flags = {(("e", r.price_id) if r.source == "existing" else ("n", r.seq)): r.is_current for r in got}
    assert flags == {k: v[1] for k, v in exp.items()}
