"""Views, UPDATE-event checks, boundaries of the rules, the combined admission entry point."""

import datetime as dt

from cadenza.operators import denorm, rules
from cadenza.plans.views import register_views
from cadenza.sources.schemas import SCHEMAS

SCHEMA = "seq int, student_id int, instrument_id int, rental_start_time timestamp_ntz, lease_expiry_time timestamp_ntz"


def test_report_views_answer_sql(fx, spark):
    register_views({k: v for k, v in fx.items()}, year=2023, as_of=dt.date(2024, 12, 1))
    got = [tuple(r) for r in spark.sql('SELECT * FROM MonthlyLessonSummary ORDER BY Month_Num').collect()]
    assert got == [("Nov", 11, 6, 3, 2, 1), ("Dec", 12, 3, 1, 2, 0)]
    hist = spark.sql("SELECT count(student_id) AS n, sibling_count FROM StudentSiblingSummary "
                     "GROUP BY sibling_count ORDER BY sibling_count").collect()
    assert [tuple(r) for r in hist] == [(16, 0), (4, 1), (3, 2)]
    assert spark.sql("SELECT * FROM EnsemblesNextWeekSummary").count() == 5


def test_update_counts_the_row_itself(fx, spark):
    # student 1 has R001 active at 2023-12-01; with limit 1 any update of R001 fails unless self is excluded
    upd = spark.createDataFrame([("R001", dt.datetime(2023, 11, 20, 10), dt.datetime(2023, 12, 30, 10), "RP001",
                                  "INSTR001", 1)], SCHEMAS["instrument_rental"])
    faithful = rules.rental_update_check(fx["instrument_rental"], upd, dt.date(2023, 12, 1), limit=1).first()
    relaxed = rules.rental_update_check(fx["instrument_rental"], upd, dt.date(2023, 12, 1), limit=1,
                                        exclude_self=True).first()
    assert (faithful.accepted, faithful.reason) == (False, "active_rentals")
    assert (relaxed.accepted, relaxed.reason) == (True, None)
    long = upd.withColumn("lease_expiry_time", upd.rental_start_time + dt.timedelta(days=400))
    assert rules.rental_update_check(fx["instrument_rental"], long, dt.date(2023, 12, 1), limit=5).first().reason \
        == "duration"


def test_expiry_at_midnight_of_as_of_is_active(spark):
    inst = spark.createDataFrame([(0, 10)], "instrument_id int, available_stock int")
    # a lease ending 23:59 the day before is not active, one ending at midnight of as_of is
    rows = [(0, 7, 0, dt.datetime(2024, 1, 1), dt.datetime(2024, 5, 31, 23, 59)),
            (1, 7, 0, dt.datetime(2024, 1, 2), dt.datetime(2024, 6, 1, 0, 0)),
            (2, 7, 0, dt.datetime(2024, 1, 3), dt.datetime(2024, 6, 2))]
    got = rules.admit_rentals(spark.createDataFrame(rows, SCHEMA), inst, ["seq"], as_of=dt.date(2024, 6, 1),
                              limit=1)
    assert {r.seq: r.reason for r in got.collect()} == {0: None, 1: None, 2: "active_rentals"}
    stmt = rules.admit_rentals(spark.createDataFrame(rows, SCHEMA), inst, ["seq"], as_of=dt.date(2024, 6, 1),
                               limit=1, mode="statement").first()
    assert (stmt.accepted, stmt.reason, stmt.failed_seq) == (False, "active_rentals", 2)


def test_empty_batches(fx, spark):
    empty = spark.createDataFrame([], SCHEMA)
    inst = spark.createDataFrame([(0, 1)], "instrument_id int, available_stock int")
    assert rules.admit_rentals(empty, inst, ["seq"], as_of=dt.date(2024, 1, 1)).count() == 0
    assert rules.stock_admission(empty, inst, ["seq"]).count() == 0
    assert denorm.lesson_history_report(denorm.lesson_history(
        fx["lesson"], fx["individual_lesson"], fx["group_lesson"], fx["ensembles_lesson"],
        fx["student_lessons"].limit(0), fx["student"], fx["person"], fx["person_email"], fx["email"],
        fx["lesson_price_history"])).count() == 0


def test_active_edge_ignores_time_zones(spark, monkeypatch):
    """The first instant of the day is active and the last of the day before is not, whatever zone the driver is in."""
    import datetime as dt
    import time

    from cadenza.operators import rules
    rows = [(1, dt.datetime(2024, 5, 31, 23, 0)), (2, dt.datetime(2024, 6, 1, 0, 0)), (3, dt.datetime(2024, 6, 1, 3, 0))]
    ntz = spark.createDataFrame([(i, t.isoformat()) for i, t in rows], "student_id long, t string").selectExpr(
        "student_id", "cast(t as timestamp_ntz) lease_expiry_time")
    for zone in ("Europe/Stockholm", "America/New_York"):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
        got = {r["student_id"] for r in rules.active_counts(ntz, dt.date(2024, 6, 1)).collect()}
        assert got == {2, 3}
    monkeypatch.undo()
    time.tzset()


def test_unique_lets_nulls_pass_and_stock_may_be_negative(spark):
    from cadenza.operators import integrity, rules
    df = spark.createDataFrame([(None,), (None,), (1,), (1,)], "k int")
    assert [r["k"] for r in integrity.key_violations(df, ["k"], nulls_pass=True).collect()] == [1]
    assert integrity.key_violations(df, ["k"]).count() == 2
    stock = spark.createDataFrame([(1, -3)], "instrument_id long, available_stock int")
    none = spark.createDataFrame([], "instrument_id long, accepted boolean")
    assert rules.stock_after(stock, none).first()["stock_after"] == -3


def test_price_updates_equal_a_sequential_run(spark):
    import random
    rng = random.Random(5)
    prices, updates, want = [], [], {}
    for i in range(200):                       # an instrument each
        ids = [10 * i + k for k in range(rng.randint(1, 4))]
        flags = {p: rng.random() < 0.5 for p in ids}
        prices += [(p, i, f) for p, f in flags.items()]
        for _ in range(rng.randint(0, 6)):
            p, new = rng.choice(ids), rng.random() < 0.6
            updates.append((len(updates), p, new))
            if new and not flags[p]:
                flags = dict.fromkeys(ids, False)
            flags[p] = new
        want |= flags
    got = rules.current_price_updates(
        spark.createDataFrame(prices, "rental_price_id long, instrument_id long, is_current boolean"),
        spark.createDataFrame(updates, "seq long, rental_price_id long, is_current boolean"), ["seq"]).collect()
    assert {r["rental_price_id"]: r["is_current"] for r in got} == want


def test_active_limit_equals_a_sequential_run(spark):
    import random
    rng = random.Random(9)
    day, old, new = dt.date(2024, 6, 1), dt.datetime(2024, 5, 1), dt.datetime(2024, 7, 1)
    start = dt.datetime(2024, 1, 1)

    def rentals(n, first):
        return [(first + i, rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), 0, start, rng.choice([old, new])) for i in range(n)]
    existing, batch = rentals(8, 0), rentals(40, 100)
    for limit in (0, 1, 3):
        have = {}
        for _, student, _, _, end in existing:
            if student is not None and end == new:
                have[student] = have.get(student, 0) + 1
        want = {}
        for seq, student, _, _, end in batch:
            want[seq] = have.get(student, 0) < limit
            if want[seq] and end == new:
                have[student] = have.get(student, 0) + 1
        got = rules.active_rental_limit(spark.createDataFrame(existing, SCHEMA), spark.createDataFrame(batch, SCHEMA),
                                        ["seq"], day, limit)
        assert {r["seq"]: r["accepted"] for r in got.collect()} == want


def test_settings_from_system_config(spark):
    import pytest
    rows = spark.createDataFrame([(1, 7, 0, dt.datetime(2024, 1, 1), dt.datetime(2024, 4, 2))], SCHEMA)
    config = spark.createDataFrame([("max_rental_duration_months", 3)], "config_type string, config_value int")
    assert rules.rental_duration_check(rows, config).first()["violates"]
    with pytest.raises(rules.ConfigMissing):
        rules.active_rental_limit(rows, rows, ["seq"], dt.date(2024, 1, 1), config)
    with pytest.raises(rules.ConfigMissing):
        rules.rental_duration_check(rows, config.union(config))


def test_append_with_unreadable_keys_raises(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    from cadenza.sources.sinks import write_snapshot
    path = f"file://{tmp_path}/t"
    write_snapshot(spark.createDataFrame([(1,)], "other int"), path, mode="append")
    with pytest.raises(AnalysisException):
        write_snapshot(spark.createDataFrame([(1,)], "k int"), path, keys=["k"], mode="append")
