"""The foreachBatch wrapper: two micro-batches give the same decisions as one sequential batch."""

import datetime as dt

from pyspark.sql import functions as F

from cadenza.operators import rules
from cadenza.streaming import ingest
from cadenza.streaming.ingest import start_rental_admission

SCHEMA = "seq int, student_id int, instrument_id int, rental_start_time timestamp_ntz, lease_expiry_time timestamp_ntz"


def test_stream_equals_sequential_batch(spark, tmp_path):
    rows = [(i, i % 3, i % 2, dt.datetime(2024, 1, 1 + i), dt.datetime(2024, 3 if i % 5 else 9, 1))
            for i in range(12)]
    src = tmp_path / "in"
    spark.createDataFrame(rows[:6], SCHEMA).coalesce(1).write.parquet(str(src / "a"))
    spark.createDataFrame(rows[6:], SCHEMA).coalesce(1).write.parquet(str(src / "b"))
    inst = spark.createDataFrame([(0, 3), (1, 4)], "instrument_id int, available_stock int")
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    q = start_rental_admission(stream, inst, str(tmp_path / "out"), str(tmp_path / "chk"), ["seq"],
                               as_of=dt.date(2024, 2, 1), limit=2, max_months=12)
    q.awaitTermination(300)
    got = {r.seq: (r.accepted, r.reason) for r in spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()}
    whole = rules.rental_admission_row(spark.createDataFrame(rows, SCHEMA), inst, ["seq"],
                                       as_of=dt.date(2024, 2, 1), limit=2, max_months=12)
    exp = {r.seq: (r.accepted, r.reason) for r in whole.collect()}
    assert got == exp
    batches = spark.read.parquet(str(tmp_path / "out" / "decisions")).select("batch_id").distinct().count()
    assert batches == 2
    last = (spark.read.parquet(str(tmp_path / "out" / "stock")).filter(F.col("batch_id") == 1)
            .orderBy("instrument_id").collect())
    taken = {i: sum(1 for s, (a, _r) in exp.items() if a and rows[s][2] == i) for i in (0, 1)}
    assert [r.available_stock for r in last] == [3 - taken[0], 4 - taken[1]]


def _admit(spark, rows, batch_id, out, inst, existing=None, as_of=None):
    ingest.admit_batch(spark, spark.createDataFrame(rows, SCHEMA), batch_id, inst, existing, out, ["seq"], as_of, 2, 12)
    return {r.seq: r.accepted for r in spark.read.parquet(f"{out}/decisions").filter(F.col("batch_id") == batch_id).collect()}


def test_replay_on_a_later_day_decides_alike(spark, tmp_path, monkeypatch):
    """Two active rentals until 10 March: a third is refused on 9 March, and again when the batch is replayed on 20 March."""
    day = {"now": dt.date(2024, 3, 9)}
    monkeypatch.setattr(ingest, "session_date", lambda _spark: day["now"])
    inst = spark.createDataFrame([(0, 50)], "instrument_id int, available_stock int")
    out = str(tmp_path / "out")

    def rental(seq, end):
        return (seq, 1, 0, dt.datetime(2024, 1, 1), end)

    assert _admit(spark, [rental(0, dt.datetime(2024, 3, 10)), rental(1, dt.datetime(2024, 3, 10))], 0, out, inst) == {0: True, 1: True}
    third = [rental(2, dt.datetime(2024, 6, 1))]
    assert _admit(spark, third, 1, out, inst) == {2: False}
    day["now"] = dt.date(2024, 3, 20)
    assert _admit(spark, third, 1, out, inst) == {2: False}
    assert _admit(spark, [rental(3, dt.datetime(2024, 6, 1))], 2, out, inst) == {3: True}
    day["now"] = dt.date(2024, 3, 1)                       # a clock that goes back does not
    assert ingest.batch_day(spark, out, 3) == dt.date(2024, 3, 20)


def test_state_holds_open_rentals_of_the_last_batches(spark, tmp_path):
    inst = spark.createDataFrame([(i, 9) for i in range(40)], "instrument_id int, available_stock int")
    out = str(tmp_path / "out")
    had = spark.createDataFrame([(5, dt.datetime(2024, 2, 1)), (5, dt.datetime(2023, 2, 1))], "student_id int, lease_expiry_time timestamp_ntz")
    for k in range(4):
        rows = [(10 * k + i, 10 * k + i, i, dt.datetime(2024, 1, 1), dt.datetime(2023 if i % 2 else 2024, 2, 1)) for i in range(6)]
        _admit(spark, rows, k, out, inst, had, dt.date(2024, 1, 15))
    state = spark.read.parquet(f"{out}/active")
    assert sorted(r.batch_id for r in state.select("batch_id").distinct().collect()) == [2, 3]
    assert state.filter("batch_id = 3").count() == 1 + 4 * 3          # open rentals only
    assert spark.read.parquet(f"{out}/decisions").count() == 24
