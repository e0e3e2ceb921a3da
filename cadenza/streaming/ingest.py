"""Apply the rental rules to a stream of rental inserts with ``foreachBatch``.

The source checks rentals one insert at a time. A stream of inserts maps to
micro-batches: each micro-batch is admitted with ``rules.rental_admission_row``
(or statement mode) against the state left by the batches before it. State is
derived, not mutated:

* ``out/decisions/batch_id=k``: every row of batch k with accepted / reason.
* ``out/stock/batch_id=k``: stock per instrument after batch k.
* ``out/active/batch_id=k``: rentals that are active after batch k (student and
  expiry); those that have run out leave it, so it grows with the rentals that
  are open and not with all decisions ever made.
* ``out/days/batch_id=k``: the date that batch k is judged by.

Batch k reads the stock and the active rentals of the latest earlier batch (or
the initial tables), and overwrites only its own ``batch_id=k`` partitions.
Without ``as_of`` the date is the session's CURRENT_DATE when batch k is first
tried, written down before anything is decided and never before that of an
earlier batch; a replay reads it. A replay of batch k after a failure therefore
gives the same output, also on a later day, which is what makes the sink
idempotent under Structured Streaming's at-least-once batch replay. Snapshots
that no replay can need (before batch k - 1) are removed.
The order of rows inside a batch comes from the ``order`` columns; batches are
ordered by batch id.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import to_date
from cadenza.functions.pg import session_date
from cadenza.operators import rules
from cadenza.sources.sinks import read_if_present
from cadenza.staging import file_system


def _latest_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    snap = read_if_present(spark, path)
    if snap is None:
        return None
    earlier = snap.filter(F.col("batch_id") < batch_id)
    last = earlier.agg(F.max("batch_id")).first()[0]
    if last is None:
        return None
    return earlier.filter(F.col("batch_id") == last).drop("batch_id")


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def batch_day(spark: SparkSession, out: str, batch_id: int, as_of=None) -> _dt.date:
    """The date of batch ``batch_id``: ``as_of``, else the one written down for it, else today's, which is written down."""
    if as_of is not None:
        return to_date(as_of)
    days = read_if_present(spark, f"{out}/days")
    known = days.filter(F.col("batch_id") <= batch_id).agg(
        F.max("day").alias("last"), F.max(F.when(F.col("batch_id") == batch_id, F.col("day"))).alias("own")).first() if days else None
    if known and known["own"]:
        return known["own"]
    day = max([session_date(spark), *([known["last"]] if known and known["last"] else [])])
    _write(spark.range(1).select(F.lit(day).alias("day")), f"{out}/days", batch_id)
    return day


def _forget(spark: SparkSession, path: str, before: int) -> None:
    """Remove the snapshots of batches earlier than ``before``."""
    root, fs = file_system(spark, path)
    for place in fs.listStatus(root):
        name = place.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=")[1]) < before:
            fs.delete(place.getPath(), True)


def admit_batch(spark: SparkSession, batch: DataFrame, batch_id: int, instruments: DataFrame,
                existing: DataFrame | None, out: str, order: list, as_of, limit: int, max_months: int,
                mode: str = "row") -> None:
    day = batch_day(spark, out, batch_id, as_of)
    stock = _latest_before(spark, f"{out}/stock", batch_id)
    if stock is None:
        stock = instruments.select("instrument_id", "available_stock")
    prior = _latest_before(spark, f"{out}/active", batch_id)
    if prior is None and existing is not None:
        prior = existing.select("student_id", "lease_expiry_time")

    if mode == "row":
        decided = rules.rental_admission_row(batch, stock, order, existing=prior, as_of=day, limit=limit,
                                             max_months=max_months)
    else:
        tagged = batch.withColumn("_stmt", F.lit(batch_id))
        verdict = rules.rental_admission_statement(tagged, stock, order, "_stmt", existing=prior, as_of=day,
                                                   limit=limit, max_months=max_months)
        # one verdict row per statement: the whole batch is accepted or aborted with the first reason
        decided = tagged.join(F.broadcast(verdict.select("_stmt", "accepted", "reason")), "_stmt").drop("_stmt")
    dec_path = f"{out}/decisions"
    _write(decided, dec_path, batch_id)
    accepted = spark.read.parquet(dec_path).filter((F.col("batch_id") == batch_id) & F.col("accepted"))
    active = accepted.select("student_id", "lease_expiry_time")
    if prior is not None:
        active = prior.unionByName(active)
    _write(active.filter(rules.is_active("lease_expiry_time", day)), f"{out}/active", batch_id)
    taken = accepted.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("_n"))
    after = (stock.join(taken, "instrument_id", "left")
             .select("instrument_id",
                     (F.col("available_stock") - F.coalesce("_n", F.lit(0))).cast("int").alias("available_stock")))
    _write(after, f"{out}/stock", batch_id)
    for state in ("active", "stock"):
        _forget(spark, f"{out}/{state}", batch_id - 1)


def start_rental_admission(stream: DataFrame, instruments: DataFrame, out: str, checkpoint_location: str,
                           order: list, existing: DataFrame | None = None, as_of=None,
                           limit: int = rules.DEFAULT_MAX_ACTIVE, max_months: int = rules.DEFAULT_MAX_MONTHS,
                           mode: str = "row", trigger: dict | None = None):
    """Start the streaming query; returns the StreamingQuery."""
    spark = stream.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        admit_batch(spark, batch, batch_id, instruments, existing, out, order, as_of, limit, max_months, mode)

    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_location)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
