"""Reading the domain's tables, appends that publish when complete, updates of stored partitions."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cadenza.operators import audit, denorm, reports
from cadenza.sources import domain, sinks
from cadenza.sources.schemas import DOMAIN_FOREIGN_KEYS, DOMAIN_RULES, SCHEMAS


def _files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _s, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


# ------------------------------------------------------------------ S1

def test_fixtures_read_from_parquet_are_audited_and_reported(fx, spark, tmp_path):
    for t, df in fx.items():
        if t == "email":                          # CHAR(10) as a database exports it
            df = df.withColumn("email_id", F.rpad("email_id", 10, " "))
        df.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    tables, bad = domain.read_domain(spark, str(tmp_path), list(fx))
    assert bad.count() == 0
    for t in fx:
        assert tables[t].schema.simpleString() == domain.declared_schema(t).simpleString()
        assert sorted(map(repr, tables[t].collect())) == sorted(map(repr, fx[t].collect()))
    assert audit.audit(tables, DOMAIN_RULES, DOMAIN_FOREIGN_KEYS).agg(F.sum("n_rows")).first()[0] == 0
    got = reports.monthly_lesson_summary(tables["lesson"], tables["individual_lesson"], tables["group_lesson"],
                                         tables["ensembles_lesson"], 2023)
    assert [tuple(r) for r in got.collect()] == [("Nov", 11, 6, 3, 2, 1), ("Dec", 12, 3, 1, 2, 0)]


def test_malformed_rows_are_set_aside_with_a_reason(spark):
    rows = [("1", "12", "10.5", "2024-01-31", "x"), ("2", None, None, "2024-02-30", "y"), ("3", "a", "1.005", "2024-01-01", None),
            (None, "7", "20.00", None, "z"), ("99999999999", "1", "1", "2024-01-01", "w")]
    df = spark.createDataFrame(rows, "student_id string, payment_id string, amount string, payment_date string, further string")
    good, bad = domain.check_rows(df, "student_payment")
    assert [f.name for f in good.schema] == [f.name for f in domain.declared_schema("student_payment")]
    assert sorted((r.student_id, str(r.amount), r.payment_date, r.rental_id) for r in good.collect() if r.student_id) == [
        (1, "10.50", dt.date(2024, 1, 31), None)]
    assert good.count() == 2
    assert {r.reason for r in bad.collect()} == {"payment_date", "amount", "student_id"}
    assert all("further" in r.stored for r in bad.collect() if '"student_id":"2"' in r.stored)
    with pytest.raises(domain.MissingColumns, match="amount"):
        domain.check_rows(df.drop("amount"), "student_payment")
    empty_good, empty_bad = domain.check_rows(df.limit(0), "student_payment")
    assert empty_good.count() == 0 and empty_bad.count() == 0


# ------------------------------------------------------------------ S3

def test_append_checks_the_table_and_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    sinks.append_rows(first, path, ["k"])
    before = _files(path)
    more = spark.range(1000, 1010).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"))
    with pytest.raises(sinks.KeyViolation, match="already"):
        sinks.append_rows(more.union(first.limit(1)), path, ["k"])
    with pytest.raises(sinks.KeyViolation, match="not unique"):
        sinks.append_rows(more.union(more), path, ["k"])
    with pytest.raises(Exception, match="broken"):
        sinks.append_rows(more.withColumn("v", F.when(F.col("k") < 1009, F.col("v")).otherwise(F.raise_error(F.lit("broken")))), path, ["k"])
    assert _files(path) == before and not [f for f in os.listdir(path) if "waiting" in f]
    sinks.append_rows(more, path, ["k"])
    assert spark.read.parquet(path).count() == 1010 and set(before) < set(_files(path))
    sinks.append_rows(more.limit(0), path, ["k"])
    assert spark.read.parquet(path).count() == 1010


def test_append_of_one_percent_passes_over_old_keys(spark, tmp_path):
    """Old rows outside the new keys' ranges are not read: their row groups are pruned by the pushed comparisons."""
    path = str(tmp_path / "t")
    spark.range(0, 20000).withColumnRenamed("id", "k").repartitionByRange(10, "k").write.parquet(path)
    old, new = spark.read.parquet(path), spark.range(1_000_000, 1_000_200).withColumnRenamed("id", "k")
    scanned = old.filter(sinks.in_ranges("k", sinks.key_ranges(new, "k")))
    assert "PushedFilters: [Or" in scanned._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert scanned.count() == 0
    plan = scanned.select("k")
    plan.collect()
    rows = plan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert rows == 0
    inside = sinks.key_ranges(spark.range(500, 700).withColumnRenamed("id", "k"), "k")
    hit = old.filter(sinks.in_ranges("k", inside)).select("k")
    assert len(hit.collect()) == 200
    assert hit._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value() <= 2500


def test_append_into_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("p"))
    sinks.write_snapshot(rows.filter("k < 50"), path, keys=["k"], partition_by=["p"])
    sinks.write_snapshot(rows.filter("k >= 50"), path, keys=["k"], partition_by=["p"], mode="append")
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "p").collect())) == [(k, k % 3) for k in range(60)]


# ------------------------------------------------------------------ S7

def test_update_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "payments")
    payments = spark.createDataFrame([(f"P{k}", f"R{k}", dt.date(2024, 1 + k % 4, 1)) for k in range(40)],
                                     "payment_id string, rental_id string, payment_date date").withColumn("month", F.month("payment_date"))
    sinks.write_snapshot(payments, path, keys=["payment_id"], partition_by=["month"])
    before = _files(path)
    rental = spark.createDataFrame([("R4", "I1", dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)),
                                    ("R8", "I2", dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 2, 9)), ("R99", "I1", None, None)],
                                   "rental_id string, instrument_id string, rental_start_time timestamp_ntz, lease_expiry_time timestamp_ntz")
    inst = spark.createDataFrame([("I1", "piano"), ("I2", "harp")], "instrument_id string, instrument_type string")
    stored = spark.read.parquet(path).join(rental.select("rental_id"), "rental_id", "left_semi")
    changes = denorm.payment_denorm(stored, rental, inst).select("payment_id", "instrument_name", "rental_duration")
    assert sinks.update_stored(spark, path, changes, "payment_id", ["month"]) == 1
    after = _files(path)
    assert [f for f in after if "month=1/" not in f] == [f for f in before if "month=1/" not in f]
    rows = {r.payment_id: r for r in spark.read.option("mergeSchema", "true").parquet(path).collect()}
    assert len(rows) == 40 and (rows["P4"].instrument_name, rows["P4"].rental_duration) == ("piano", 31)
    assert (rows["P8"].instrument_name, rows["P8"].rental_duration) == ("harp", 0) and rows["P0"].instrument_name is None
    assert all(r.month == r.payment_date.month for r in rows.values())


def test_update_without_hits_and_with_two_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int").write.partitionBy("p").parquet(path)
    before = _files(path)
    assert sinks.update_stored(spark, path, spark.createDataFrame([(9, "x")], "k int, v string"), "k", ["p"]) == 0
    with pytest.raises(Exception, match="more than one change"):
        sinks.update_stored(spark, path, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), "k", ["p"])
    with pytest.raises(ValueError, match="partition"):
        sinks.update_stored(spark, path, spark.createDataFrame([(1, 5)], "k int, p int"), "k", ["p"])
    assert _files(path) == before
    assert sinks.update_stored(spark, path, spark.createDataFrame([(1, None)], "k int, v string"), "k", ["p"]) == 1
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v", "p").collect())) == [(1, None, 1), (2, "b", 2)]


def test_schemas_have_columns_for_every_char(spark):
    for t, cols in domain.CHAR_COLUMNS.items():
        assert set(cols) <= {f.name for f in domain.declared_schema(t)} and t in SCHEMAS
