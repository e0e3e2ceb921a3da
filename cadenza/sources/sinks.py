"""Sinks: key-checked snapshots, appends that publish when complete, updates of stored partitions.

The denormalisation jobs compute their complete output and overwrite a
snapshot, which makes a re-run idempotent (the SQL original fails on a second
run on its primary key). Key checks are distributed aggregates and joins; only
whether they found something reaches the driver.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.staging import Stages, delete_path, file_system

#: Ranges of new keys that old files are searched for, at most.
KEY_RANGES = 64


class KeyViolation(ValueError):
    pass


def assert_unique(df: DataFrame, keys: list[str] | tuple[str, ...], what: str = "primary key") -> None:
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1)
    if not dup.isEmpty():
        raise KeyViolation(f"{what} {tuple(keys)} is not unique")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet data at ``path``, or None if the path does not exist; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_snapshot(df: DataFrame, path: str, keys: list[str] | tuple[str, ...] | None = None,
                   partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Check ``keys`` then write ``df`` as Parquet (append mode mirrors INSERT ... SELECT).

    In append mode with ``keys`` the table-wide primary key is checked, as ``append_rows`` does.
    """
    if keys and mode == "append":
        append_rows(df, path, keys, partition_by)
        return
    if keys:
        assert_unique(df.select(*keys), keys)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def key_ranges(df: DataFrame, column: str, most: int = KEY_RANGES) -> list[tuple]:
    """(least, greatest) of ``column`` in at most ``most`` disjoint ranges that hold every value of ``df``."""
    ranged = (df.select(F.col(column).alias("k")).filter("k IS NOT NULL").repartitionByRange(most, "k")
              .groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("low"), F.max("k").alias("high")))
    return sorted((r["low"], r["high"]) for r in ranged.collect())          # at most ``most`` rows


def in_ranges(column: str, ranges: list[tuple]) -> Column:
    """Whether the column lies in one of the ranges, as comparisons that Parquet readers can prune files by."""
    found = F.lit(False)
    for low, high in ranges:
        found = found | ((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
    return found


def append_rows(df: DataFrame, path: str, keys: list[str] | tuple[str, ...], partition_by: list[str] | None = None) -> None:
    """Append ``df`` to the Parquet table at ``path``, or leave the table as it is.

    The rows are written beside the table in key order (the folder's name starts
    with an underscore, so readers pass it over), and the keys are checked there:
    among themselves, then against the old rows that lie in the new keys' ranges.
    Files are clustered by key, so the range comparisons let the Parquet reader
    pass over the row groups of all other old keys. Only when both checks are
    done are the files moved in; a violation or a failed job removes them.
    """
    spark, keys = df.sparkSession, list(keys)
    old = read_if_present(spark, path)
    waiting = f"{path.rstrip('/')}/_waiting-{uuid.uuid4().hex}"
    try:
        w = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(waiting)
        new = spark.read.schema(df.schema).parquet(waiting)
        assert_unique(new.select(*keys), keys)
        if old is not None:
            ranges = key_ranges(new, keys[0])
            if ranges and not old.filter(in_ranges(keys[0], ranges)).select(*keys).join(new.select(*keys), keys, "left_semi").isEmpty():
                raise KeyViolation(f"primary key {tuple(keys)} is not unique: some new rows are in the table already")
        _move_in(spark, waiting, path)
    finally:
        delete_path(spark, waiting)


def _move_in(spark: SparkSession, source: str, target: str) -> None:
    """Move all data files below ``source`` to the same places below ``target``."""
    root, fs = file_system(spark, source)
    base = fs.makeQualified(root).toString()
    files, listing = [], fs.listFiles(root, True)
    while listing.hasNext():
        place = listing.next().getPath()
        if not place.getName().startswith("_"):
            files.append(place)
    for place in files:
        to, _fs = file_system(spark, target.rstrip("/") + place.toString()[len(base):])
        fs.mkdirs(to.getParent())
        if not fs.rename(place, to):
            raise OSError(f"cannot move {place.toString()} to {to.toString()}")


def update_stored(spark: SparkSession, path: str, changes: DataFrame, key: str, partition_by: list[str]) -> int:
    """UPDATE of a stored partitioned Parquet table from ``changes``, rewriting only partitions that hold a changed row.

    ``changes`` has the key, once per row (a second one is an error, as for a
    scalar subquery), and the columns to set; rows without a change keep their
    values, and keys that the table does not hold are ignored. Columns that the
    table lacks are NULL in the partitions that are not rewritten. Partition
    columns cannot be set. The new partitions are complete before the old ones
    are replaced. Returns the number of partitions rewritten.
    """
    if set(changes.columns) & set(partition_by):
        raise ValueError("a change may not move a row to another partition")
    stored = spark.read.option("mergeSchema", "true").parquet(path)
    columns = [c for c in changes.columns if c != key]
    stages = Stages(spark, "update")
    new = changes.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    # which partitions: keys and partition columns only
    touched = stages.keep(stored.join(new.select(F.col("_key").alias(key)), key, "left_semi").select(*partition_by).distinct())
    n = touched.count()
    if n:
        mine = stored.join(F.broadcast(touched) if n <= 10_000 else touched, partition_by, "left_semi")
        rows = mine.join(new.groupBy("_key").agg(F.any_value("_new").alias("_new"), F.count(F.lit(1)).alias("_n")),
                         F.col(key) == F.col("_key"), "left")
        found = F.col("_key").isNotNull()
        twice = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one change for a row")))
        out = [c for c in stored.columns if c not in columns and c not in partition_by] + columns
        rows = rows.select(*[F.col(c) if c not in columns else twice.when(found, F.col(f"_new.{c}"))
                             .otherwise(F.col(c) if c in stored.columns else F.lit(None)).alias(c) for c in out], *partition_by)
        rows = stages.keep(rows)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
        stages.drop(rows)
    stages.drop(touched)
    return n
