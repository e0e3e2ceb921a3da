"""Sorted tables: rows in one order across files, read back in that order without a sort.

``write_sorted`` deals rows to ranges of the whole sort key, so a first key that
holds many rows is split over several ranges by the keys after it, sorts within
each range, and leaves beside the data a small table of its files: least and
greatest key, number of rows, position of the first row. From it

* ``read_sorted`` numbers every row by its place in the whole order (file's first
  position plus the row's place in its file): no sort, no window, no shuffle;
* ``read_page`` opens only the files that hold the asked rows;
* ``files_in_order`` gives one DataFrame per file, for readers that take the rows in order.

A filter on the first key reads few row groups, since each file holds a narrow
range of it. The table of files is written last: a table without it is not complete.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = "_files"            # readers of the folder pass over names that start with an underscore
#: Beyond so many files the table of files is joined by a shuffle instead of a broadcast (about 100 bytes a file).
MAX_BROADCAST_FILES = 200_000


def write_sorted(df: DataFrame, path: str, order, ranges: int | None = None) -> None:
    """Replace the table at ``path`` by ``df`` in ``order`` (ascending, NULLs last as in PostgreSQL).

    ``ranges`` is the number of files; by default Spark's shuffle partitions, coalesced by AQE.
    """
    order = list(order)
    by = [F.asc_nulls_last(c) for c in order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    key = F.struct(*order)
    files = (df.sparkSession.read.schema(df.schema).parquet(path)
             .select(*order, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_at"))
             .groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by(key, "_at").alias("low"), F.max_by(key, "_at").alias("high")))
    # tasks are numbered in the order of their ranges; a task that writes several files numbers them too
    files = (files.withColumn("task", F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"))
             .withColumn("piece", F.coalesce(F.expr(r"try_cast(regexp_extract(file, '-c(\\d+)\\.', 1) AS long)"), F.lit(0))))
    before = Window.orderBy("task", "piece").rowsBetween(Window.unboundedPreceding, -1)        # one row per file
    (files.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
     .coalesce(1).sortWithinPartitions("first").write.parquet(f"{path.rstrip('/')}/{FILES}"))


def sorted_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, low, high, task, piece, first) of every file of a sorted table."""
    return spark.read.parquet(f"{path.rstrip('/')}/{FILES}")


def _numbered(data: DataFrame, files: DataFrame, out: str) -> DataFrame:
    few = files.limit(MAX_BROADCAST_FILES + 1).count() <= MAX_BROADCAST_FILES
    files = files.select(F.col("file").alias("_file"), F.col("first").alias("_first"))
    rows = data.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_at"))
    return (rows.join(F.broadcast(files) if few else files, F.col("_name") == F.col("_file"))
            .select(*data.columns, (F.col("_first") + F.col("_at")).alias(out)))


def read_sorted(spark: SparkSession, path: str, out: str = "position") -> DataFrame:
    """All rows with ``out``, their place in the table's order from 0; the rows come in any order."""
    return _numbered(spark.read.parquet(path), sorted_files(spark, path), out)


def read_page(spark: SparkSession, path: str, first: int, n: int, out: str = "position") -> DataFrame:
    """Rows ``first`` to ``first + n - 1`` of the table's order, in order; only their files are read."""
    data, files = spark.read.parquet(path), sorted_files(spark, path)
    files = files.where((F.col("first") < first + n) & (F.col("first") + F.col("n") > first))
    names = [f"{path.rstrip('/')}/{r['file']}" for r in files.select("file").collect()]          # the page's files
    if not names:
        return data.limit(0).withColumn(out, F.lit(0).cast("long"))
    page = _numbered(spark.read.schema(data.schema).parquet(*names), files, out)
    return page.where((F.col(out) >= first) & (F.col(out) < first + n)).orderBy(out)


def files_in_order(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """One DataFrame per file, in the table's order; each gives its rows in stored order."""
    schema = spark.read.parquet(path).schema
    for r in sorted_files(spark, path).select("file", "first").orderBy("first").toLocalIterator():
        yield spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{r['file']}")
