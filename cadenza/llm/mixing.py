"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Sizes are summed by source and hash bucket. Whole passes over a source are copies
of all its rows; the rest of its budget is a hash threshold: the cumulated
histogram finds the bucket in which the budget ends, and only that bucket is
refined, twice, down to a single 32-bit hash value. Rows are then kept by
comparing their hash with the threshold, without a sort.

Defined results: a null text has size 0; null is a source of its own, last in
order; rows of size 0 are taken zero words; rows with one id and text share a hash
and so are taken alike (ids that are null or repeated do not); an empty table, or one without words, takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import WORD, bounded_broadcast, stage

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
LEVELS = ((21, 2048), (10, 2048), (0, 1024))     # shift and bucket count: 32 bits in three steps
MAX_BROADCAST_SOURCES = 100_000


def hash32(doc_id: Column, text: Column) -> Column:
    """32 bits of a row's id and whole text."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 8), 16, 10).cast("long")


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, h): words of the whole text and the 32-bit hash that thresholds cut."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                     F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                     hash32(F.col(id_col), F.col(text_col)).alias("h"))


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, rest) per source.

    Weights 1, 2, 3 repeat over the sources in code point order. A target stops
    at MOST_COPIES times its source; what is over goes to the others by weight.
    Sources in ascending order of limit per weight stop up to one point, so one
    pass with running sums finds them all. One row per source, so the two
    global windows see no data rows.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * MOST_COPIES)
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    by = (by.withColumn("total", F.sum("source_size").over(everything))
          .withColumn("weights", F.sum("weight").over(everything))
          .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(up), F.lit(0)))
          .withColumn("left_weight", F.col("weights") - F.coalesce(F.sum("weight").over(up), F.lit(0))))
    number = "decimal(38,0)"
    by = by.withColumn("stops", F.col("left").cast(number) * F.col("weight").cast(number)
                       > F.col("most").cast(number) * F.col("left_weight").cast(number))
    shared = F.col("total") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0)).over(everything)
    among = F.col("weights") - F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(0)).over(everything)
    by = by.withColumn("shared", shared).withColumn("among", among)
    by = by.withColumn("target", F.when(F.col("stops"), F.col("most").cast("double"))
                       .otherwise((F.col("weight") * F.col("shared")).cast("double") / F.col("among").cast("double")))
    by = by.withColumn("whole", F.when(F.col("source_size") > 0,
                                       F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return by.select("source", "source_size", "target", "whole",
                     (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def hash_thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with ``threshold``: rows whose hash is below it are taken once more."""
    at = targets.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("base"),
                        F.lit(0).cast("long").alias("low"))
    for shift, n in LEVELS:
        span = n << shift
        mine = (F.col("source").eqNullSafe(F.col("s")) & (F.col("h") >= F.col("low"))
                & (F.col("h") < F.col("low") + F.lit(span)))
        hist = (rows.join(bounded_broadcast(at, MAX_BROADCAST_SOURCES), mine)
                .groupBy("s", "rest", "base", "low", F.shiftright(F.col("h") - F.col("low"), shift).alias("bucket"))
                .agg(F.sum("size").alias("words")))
        run = Window.partitionBy("s").orderBy("bucket")       # one row per bucket: n at most
        hist = hist.withColumn("end", F.col("base") + F.sum("words").over(run))
        at = stage(hist.withColumn("begin", F.col("end") - F.col("words"))
                   .where("begin <= rest AND rest < `end`")
                   .select("s", "rest", F.col("begin").alias("base"), "end",
                           (F.col("low") + F.shiftleft("bucket", shift)).alias("low")))
    # the last bucket is one hash value: taken if that comes nearer to the budget
    cut = at.select("s", (F.col("low") + (F.col("end") - F.col("rest") < F.col("rest") - F.col("base")).cast("long"))
                    .alias("cut"))
    return (targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("threshold", F.coalesce("cut", F.lit(0))).drop("s", "cut"))


def mix_plan(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, threshold) for ``sized`` rows; staged."""
    targets = stage(source_targets(rows))
    return stage(hash_thresholds(rows, targets).drop("rest"))


def mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (any columns, with source and h) with source_size, target and ``copies``."""
    plan = bounded_broadcast(plan.withColumnRenamed("source", "_plan_source"), MAX_BROADCAST_SOURCES)
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("_plan_source")))
            .withColumn("copies", (F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")).cast("int"))
            .drop("_plan_source", "whole", "threshold"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it; all columns kept."""
    plan = mix_plan(stage(sized(docs, id_col, text_col, source_col)))
    keyed = docs.select(F.struct("*").alias("_row"), F.col(source_col).alias("source"), hash32(F.col(id_col), F.col(text_col)).alias("h"))
    taken = mix(keyed, plan).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
