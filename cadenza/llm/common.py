"""Helpers shared by the operators: reading, staging, size-checked broadcasts, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stage(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Numbered Parquet tables in one new folder of the shared checkpoint folder.

    For loops that join a table with itself: a checkpoint keeps its plan's size
    estimate, which every such join squares, so that planning alone soon takes
    minutes and the driver's memory; a file has its true size.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int, bytes_of: Column | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    ``df`` should be cheap to count (staged, or a small table). Beyond the bound
    Spark chooses a shuffle join, which AQE can split on hot keys. For rows of no
    fixed width ``bytes_of`` gives a row's size; their sum is bounded as well.
    """
    if bytes_of is not None and (df.agg(F.sum(bytes_of)).first()[0] or 0) > max_bytes:
        return df
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph with edges (a, b).

    Returns (node, component) for every node that has an edge to another node;
    component is the smallest node of its group. Each round hooks every node on
    its smallest neighbour, follows the pointers to the trees' roots by doubling,
    and contracts the trees, so stars and chains of any size take a few rounds
    and no neighbour list is ever gathered.
    Nulls and self-loops are dropped; an empty input gives an empty result.
    """
    keep = Tables(edges.sparkSession, "components").keep
    cur = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .where("a < b").distinct())
    hooks = []
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("parent")))
        while True:       # every node's pointer to its tree's root, twice as far each time
            jumped = keep(hook.join(hook.toDF("parent", "top"), "parent").select(
                "node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")))
            hook = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        hooks.append(hook)
        left, right = hooks[-1].toDF("a", "pa"), hooks[-1].toDF("b", "pb")
        cur = keep(cur.join(left, "a").join(right, "b").where("pa <> pb")
                    .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not hooks:
        return cur.toDF("node", "component")
    roots = hooks[0].toDF("node", "component")
    for hook in hooks[1:]:
        roots = roots.join(hook.toDF("component", "top"), "component", "left").select(
            "node", F.coalesce("top", "component").alias("component"))
    return keep(roots)
