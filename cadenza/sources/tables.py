"""Loading the driver's Parquet tables.

Every read names only the columns the caller needs, so the scan's ReadSchema is
pruned even before Catalyst's own column pruning, and filters written on these
columns reach the Parquet reader as PushedFilters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` is the full table DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)
