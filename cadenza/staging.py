"""Intermediate tables as Parquet files in the shared checkpoint folder.

For loops that join a table with something derived from itself. A checkpoint
keeps its plan's size estimate and every such join multiplies it, so planning
soon takes longer than the work; a file that is written and read back has its
true size and a plan of one scan. Files are reliable like a checkpoint: a lost
executor reads them again. Tables that no later step reads are dropped by the
caller; what a returned DataFrame still reads goes when the driver ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cadenza.session import ensure_checkpoint_dir


def file_system(spark: SparkSession, path: str):
    """``path`` as a Hadoop path, and the store it is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove ``path`` with all it holds, in whatever store it is."""
    hadoop, fs = file_system(spark, path)
    fs.delete(hadoop, True)


class Stages:
    """Numbered Parquet tables in one new folder of the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._kept: dict[int, tuple[DataFrame, str]] = {}
        hadoop, fs = file_system(spark, self.folder)
        fs.deleteOnExit(hadoop)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as the next table of the folder and read back."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that ``keep`` returned and nothing reads any more."""
        for t in tables:
            _df, path = self._kept.pop(id(t))
            delete_path(self.spark, path)

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Kept tables of one schema as one scan, whatever their number."""
        return self.spark.read.schema(tables[0].schema).parquet(*[self._kept[id(t)][1] for t in tables])
