"""Integrity audits: the schema's constraints re-stated as data-quality jobs.

Parquet tables do not enforce PRIMARY KEY, UNIQUE, CHECK, NOT NULL, FOREIGN
KEY, enum or length constraints, so each becomes a distributed query that
returns the offending rows or keys. Every audit aggregates before it joins
(map-side partial aggregation), so a hot key costs one partial count per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.scan import earlier_count
from cadenza.sources.schemas import ForeignKey


def key_violations(df: DataFrame, keys, out: str = "n", nulls_pass: bool = False) -> DataFrame:
    """PRIMARY KEY / UNIQUE: key values held by more than one row, with their row count.

    ``nulls_pass`` is for UNIQUE, where a key with a NULL equals no other.
    """
    keys = list(keys)
    if nulls_pass:
        df = df.dropna(subset=keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
            .filter(F.col(out) > 1))


def null_violations(df: DataFrame, columns) -> DataFrame:
    """NOT NULL: one pass over ``df``; one row per column with its row and NULL counts."""
    columns = list(columns)
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', _n{i}" for i, c in enumerate(columns))
    return wide.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, n_null)", "_rows AS n_rows")


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """CHECK (condition): rows where it is false. NULL passes, as in SQL."""
    return df.filter(~F.coalesce(condition, F.lit(True)))


def domain_violations(df: DataFrame, column: str, allowed) -> DataFrame:
    """Enum domain: values outside ``allowed`` (NULL passes), with their row counts."""
    c = F.col(column)
    return (df.filter(c.isNotNull() & ~c.isin(list(allowed)))
            .groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(column).alias("column_name"), "value", "n"))


def length_violations(df: DataFrame, column: str, max_len: int) -> DataFrame:
    """CHAR/VARCHAR(n): rows whose value is longer than n characters."""
    return df.filter(F.length(column) > max_len).withColumn("length", F.length(column))


def key_text(columns) -> Column:
    """A key as text: its values joined by commas; in composite keys a comma or backslash of a value is escaped."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat_ws(",", *(texts if len(texts) == 1 else [F.regexp_replace(t, r"([,\\])", r"\\$1") for t in texts]))


def fk_violations(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """FOREIGN KEY: child key values (NULL passes) with no parent row, with their row counts.

    The child is counted per key value first, so the anti join sees one row per
    distinct key however skewed the child is.
    """
    cc, pc = list(fk.child_cols), list(fk.parent_cols)
    counted = (child.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cc]))
               .groupBy(*cc).agg(F.count(F.lit(1)).alias("n")))
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(pc)]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(cc)])
    orphans = counted.join(keys, cond, "left_anti")
    return orphans.select(F.lit(fk.child).alias("child_table"),
                          F.lit(",".join(cc)).alias("child_columns"),
                          F.lit(fk.parent).alias("parent_table"),
                          key_text(cc).alias("key_value"),
                          "n")


def assign_ids(df: DataFrame, order, start_after: int = 0, out: str = "id") -> DataFrame:
    """Identity column: dense ids start_after+1, start_after+2, ... in ``order``.

    Uses the range-partitioned prefix count, never a window without
    PARTITION BY (which would put every row in one task);
    monotonically_increasing_id would not be dense.
    """
    return (earlier_count(df, [], order, out="_rank")
            .withColumn(out, (F.col("_rank") + F.lit(start_after + 1)).cast("long"))
            .drop("_rank"))


def assign_missing_ids(df: DataFrame, order, column: str, start_after: int = 0) -> DataFrame:
    """GENERATED BY DEFAULT identity: rows with an id in ``column`` keep it, the others get the free ones.

    In ``order``, the rows without an id take the smallest numbers above
    ``start_after`` that no row holds. The k-th smallest held number (from 0) has
    ``held - start_after - 1 - k`` free numbers below it, so the row of rank r
    skips as many held numbers as have at most r free ones below: one prefix count
    over ranks and gap sizes together, without a window over all rows.

    Adds ``collides``: whether a row's given id is held by another row as well
    (both are kept; the primary key would refuse the second).
    """
    cols, value = df.columns, F.col(column)
    missing = earlier_count(df.filter(value.isNull()), [], order, out="_at").withColumn("_kind", F.lit(1))
    held = (earlier_count(df.filter(value > start_after).select(value.cast("long").alias("_held")).distinct(), [], ["_held"], out="_k")
            .select((F.col("_held") - F.lit(start_after + 1) - F.col("_k")).alias("_at"), F.lit(0).alias("_kind")))
    both = missing.unionByName(held, allowMissingColumns=True)
    filled = (earlier_count(both, [], ["_at", "_kind"], flag=F.col("_kind") == 0, out="_skip").filter("_kind = 1")
              .withColumn(column, (F.col("_at") + F.col("_skip") + F.lit(start_after + 1)).cast(df.schema[column].dataType))
              .select(*cols, F.lit(False).alias("collides")))
    twice = (df.filter(value.isNotNull()).groupBy(value.alias("_given")).agg(F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").select("_given"))
    given = (df.filter(value.isNotNull()).join(twice, value == F.col("_given"), "left")
             .select(*cols, F.col("_given").isNotNull().alias("collides")))
    return given.unionByName(filled)


def next_id_after(existing: DataFrame, column: str) -> int:
    """max(id) of an existing table (0 when empty): the value identity ids continue after."""
    v = existing.agg(F.max(column)).first()[0]
    return int(v) if v is not None else 0
