"""Keyed prefix count that stays balanced when one key holds a large share of rows.

``earlier_count(df, keys, order, flag)`` adds, to every row, the number of rows
of the same key that come before it in ``order`` and have ``flag`` set: what
``count(...) OVER (PARTITION BY keys ORDER BY order ROWS BETWEEN UNBOUNDED
PRECEDING AND 1 PRECEDING)`` computes. That window alone would put every key in
one task, so a key holding a third of the data would run in a single task.
Here instead:

1. ``range_buckets``: ``repartitionByRange(keys, order)`` samples the sort
   keys, so a hot key is split across many ranges by its order columns. The
   range index is stored as a column and checkpointed, which pins it: a lost
   executor re-reads the checkpoint instead of re-sampling different bounds.
2. A window partitioned by (bucket, keys) counts within each bucket. Each
   window group is at most one range, whatever the key's size.
3. Only a key that crosses a range boundary needs a correction, and only in
   its first run of a range. Such a (bucket, key) is the first or last key of
   its bucket, so the correction table has at most two rows per bucket: a
   proven bound, which makes broadcasting it safe.

Everything is built from DataFrame operators (window, hash aggregates with
partial aggregation, broadcast joins); no Python runs inside tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import ensure_checkpoint_dir

BUCKET = "_scan_bucket"
LOC = "_scan_loc"
FLAG = "_scan_flag"
HOT_ROWS = 1 << 18              # keys of more rows are split over several tasks
HOT_SLOTS = 1 << 14             # keys are counted by hash first, in so many slots


def range_buckets(df: DataFrame, keys, order, name: str = BUCKET) -> DataFrame:
    """Pin a range layout: ``name`` = index of the sampled range of (keys, order) holding the row.

    Checkpointed, so every row's bucket is fixed from here on. Repeated
    ``earlier_count(..., bucket=name)`` calls over the same rows (with changing
    flags) then need no new sampling and no checkpoint of their own.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sort_cols = [F.col(c).asc_nulls_first() for c in list(keys) + list(order)]
    return df.repartitionByRange(*sort_cols).withColumn(name, F.spark_partition_id()).checkpoint(eager=True)


def same_keys(keys: list[str], prefix: str) -> Column:
    """Whether ``keys`` equal the columns of their names after ``prefix``; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def bucket_edges(df: DataFrame, keys, bucket: str) -> DataFrame:
    """(bucket, key) pairs that can continue a run across a bucket boundary: each bucket's
    first and last key in (keys ascending, NULLs first) order. At most two rows per
    bucket; depends only on the layout, not on any flag.

    Multi-column keys are narrowed one column at a time with hash aggregates
    (partial aggregation, no sort): column i is minimised / maximised among the
    rows that match the first i-1 columns of the bucket's minimum / maximum.
    """
    keys = list(keys)
    d = df.select(bucket, *keys)
    found = None
    for i, k in enumerate(keys):
        c = F.col(k)
        if i == 0:
            on_lo = on_hi = F.lit(True)
            src = d
        else:
            on_lo = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_lo_{p}")) for p in keys[:i]])
            on_hi = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_hi_{p}")) for p in keys[:i]])
            src = d.join(F.broadcast(found), bucket)      # one row per bucket
        # ascending with NULLs first: the minimum is NULL whenever a NULL is present
        lo = F.when(F.count_if(on_lo & c.isNull()) > 0, F.lit(None)).otherwise(F.min(F.when(on_lo, c)))
        hi = F.max(F.when(on_hi, c))
        step = src.groupBy(bucket).agg(lo.cast(d.schema[k].dataType).alias(f"_lo_{k}"), hi.alias(f"_hi_{k}"))
        found = step if found is None else found.join(step, bucket)
    edges = (found.select(F.col(bucket).alias("_e_b"), *[F.col(f"_lo_{k}").alias(f"_e_{k}") for k in keys])
             .unionByName(found.select(F.col(bucket).alias("_e_b"),
                                       *[F.col(f"_hi_{k}").alias(f"_e_{k}") for k in keys])))
    return edges.distinct()


def mark_edges(df: DataFrame, keys, bucket: str, name: str) -> DataFrame:
    """Add ``name``: whether the row's key is an edge key of its bucket, for counts that reuse the layout."""
    keys = list(keys)
    edges = bucket_edges(df, keys, bucket).withColumn("_e_yes", F.lit(True))
    return (df.join(F.broadcast(edges), (F.col(bucket) == F.col("_e_b")) & same_keys(keys, "_e_"), "left")
            .withColumn(name, F.coalesce("_e_yes", F.lit(False)))
            .drop("_e_b", "_e_yes", *[f"_e_{k}" for k in keys]))


def hot_keys(df: DataFrame, keys) -> DataFrame | None:
    """The ``keys`` (named ``_h_`` and their name) of over HOT_ROWS rows, as a checkpointed table; None if there are none.

    Rows are counted by a hash of their key first: a slot holds all rows of its
    keys, so only keys of slots of over HOT_ROWS rows are counted themselves, and
    a task sends at most HOT_SLOTS counts. There are at most rows / HOT_ROWS hot keys.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(keys)
    slot = F.pmod(F.xxhash64(*keys), F.lit(HOT_SLOTS))
    slots = df.groupBy(slot.alias("_h_slot")).agg(F.count(F.lit(1)).alias("_h_n")).filter(F.col("_h_n") > HOT_ROWS)
    full = [r["_h_slot"] for r in slots.collect()]
    if not full:
        return None
    hot = (df.filter(slot.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_h_n")).filter(F.col("_h_n") > HOT_ROWS)
           .select(*[F.col(k).alias(f"_h_{k}") for k in keys]).checkpoint(eager=True))
    return None if hot.isEmpty() else hot


def split_hot_keys(df: DataFrame, keys, order, name: str, edge: str) -> DataFrame:
    """Add ``name`` and ``edge`` as ``range_buckets`` and ``mark_edges`` do, with ranges for the keys of over HOT_ROWS rows alone.

    All rows of the other keys have bucket -1, which costs no shuffle of the rows,
    only their count (``hot_keys``); a window group is still never larger than
    HOT_ROWS or one range. ``df`` should be cheap to read again (a written table).
    """
    keys = list(keys)
    rest = {name: F.lit(-1), edge: F.lit(False)}
    hot = hot_keys(df, keys)
    if hot is None:
        return df.withColumns(rest)
    on = same_keys(keys, "_h_")
    ranges = mark_edges(range_buckets(df.join(F.broadcast(hot), on, "left_semi"), keys, order, name), keys, name, edge)
    return df.join(F.broadcast(hot), on, "left_anti").withColumns(rest).unionByName(ranges)


def earlier_count(df: DataFrame, keys, order, flag: Column | str | None = None,
                  out: str = "earlier", inclusive: bool = False, bucket: str | None = None,
                  edges: DataFrame | str | None = None) -> DataFrame:
    """Add ``out``: count of rows with the same ``keys`` before this row in ``order`` with ``flag`` set.

    ``keys`` may be empty (one global sequence). ``order`` is a list of column
    names, ascending, that makes a total order within a key. ``flag`` defaults to
    every row; NULL counts as false. With ``inclusive`` the row itself counts too.
    ``bucket`` names a column from ``range_buckets`` over the same keys and order;
    without it the layout is sampled and pinned here. ``edges`` may pass in
    ``bucket_edges`` of that layout when it is reused across calls.
    """
    return earlier_counts(df, keys, order, {out: F.lit(True) if flag is None else flag}, inclusive, bucket, edges)


def earlier_counts(df: DataFrame, keys, order, flags: dict[str, Column | str], inclusive: bool = False,
                   bucket: str | None = None, edges: DataFrame | str | bool | None = None) -> DataFrame:
    """``earlier_count`` of several flags in one pass: ``flags`` maps each new column to what it counts.

    A whole number in place of a flag is summed, so signed events can be counted up and down.
    ``edges`` may also name a boolean column that marks the rows of edge keys (``mark_edges``), or
    be False where no key has over HOT_ROWS rows (``hot_keys``): one window, no ranges.
    """
    keys, order = list(keys), list(order)
    if edges is False:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        return df.withColumns({out: F.coalesce(F.sum(F.coalesce((F.col(f) if isinstance(f, str) else f).cast("long"), F.lit(0))).over(w),
                                               F.lit(0)) for out, f in flags.items()})
    added = []
    if not keys:
        df = df.withColumn("_scan_key", F.lit(0))
        keys, added = ["_scan_key"], ["_scan_key"]
    if bucket is None:
        df = range_buckets(df, keys, order, BUCKET)
        bucket = BUCKET
        added.append(BUCKET)
    outs = list(flags)
    n = range(len(outs))
    d = df.withColumns({f"{FLAG}_{i}": F.coalesce((F.col(f) if isinstance(f, str) else f).cast("int"), F.lit(0))
                       .cast("long") for i, f in enumerate(flags.values())})

    # 1. count inside each (bucket, key): a window group never exceeds one range
    w = Window.partitionBy(bucket, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    main = d.withColumns({f"{LOC}_{i}": F.coalesce(F.sum(f"{FLAG}_{i}").over(w), F.lit(0)) for i in n})

    # 2. first and last key of every bucket: fixed by the layout, so reusable across calls
    if edges is None:
        edges = bucket_edges(d, keys, bucket)

    # 3. per-bucket totals of the edge keys, then the offset of each spanning key's first run
    edge_rows = (d.filter(edges) if isinstance(edges, str) else
                 d.join(F.broadcast(edges), (F.col(bucket) == F.col("_e_b")) & same_keys(keys, "_e_"), "left_semi"))
    tot = (edge_rows.groupBy(bucket, *keys).agg(*[F.sum(f"{FLAG}_{i}").alias(f"_tot_{i}") for i in n]))
    w2 = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tot.withColumns({f"_off_{i}": F.coalesce(F.sum(f"_tot_{i}").over(w2), F.lit(0)) for i in n})
               .filter(reduce(lambda a, b: a | b, [F.col(f"_off_{i}") != 0 for i in n]))
               .select(F.col(bucket).alias("_o_b"), *[F.col(c).alias(f"_o_{c}") for c in keys],
                       *[f"_off_{i}" for i in n]))

    total = {out: F.col(f"{LOC}_{i}") + F.coalesce(F.col(f"_off_{i}"), F.lit(0))
             + (F.col(f"{FLAG}_{i}") if inclusive else F.lit(0)) for i, out in enumerate(outs)}
    return (main.join(F.broadcast(offsets), (F.col(bucket) == F.col("_o_b")) & same_keys(keys, "_o_"), "left")
            .withColumns(total)
            .drop("_o_b", *[f"_o_{c}" for c in keys], *added,
                  *[f"{p}_{i}" for p in (LOC, FLAG, "_off") for i in n]))
