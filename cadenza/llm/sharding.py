"""Consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has equal arcs, ``RING`` or at least twice as many as nodes. Every shard places ``virtual`` nodes on it; an
arc belongs to the next node clockwise. A shard holds at most its capacity (the
row count divided evenly, so counts differ by one at most); rows of an arc beyond
its shard's room continue clockwise to the next node whose shard has room.

Only arc counts (as many numbers as arcs, a constant) reach the driver, which decides
how many rows of each arc every shard takes. A row's rank in its arc comes from
cell counts plus a window inside one cell; cells are fine enough for about
``CELL_ROWS`` rows each whatever the input's size, so no task holds an arc.

Defined results: null ids and texts hash like any value; identical rows are dealt
one by one; an empty table gives no rows; extra columns are kept as they are, but
for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RING = 1024
CELL_ROWS = 20_000


def ring_size(n_shards: int, virtual: int) -> int:
    """Arcs of the ring: a power of two with room for all nodes."""
    return max(RING, 1 << (2 * n_shards * virtual - 1).bit_length())


def arc_owners(n_shards: int, virtual: int) -> list[int]:
    """Shard that owns each arc: virtual nodes sit at hashed arcs, the next one clockwise owns."""
    ring = ring_size(n_shards, virtual)
    node_at: dict[int, int] = {}
    for shard in range(n_shards):                 # a further shard finds all others' nodes in their places
        for replica in range(virtual):
            at = zlib.crc32(f"shard {shard} node {replica}".encode()) % ring
            while at in node_at:
                at = (at + 1) % ring
            node_at[at] = shard
    owners, last = [0] * ring, node_at[min(node_at)]
    for arc in range(ring - 1, -1, -1):
        last = node_at.get(arc, last)
        owners[arc] = last
    return owners


def bounded_takes(loads: list[int], owners: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank) for every run of rows that one shard takes."""
    total = sum(loads)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    filled = [0] * n_shards
    takes = []

    def take(arc: int, start: int, n: int, shard: int) -> None:
        takes.append((arc, start, start + n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    over = []
    for arc, load in enumerate(loads):
        n = min(load, room[owners[arc]])
        if n:
            take(arc, 0, n, owners[arc])
        if n < load:
            over.append((arc, n, load))
    for arc, start, load in over:
        at = arc
        while start < load:
            at = (at + 1) % len(loads)
            n = min(load - start, room[owners[at]])
            if n:
                take(arc, start, n, owners[at])
                start += n
    return takes


def shard_rows(df: DataFrame, key_cols: list[str], n_shards: int = 8, virtual: int = 32) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``key_cols`` place a row on the ring and order rows at one place. Slots and
    shards depend on the rows' keys alone, so reruns agree. ``df`` is read three
    times (row count, arc counts, result); only its key columns the first times.
    """
    spark = df.sparkSession
    total = df.count()
    ring = ring_size(n_shards, virtual)
    bits = ring_bits = ring.bit_length() - 1
    while total > CELL_ROWS << bits and bits < 40:
        bits += 1
    order = [f"_key_{i}" for i in range(len(key_cols))]
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]).alias("_row"),
                      *[F.col(f"`{c}`").alias(k) for c, k in zip(key_cols, order)])
    keyed = keyed.withColumn("_ring", F.xxhash64(*order)).withColumn("_cell", F.shiftrightunsigned("_ring", 64 - bits))
    keyed = keyed.withColumn("_arc", F.shiftright("_cell", bits - ring_bits).cast("int"))
    cells = keyed.groupBy("_arc", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    loads = [0] * ring
    for r in cells.groupBy("_arc").agg(F.sum("_n").alias("n")).collect():      # one row per arc at most
        loads[r["_arc"]] = r["n"]
    takes = spark.createDataFrame(bounded_takes(loads, arc_owners(n_shards, virtual), n_shards),
                                  "_arc int, _from long, _to long, shard int, _slot long")
    inside = Window.partitionBy("_cell").orderBy("_ring", *[F.col(k).asc_nulls_first() for k in order])
    ranked = (keyed.withColumn("_at", F.row_number().over(inside) - 1)
              .join(cells.select("_cell", "_before"), "_cell")
              .withColumn("_rank", F.col("_before") + F.col("_at")))
    # takes has at most one row per arc and one more per arc and shard, of five numbers
    placed = ranked.join(F.broadcast(takes), "_arc").where("_rank >= _from AND _rank < _to")
    return placed.select("_row.*", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def sharded_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shard and slot; input columns of these names are replaced."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]).alias("_doc"),
                        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"))
    return shard_rows(keyed, ["_id", "_th"], n_shards).select("_doc.*", "shard", "slot")
