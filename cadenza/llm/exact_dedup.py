"""Exact document dedup by content-defined chunk recipes (DataFrame functions only).

A text is tiled into chunks that end where the content says so (after a newline
or sentence mark, at least ``MIN_CHUNK`` and at most ``MAX_CHUNK`` characters).
A chunk's short identifier is its 64-bit hash, verified over the whole corpus:
an identifier that stands for more than one SHA-256 digest is told apart by an
ordinal. Documents are then compared by their ordered identifier lists, which
are about 2 % of the text, so no long document crosses a shuffle.

Defined results: a null text counts as empty; all empty texts form one group;
the row with the largest id stays (a null id is the smallest); of repeated rows
with the same id and text exactly one stays; an empty table gives no rows; other
columns, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stage

MIN_CHUNK, MAX_CHUNK = 256, 2048
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:(?<=[\n.!?])|\z)|.{{1,{MAX_CHUNK}}}"


def chunk_recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe array<long>, digests array<binary>) per row of ``df``.

    ``id_bits`` shortens the identifiers, for tests of clashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chunks = (df.select(F.col(id_col).alias("doc_id"), text.alias("t"))
              .select("doc_id", F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"),
                      F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0)).alias("chunks")))
    return chunks.select(
        "doc_id", "text_sha256",
        F.transform("chunks", lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - id_bits) if id_bits < 64 else F.xxhash64(c))
        .alias("recipe"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"))


def chunk_rows(recipes: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, pos, chunk_id, digest) for every chunk of every row."""
    zipped = F.arrays_zip(F.col("recipe").alias("chunk_id"), F.col("digests").alias("digest"))
    return recipes.select("doc_id", "text_sha256", F.posexplode(zipped).alias("pos", "c")).select(
        "doc_id", "text_sha256", "pos", "c.chunk_id", "c.digest")


def clashing_ids(parts: DataFrame) -> DataFrame:
    """Identifiers that stand for several contents: one number each is gathered per identifier and task."""
    content = F.xxhash64("digest")
    return (parts.groupBy("chunk_id").agg(F.min(content).alias("x"), F.max(content).alias("y"))
            .where("x <> y").select("chunk_id"))


def clash_ordinals(parts: DataFrame, clashes: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, fixes): "position:ordinal" of a row's chunks whose identifier clashes.

    Of the contents that share an identifier the smallest digest has ordinal 0, which is left out.
    """
    hit = parts.join(clashes, "chunk_id")
    known = hit.select("chunk_id", "digest").distinct()
    lower = known.select("chunk_id", F.col("digest").alias("other"))
    # clashes are a handful in any corpus (64-bit identifiers); count the smaller digests beside each
    ordinals = (known.join(lower, "chunk_id").where("other < digest")
                .groupBy("chunk_id", "digest").agg(F.count("*").alias("ordinal")))
    return (hit.join(ordinals, ["chunk_id", "digest"]).distinct()
            .groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.concat_ws(":", "pos", "ordinal"))).alias("fixes")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    recipes = stage(chunk_recipes(df, id_col, text_col, id_bits))
    rows = recipes.groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("n"))
    parts = chunk_rows(recipes)
    clashes = stage(clashing_ids(parts))
    none = F.array().cast("array<string>")
    if clashes.isEmpty():
        rows = rows.withColumn("fixes", none)
    else:
        fixes = clash_ordinals(parts, clashes).toDF("f_id", "f_sha", "found")
        rows = (rows.join(fixes, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_sha256") == F.col("f_sha")), "left")
                .select("doc_id", "text_sha256", "recipe", "n", F.coalesce("found", none).alias("fixes")))
    key = ["list_hash", "recipe", "fixes"]
    rows = stage(rows.withColumn("list_hash", F.xxhash64("recipe", "fixes")))
    # grouped by the list alone and joined on hash and list: the join exchanges both sides, so AQE can split a hot list
    groups = (rows.groupBy("recipe", "fixes").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
              .withColumn("list_hash", F.xxhash64("recipe", "fixes")))
    return (rows.join(groups, key)
            .select("doc_id", "keep_id", "group_size", "text_sha256", F.size("recipe").alias("n_chunks"),
                    F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    "text_sha256", "n_chunks"))
