"""Benchmark decontamination with spaced-seed hashing (DataFrame functions only).

Words are lower-cased runs of letters and digits; in scripts written without
spaces every letter is a word. A spaced seed hashes the words at a mask's offsets
and ignores those between. The two masks are such that in any WINDOW consecutive
word positions of which up to SUBSTITUTIONS differ, at least one placement of one
mask meets equal words only. Items of fewer words have masks of their own: cut
into parts, two of which are whole however the words that may differ lie, or all
words where none may differ (a test enumerates all cases). So no overlap that the
check accepts is missed; only masks that the benchmark's lengths need are placed
on the documents. Seeds of all documents
are joined with the benchmark's seeds; every hit fixes an alignment of document
and item, along which the words themselves are compared. Where none may differ,
the seed is all of the item's words and travels with them, so the join itself
compares them: nothing is joined back, and of an item's places in a document only
the last leaves the task, however common its words are.

A document is contaminated by an item if some alignment has WINDOW consecutive
item words (or the whole item, if it has fewer) of which at most a fifth (2 of 13)
differ; of items with fewer than FUZZY_WORDS words none may differ.

Defined results: null or empty texts match nothing; an item of one word is found
wherever the word is; repeated rows and items are each reported under their id; rows with a null id are judged too; an empty table on
either side gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_broadcast, let, stage

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW = 13
SUBSTITUTIONS = 2
FUZZY_WORDS = 9
#: the plain range comes first, since looking up the script of every letter is slow
UNSPACED = r"[\x{E00}-\x{3FFFF}&&[%s]]" % "".join(r"\p{Is%s}" % x for x in "Han Hiragana Katakana Thai Lao Khmer Myanmar".split())
MAX_BROADCAST_SEEDS = 2_000_000         # rows of four numbers
MAX_BROADCAST_HITS = 1_000_000


def may_differ(n: int) -> int:
    """Most words that may differ in the window of an item of n words."""
    return min(n, WINDOW) // 5 if n >= FUZZY_WORDS else 0


def short_placements(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(position, mask) of the seeds of an item of n < WINDOW words."""
    parts = may_differ(n) + 2 if may_differ(n) else 1
    cuts = [round(i * n / parts) for i in range(parts + 1)]
    kept = [[i for p in two for i in range(cuts[p], cuts[p + 1])] for two in combinations(range(parts), min(2, parts))]
    return [(at[0], tuple(i - at[0] for i in at)) for at in kept]


SHORT = {n: short_placements(n) for n in range(1, WINDOW)}
ALL_MASKS = MASKS + tuple(sorted({m for placed in SHORT.values() for _, m in placed} - set(MASKS)))
#: item length, mask and position of every seed of a short item, in one number
SHORT_SEEDS = [(n * 100 + ALL_MASKS.index(m)) * 100 + at for n, placed in SHORT.items() for at, m in placed]


def words_of(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"({UNSPACED})", " $1 ")
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds_of(words: Column, masks: list[int]) -> Column:
    """All seeds in order: the k-th mask at position i is element i * len(masks) + k; null where a mask would pass the end."""
    def seed(h: Column, i: Column, m: int) -> Column:
        offsets = ALL_MASKS[m]
        inside = i + F.lit(offsets[-1]) < F.size(h)
        return F.when(inside, F.xxhash64(F.lit(m), *[F.get(h, i + F.lit(o)) for o in offsets]))

    def seeds(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - F.lit(1))
        both = F.flatten(F.transform(at, lambda i: F.array(*[seed(h, i, m) for m in masks])))
        return F.when(F.size(h) > 0, both).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), seeds)


def _seed_rows(df: DataFrame, words: str, keys: list[str], prefix: str, masks: list[int]) -> DataFrame:
    rows = df.select(*keys, F.posexplode(seeds_of(F.col(words), masks)).alias("_p", "seed")).where("seed IS NOT NULL")
    mask = F.get(F.lit(masks), (F.col("_p") % len(masks)).cast("int"))
    return rows.select(*keys, "seed", F.floor(F.col("_p") / len(masks)).cast("int").alias(f"{prefix}_at"), mask.alias("mask"))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, seed, item_at, mask): both masks everywhere for items of WINDOW words or more, its own placements for a shorter one."""
    sized = items.withColumn("n", F.size("item_words"))
    long = _seed_rows(sized.where(F.col("n") >= WINDOW), "item_words", ["item_id", "n"], "item", list(range(len(MASKS))))
    short = _seed_rows(sized.where(F.col("n") < WINDOW), "item_words", ["item_id", "n"], "item", list(range(len(ALL_MASKS))))
    short = short.where(((F.col("n") * 100 + F.col("mask")) * 100 + F.col("item_at")).isin(SHORT_SEEDS))
    return long.unionByName(short).drop("n")


def _verbatim(tagged: DataFrame, items: DataFrame) -> DataFrame:
    """One row (as ``contaminated``) per document and item of under FUZZY_WORDS words that it holds; the last place counts."""
    wanted = items.select("item_id", "n", F.concat_ws(" ", "item_words").alias("gram")).withColumn("seed", F.xxhash64("gram"))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())      # FUZZY_WORDS - 1 at most

    def grams(ws: Column) -> Column:
        def of_length(n: int) -> Column:
            places = F.transform(F.sequence(F.lit(0), F.size(ws) - F.lit(n)), lambda i: F.struct(
                i.alias("doc_at"), F.concat_ws(" ", F.slice(ws, i + F.lit(1), F.lit(n))).alias("gram")))
            return F.when(F.size(ws) >= n, places).otherwise(F.array().cast("array<struct<doc_at:int,gram:string>>"))
        return F.concat(*[of_length(n) for n in lengths])

    held = tagged.select("doc_id", "th", F.explode(let(F.col("words"), grams)).alias("g")).select("doc_id", "th", "g.*")
    held = held.withColumn("seed", F.xxhash64("gram"))
    return (held.join(bounded_broadcast(wanted, MAX_BROADCAST_HITS, F.octet_length("gram") + F.lit(32)), ["seed", "gram"])
            .groupBy("doc_id", F.col("th").alias("text_hash"), "item_id").agg(F.max("doc_at").alias("doc_at"), F.max("n").alias("n"))
            .select("doc_id", "text_hash", "item_id", F.col("n").alias("equal_words"), F.col("n").alias("window_words"), "doc_at",
                    F.lit(0).alias("item_at")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: doc_id, text_hash, item_id, and equal_words, window_words,
    doc_at, item_at (word positions) of their best window."""
    given = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("item_words"))
    items = stage(given.withColumn("n", F.size("item_words")).where("n > 0"))
    fuzzy, exact = items.where(F.col("n") >= FUZZY_WORDS).drop("n"), items.where(F.col("n") < FUZZY_WORDS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    # the text's hash tells rows with one id apart; hits are few, so their words are made again from the text
    tagged = rows.select("doc_id", F.xxhash64("t").alias("th"), words_of(F.col("t")).alias("words"))
    if not exact.isEmpty():
        verbatim = _verbatim(tagged, exact)
        return verbatim if fuzzy.isEmpty() else _aligned(tagged, fuzzy).unionByName(verbatim)
    return _aligned(tagged, fuzzy)


def _aligned(tagged: DataFrame, items: DataFrame) -> DataFrame:
    """One row (as ``contaminated``) per document and item of FUZZY_WORDS words or more that overlap."""
    item_seeds = stage(_item_seeds(items))
    masks = sorted(r["mask"] for r in item_seeds.select("mask").distinct().collect()) or [0]     # at most len(ALL_MASKS)
    hits = stage(_seed_rows(tagged, "words", ["doc_id", "th"], "doc", masks).drop("mask")
                 .join(bounded_broadcast(item_seeds.drop("mask"), MAX_BROADCAST_SEEDS), "seed")
                 .select("doc_id", "th", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct())
    shifts = hits.select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"), "item_id", "shift")
    pairs = tagged.join(bounded_broadcast(shifts, MAX_BROADCAST_HITS),
                        F.col("doc_id").eqNullSafe(F.col("h_id")) & F.col("th").eqNullSafe(F.col("h_th")))
    item_bytes = F.octet_length(F.concat_ws(" ", "item_words")) + F.lit(16) * F.size("item_words")
    at_item = pairs.join(bounded_broadcast(items, MAX_BROADCAST_HITS, item_bytes), "item_id")
    n = F.least(F.size("item_words"), F.lit(WINDOW))
    # 1 where the document has the item's word along the alignment; 0 elsewhere and outside the document
    along = let(F.col("words"), lambda ws: F.transform("item_words", lambda w, j: F.when(
        (F.col("shift") + j >= 0) & (F.get(ws, F.greatest(F.col("shift") + j, F.lit(0))) == w), 1).otherwise(0)))
    starts = F.sequence(F.lit(0), F.size("item_words") - F.col("n"))
    windows = let(F.col("same"), lambda same: F.array_max(F.transform(starts, lambda s: F.struct(
        F.aggregate(F.slice(same, s + F.lit(1), F.col("n")), F.lit(0), lambda a, x: a + x).alias("equal_words"),
        (-s).alias("back")))))
    best = (at_item.withColumn("n", n).withColumn("same", along)
            .withColumn("best", windows)
            .where((F.col("n") - F.col("best.equal_words")) * 5 <= F.col("n")))
    found = best.select("doc_id", F.col("th").alias("text_hash"), "item_id", F.struct(
        "best.equal_words", (F.col("shift") - F.col("best.back")).alias("doc_at"), (-F.col("best.back")).alias("item_at"),
        F.col("n").alias("window_words")).alias("b"))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.max("b").alias("b")).select(
        "doc_id", "text_hash", "item_id", "b.equal_words", "b.window_words", "b.doc_at", "b.item_at")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap an item; all columns kept."""
    bad = contaminated(docs, benchmark, id_col, text_col).select("doc_id", "text_hash").distinct()
    bad = bounded_broadcast(stage(bad), MAX_BROADCAST_HITS)
    row = F.struct("*").alias("_row")
    keyed = docs.select(row, F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"))
    return keyed.join(bad, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("text_hash")), "left_anti").select("_row.*")
