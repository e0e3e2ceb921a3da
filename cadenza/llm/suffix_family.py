"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes if some LENGTH-byte string that covers it also starts elsewhere.
Sorting every suffix of a corpus moves far more than the corpus, so suffixes are
sampled by content: of the CORE-byte strings in a LENGTH-byte window the one with
the least fingerprint is its anchor (the last of equals). Equal windows have equal
anchors at the same distance, so every repeat of LENGTH bytes is seen at anchors
alone, and about one suffix in 60 is kept. A sampled suffix has a ``core``
(fingerprint of its first CORE bytes) and a ``context``: all bytes of the windows
that chose it.

* ``SuffixFamily``: a new batch is made a suffix array, a table sorted by (core,
  context) with the number of places (1, or 2 for more). It is merge-scanned
  against every level there is, which gives the cores that both hold; equal-sized
  levels are merged, so n batches leave at most log2(n) + 1 levels and a suffix is
  rewritten at most log2(n) times. The family is a folder and can be opened again.
* ``repeated_spans`` compares the suffixes under a shared core.
  1. An anchor whose context is found twice: all its windows repeat.
  2. Else its windows are cut into blocks of BLOCK starts. All windows of a block
     share LENGTH - BLOCK + 1 bytes; their fingerprint groups the blocks, and the
     few bytes on both sides, carried as numbers, tell their windows apart.
  3. Blocks that share the middle but not the sides are compared window by window.
  Only the second step returns to the texts; groups are never gathered, all is
  counted by aggregates with partial sums, and a window is looked at only where
  a repeat begins or ends.
* ``remove_repeats`` cuts the spans out.

Fingerprints have 64 bits each, and two independent ones (of different strings)
must agree for an error. Texts are known by 128 bits of their SHA-256, so equal
texts share their spans.

Defined results: a null text is empty; texts shorter than LENGTH stay; ties and
repeated rows are repeats of each other and go alike (a text that occurs twice
loses every byte if it has LENGTH bytes); an empty table gives no rows; other
columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.bytehash import Fingerprints, anchors, scramble
from cadenza.staging import Stages

LENGTH, CORE, BLOCK = 200, 64, 8
SIDE = BLOCK - 1                # bytes on either side of a block's common middle
BATCHES = 4
BATCH_BYTES = 500_000           # a piece's arrays take about 100 times that; its power tables those of 1 << 19 bytes
BATCH_ROWS = 1000               # rows of an Arrow batch that are Python objects at a time
MAX_BROADCAST_BYTES = 8 << 20
REF = ["ref_a", "ref_b"]
_REF = "ref_a long, ref_b long"


def text_ref(text: Column) -> list[Column]:
    """128 bits of a text's SHA-256 as two longs."""
    sha = F.sha2(F.encode(text, "UTF-8"), 256)
    return [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long").alias(REF[i]) for i in range(2)]


def _pieces(column_lists: Iterator[tuple], texts_at: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, their bytes one after the other, offsets) in pieces of about BATCH_BYTES."""
    rows, size = [], 0
    for row in column_lists:
        rows.append(row)
        size += len(row[texts_at])
        if size >= BATCH_BYTES:
            yield _joined(rows, texts_at)
            rows, size = [], 0
    if rows:
        yield _joined(rows, texts_at)


def _joined(rows: list, texts_at: int) -> tuple[list, np.ndarray, np.ndarray]:
    offsets = np.cumsum([0] + [len(r[texts_at]) for r in rows])
    return rows, np.frombuffer(b"".join(r[texts_at] for r in rows), dtype=np.uint8), offsets


def _arrow_rows(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            columns = [c.to_pylist() for c in batch.slice(at, BATCH_ROWS).columns]
            columns[text] = [(t or "").encode("utf-8", "replace") for t in columns[text]]
            yield from zip(*columns)


def _sampled(raw: np.ndarray, offsets: np.ndarray) -> tuple[Fingerprints, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, text, first window, last window, anchor) of every anchor of a piece."""
    prints = Fingerprints(raw)
    chosen = anchors(prints, LENGTH, CORE)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:len(chosen)] == owner[LENGTH - 1:LENGTH - 1 + len(chosen)]
    goes_on = np.concatenate([[False], inside[1:] & inside[:-1] & (chosen[1:] == chosen[:-1])
                              & (owner[1:len(chosen)] == owner[:len(chosen) - 1])]) if len(chosen) else inside
    first = np.flatnonzero(inside & ~goes_on)
    last = np.flatnonzero(inside & ~np.concatenate([goes_on[1:], [False]])) if len(chosen) else first
    return prints, owner[first], first, last, chosen[first]


def _fingerprint_columns(prints, first, last, q) -> tuple[np.ndarray, np.ndarray]:
    core = prints.of(q, q + CORE)
    shape = ((q - first) << 16 | (last - first)).astype(np.uint64)
    return core.view(np.int64), scramble(prints.of(first, last + LENGTH, 1) ^ scramble(shape)).view(np.int64)


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _rows, raw, offsets in _pieces(_arrow_rows(batches, 0), 0):
        prints, _owner, first, last, q = _sampled(raw, offsets)
        core, context = _fingerprint_columns(prints, first, last, q)
        yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(context)], names=["core", "context"])


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """core, context, ref and place (anchor << 16 | anchor - first << 8 | windows - 1) of every sampled suffix."""
    for rows, raw, offsets in _pieces(_arrow_rows(batches, 2), 2):
        prints, owner, first, last, q = _sampled(raw, offsets)
        core, context = _fingerprint_columns(prints, first, last, q)
        refs = [np.array([r[i] for r in rows], dtype=np.int64)[owner] for i in range(2)]
        place = (q - offsets[owner]) << 16 | (q - first) << 8 | (last - first)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (core, context, *refs, place)],
                                         names=["core", "context", *REF, "place"])


def suffix_array(texts: DataFrame) -> DataFrame:
    """(core, context, n) of the sampled suffixes of ``texts`` (one column), sorted within partitions; n is 1, or 2 for more."""
    rows = texts.mapInArrow(_suffix_rows, "core long, context long")
    return _merge(rows.withColumn("n", F.lit(1)))


def _merge(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("core", "context").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"))
            .sortWithinPartitions("core", "context"))


class SuffixFamily:
    """Levels of suffix arrays in a folder: level k holds about 2^k batches. ``shared``: the cores seen more than once."""

    def __init__(self, spark: SparkSession, name: str = "suffix-family"):
        self.stages = Stages(spark, name)
        self.levels: dict[int, DataFrame] = {}
        self._shared: list[DataFrame] = []

    def add(self, texts: DataFrame, last: bool = False) -> DataFrame:
        """Take a batch of texts in. Returns the cores that the batch shares within itself or with a level.

        With ``last`` the levels are left as they are, since nothing follows that would use a merged one.
        """
        new = self.stages.keep(suffix_array(texts))
        hits = new.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core")
        mine = new.select("core").distinct()
        for level in self.levels.values():
            hits = hits.unionByName(mine.join(level.select("core").distinct(), "core", "left_semi"))
        hits = self.stages.keep(hits.distinct())
        self._shared.append(hits)
        rank = 0
        while not last and rank in self.levels:
            old = self.levels.pop(rank)
            merged = self.stages.keep(_merge(old.unionByName(new)))
            self.stages.drop(old, new)
            new, rank = merged, rank + 1
        while rank in self.levels:
            rank += 1
        self.levels[rank] = new
        return hits

    def shared(self) -> DataFrame:
        """Cores that more than one place of the family has."""
        return self.stages.together(self._shared).distinct()

    def contexts(self) -> DataFrame:
        """(core, context, n, contexts) under the shared cores: places of the context (2: more), contexts of the core."""
        rows = self.stages.together(list(self.levels.values())).join(self.shared(), "core", "left_semi")
        rows = self.stages.keep(rows.groupBy("core", "context").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n")))
        per_core = rows.groupBy("core").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("contexts"))
        return rows.join(per_core, "core")


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of windows of the places listed for a text: (core, middle, left, right, shape, n, ref, anchor)."""
    for rows, raw, offsets in _pieces(_arrow_rows(batches, 2), 2):
        prints = Fingerprints(raw)
        n_places = [len(r[3]) for r in rows]
        owner = np.repeat(np.arange(len(rows)), n_places)
        place = np.array([p for r in rows for p in r[3]], dtype=np.int64)
        times = np.array([x for r in rows for x in r[4]], dtype=np.int64)
        core = np.array([x for r in rows for x in r[5]], dtype=np.int64)
        q = (place >> 16) + offsets[owner]
        most = (place >> 8) & 255                 # distance from the first window's start to the anchor
        least = most - (place & 255)
        blocks = most // BLOCK - least // BLOCK + 1
        k = np.repeat(np.arange(len(q)), blocks)
        j = np.arange(len(k)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + (least // BLOCK)[k]
        from_, to = np.maximum(least[k] - BLOCK * j, 0), np.minimum(most[k] - BLOCK * j, SIDE)   # distances in the block
        start = q[k] - BLOCK * j                  # the middle: bytes of every window of the block
        end = start - SIDE + LENGTH
        left, right = np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=np.int64)
        for i in range(SIDE):
            near = np.clip(start - 1 - i, 0, len(raw) - 1)
            left |= np.where(i < to, raw[near].astype(np.int64), 0) << (8 * i)
            near = np.clip(end + i, 0, len(raw) - 1)
            right |= np.where(i < SIDE - from_, raw[near].astype(np.int64), 0) << (8 * i)
        refs = [np.array([r[i] for r in rows], dtype=np.int64)[owner][k] for i in range(2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (core[k], prints.of(start, end, 1).view(np.int64), left, right,
                                   j << 8 | from_ << 4 | to, times[k], *refs, place[k] >> 16)],
            names=["core", "middle", "left", "right", "shape", "n", *REF, "anchor"])


_BLOCKS = f"core long, middle long, left long, right long, shape long, n long, {_REF}, anchor long"


def _span(first: Column, last: Column) -> list[Column]:
    """Bytes of the windows that start from ``first`` to ``last``."""
    return [*REF, first.cast("long").alias("start"), (last + LENGTH).cast("long").alias("end")]


def repeated_spans(docs: DataFrame, family: SuffixFamily) -> DataFrame:
    """(ref_a, ref_b, start, end): bytes that go, by text; ``docs`` has ref_a, ref_b, text and is all that was added."""
    keep = family.stages.keep
    places = docs.mapInArrow(_place_rows, f"core long, context long, {_REF}, place long")
    places = keep(places.join(family.contexts(), ["core", "context"]))
    anchor, before, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    whole = places.where("n > 1").select(*_span(anchor - before, anchor - before + more))

    # one place of every context under a core that has several; a context with one place is that place
    one = (places.where("contexts > 1").groupBy("core", "context")
           .agg(F.min(F.struct(*REF, "place")).alias("p"), F.max("n").alias("n")))
    lists = one.groupBy(F.col("p.ref_a").alias("ref_a"), F.col("p.ref_b").alias("ref_b")).agg(
        F.collect_list(F.struct("p.place", F.col("n").cast("long").alias("n"), "core")).alias("l"))
    lists = lists.select(*REF, F.col("l.place").alias("places"), F.col("l.n").alias("times"), F.col("l.core").alias("cores"))
    blocks = keep(docs.join(lists, REF).mapInArrow(_block_rows, _BLOCKS))

    middle, side = ["core", "middle", F.shiftright("shape", 8).alias("j")], ["core", "middle", "left", "right", "shape"]
    kinds = keep(blocks.groupBy(*side).agg(F.least(F.sum("n"), F.lit(2)).alias("all"),
                                           F.min(F.struct(*REF, "anchor")).alias("p")))
    j, low, high = F.shiftright("shape", 8) * BLOCK, F.shiftright("shape", 4).bitwiseAND(15), F.col("shape").bitwiseAND(15)
    again = kinds.where("all > 1").select(*side)
    block = (blocks.where("n = 1").join(again, side, "left_semi")
             .select(*_span(F.col("anchor") - j - high, F.col("anchor") - j - low)))

    several = kinds.groupBy(*middle).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    windows = (kinds.withColumn("j", F.shiftright("shape", 8)).join(several, ["core", "middle", "j"], "left_semi")
               .withColumn("d", F.explode(F.sequence(low, high)))
               # a window at distance d has d of the bytes on the left and the rest of the side on the right
               .withColumn("left", F.expr("left & (shiftleft(1L, cast(8 * d as int)) - 1)"))
               .withColumn("right", F.expr(f"right & (shiftleft(1L, cast(8 * ({SIDE} - d) as int)) - 1)")))
    window = ["core", "middle", "j", "d", "left", "right"]
    windows = keep(windows.select(*window, "all", "p"))
    twice = windows.groupBy(*window).agg(F.sum("all").alias("s")).where("s > 1").drop("s")
    at = F.col("p.anchor") - F.col("j") * BLOCK - F.col("d")
    single = (windows.where("all = 1").join(twice, window, "left_semi")
              .select("p.ref_a", "p.ref_b", at.alias("at")).select(*_span(F.col("at"), F.col("at"))))
    return whole.unionByName(block).unionByName(single)


def _united_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ref, starts and ends of the maximal spans from lists of spans that may overlap."""
    for batch in batches:
        out = []
        for a, b, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
            spans: list[list[int]] = []
            for s, e in sorted(zip(starts, ends)):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            out.append((a, b, [s for s, _e in spans], [e for _s, e in spans]))
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, types)],
                                         names=[*REF, "starts", "ends"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
            raw = (text or "").encode("utf-8", "replace")
            spans = list(zip(starts or [], ends or []))
            cuts = [0, *(x for span in spans for x in span), len(raw)]
            rest = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            out.append((doc_id, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(),
                        starts or [], ends or []))
        columns = list(zip(*out)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (starts, ends in bytes).

    The documents enter the family in ``batches`` batches dealt by a hash of their texts.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", *text_ref(F.col("text")), "text")
    long_texts = docs.where(F.octet_length("text") >= LENGTH).select(*REF, "text")
    texts = documents.select(text.alias("text")).where(F.octet_length("text") >= LENGTH)
    family = SuffixFamily(spark)
    for i in range(batches):
        family.add(texts.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == i), last=i == batches - 1)
    spans = repeated_spans(long_texts, family).groupBy(*REF).agg(F.collect_set(F.struct("start", "end")).alias("s"))
    spans = spans.select(*REF, F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    spans = family.stages.keep(spans.mapInArrow(_united_rows, f"{_REF}, starts array<long>, ends array<long>"))
    size = spans.agg(F.sum(40 + 16 * F.size("starts"))).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES:
        spans = F.broadcast(spans)
    return docs.join(spans, REF, "left").select("doc_id", "text", "starts", "ends").mapInArrow(
        _cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
