"""Document probability from a subword lattice.

Vocabulary: the pieces of an existing tokenizer model, whose scores rank them.
Piece probabilities are learned from the training text: counts of pieces over
its distinct words, smoothed with a prior that falls with the vocabulary's rank.
A word's probability sums over all its segmentations into pieces, by a forward
recursion in log space. Two further kinds of edge span what the training text
has whole: a word, and a line (absolute discounting: the mass taken from known
words goes to the pieces, that from known lines to their words). Characters
without a piece go by their UTF-8 byte pieces. A line is its words and its end, a
document its lines and its end; the score is the log10 probability of the whole.

The lattice runs once per distinct word. The FREQUENT most common words reach
all tasks by a broadcast of bounded size, the rest by a join on the word, so hot
words are summed where they are read and rare words are spread evenly.

Defined results: null text counts as empty and scores its end alone; words are
runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; rows with crc32(doc_id as
text) mod 10 = 0 are held out of all training; without training rows every word
goes by the prior; repeated rows get the same score once per row; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import WORD, ascii_lower, stage
from cadenza.llm.wordhash import text_batches, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
END = " "                       # no word contains a space
FREQUENT = 200_000              # rows broadcast, at most; longer words than LONG are never among them
LONG = 64
DISCOUNT = 0.75
PRIOR_WEIGHT = 5_000.0
BASE_ADD = 0.1
LOG10 = math.log(10)


class Lattice:
    """Log probabilities of pieces and the marginal over all segmentations of a word."""

    def __init__(self, model: bytes, counts: dict[int, float]):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
        by_score = sorted(ids, key=lambda i: -sp.get_score(i))
        prior = {i: 1.0 / (rank + 10.0) for rank, i in enumerate(by_score)}
        scale = PRIOR_WEIGHT / sum(prior.values())
        total = sum(counts.get(i, 0.0) for i in ids) + PRIOR_WEIGHT
        logp = {i: math.log((counts.get(i, 0.0) + scale * prior[i]) / total) for i in ids}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): logp[i] for i in ids if sp.is_byte(i)}
        self.pieces = {sp.id_to_piece(i): logp[i] for i in ids if not sp.is_byte(i)}
        self.longest = max(map(len, self.pieces))
        self.starts = {p[:i] for p in self.pieces for i in range(1, len(p))}

    def marginal(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of the word with its leading mark."""
        s, get, starts = "▁" + word, self.pieces.get, self.starts
        n = len(s)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            paths = into[i]
            if not paths:
                continue
            top = max(paths)
            here = top if len(paths) == 1 else top + math.log(sum(math.exp(p - top) for p in paths))
            into[i] = []
            for j in range(i + 1, min(n, i + self.longest) + 1):
                part = s[i:j]
                p = get(part)
                if p is not None:
                    into[j].append(here + p)
                elif j == i + 1:
                    into[j].append(here + sum(self.bytes[b] for b in part.encode("utf-8", "replace")))
                if part not in starts:
                    break
        top = max(into[n])
        return top + math.log(sum(math.exp(p - top) for p in into[n]))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def tokens_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(held_out, word) for every word and one END per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_append(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.lit(END))
    return docs.select(held_out(F.col(id_col)).alias("held_out"), F.explode(words).alias("word"))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, line_no, lh, line): th and lh are hashes of the text and of the lower-cased line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"),
                        F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "th", "line_no", F.xxhash64(ascii_lower(F.col("line"))).alias("lh"), "line")


def split_sums(lines: DataFrame, common: list) -> DataFrame:
    """For every line its sums over the common words (rare null), and each of its rare words with its count.

    (doc_id, th, line_no, lh, rare, t, lines, k1, b1, s1). Common words are found by their 64-bit hashes.
    """
    found, _ = word_hashes([" ".join(r["word"] for r in common).encode()])
    order = np.argsort(found)
    keys = np.append(found[order], ~np.uint64(0))
    values = np.array([(r["known"], r["base"], r["score"]) for r in common], dtype=np.float64).reshape(-1, 3)[order]
    shared = lines.sparkSession.sparkContext.broadcast((keys, values))      # FREQUENT rows of four numbers at most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for batch in batches:
            done = 0
            for part in text_batches(batch.column(4).to_pylist()):
                h, at = word_hashes(part)
                place = np.searchsorted(keys[:-1], h)
                known = keys[place] == h
                sums = np.zeros((len(h) + 1, 4))
                sums[:-1][known, 0] = 1
                if len(values):
                    sums[:-1][known, 1:] = values[place[known]]
                per_line = np.zeros((len(part), 4))
                full = np.flatnonzero(at[1:] > at[:-1])
                if len(full):
                    per_line[full] = np.add.reduceat(sums, at[:-1][full], axis=0)
                row, rare, count = list(range(len(part))), [None] * len(part), per_line[:, 0].round().astype(int).tolist()
                unknown = np.flatnonzero(~known)
                of = np.searchsorted(at, unknown, side="right") - 1
                for i in np.unique(of):
                    words = part[i].split()
                    mine = unknown[np.searchsorted(of, i):np.searchsorted(of, i, side="right")]
                    for w, c in Counter(words[j] for j in mine - at[i]).items():
                        row.append(int(i))
                        rare.append(w.decode("utf-8"))
                        count.append(c)
                take = pa.array(np.array(row, dtype=np.int64) + done)
                fill = lambda v, kind: pa.array(np.concatenate([v, np.zeros(len(row) - len(part))]).astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(4)), pa.array(rare, pa.string()), pa.array(count, pa.int64()),
                     fill(np.ones(len(part)), "i8"), fill(per_line[:, 1].round(), "i8"), fill(per_line[:, 2], "f8"),
                     fill(per_line[:, 3], "f8")], ["doc_id", "th", "line_no", "lh", "rare", "t", "lines", "k1", "b1", "s1"])
                done += len(part)

    id_type = lines.schema["doc_id"].dataType.simpleString()
    return lines.mapInArrow(split, f"doc_id {id_type}, th long, line_no int, lh long, rare string, t long, lines long, "
                                   "k1 long, b1 double, s1 double")


def piece_counts(words: DataFrame, model: bytes) -> dict[int, float]:
    """Counts of pieces over the distinct words (c times a word counts as 1 + log c); one row per piece reaches the driver."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        total: Counter[int] = Counter()
        for b in batches:
            found, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for ids, c in zip(sp.encode(found, num_threads=1), counts):
                for i in ids:
                    total[i] += 1 + math.log(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())],
                                         ["piece", "n"])

    rows = words.select("word", "c").mapInArrow(counted, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in rows.collect()}


def word_table(counts: DataFrame, n: int, v: int, ends: int, model: bytes) -> DataFrame:
    """(word, n, known, base, score): log10 probabilities of each distinct token."""
    pieces = piece_counts(counts.where(f"c > 0 AND word <> '{END}'"), model)
    words_n = n - ends
    spare = math.log(DISCOUNT * (v - 1) / words_n) if words_n > 0 and v > 1 else 0.0
    log_all = math.log10(n + BASE_ADD * (v + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model, pieces)
        for b in batches:
            words, train = b.column(0).to_pylist(), b.column(1).to_pylist()
            score = []
            for w, c in zip(words, train):
                if w == END:
                    score.append(0.0)
                    continue
                p = spare + lattice.marginal(w)
                if c:
                    whole = math.log((c - DISCOUNT) / words_n)
                    p = max(p, whole) + math.log1p(math.exp(-abs(p - whole)))
                score.append(p / LOG10)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([int(c > 0) for c in train], pa.int64()),
                 pa.array([math.log10(c + BASE_ADD) - log_all for c in train], pa.float64()), pa.array(score, pa.float64())],
                ["word", "n", "known", "base", "score"])

    return counts.select("word", "c", "n").mapInArrow(scored, "word string, n long, known long, base double, score double")


def common_words(table: DataFrame) -> list:
    """(word, known, base, score) of the words above a count that at most FREQUENT words reach."""
    short = table.where((F.length("word") <= LONG) & (F.col("word") != END)).withColumn("step", F.floor(F.log2("n") * 8))
    steps = {r["step"]: r["count"] for r in short.groupBy("step").count().collect()}      # a few hundred numbers
    least, total = max(steps, default=0) + 1, 0
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > FREQUENT:
            break
        least = step
    return short.where(F.col("step") >= least).select("word", "known", "base", "score").collect()


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    with open(vocabulary, "rb") as f:
        model = f.read()
    tokens = tokens_of(docs, id_col, text_col)
    counts = stage(tokens.groupBy("word").agg(F.sum((~F.col("held_out")).cast("long")).alias("c"), F.count("*").alias("n")))
    all_ = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"),
                      F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    n, v, ends = (all_[k] or 0 for k in ("n", "v", "ends"))
    table = stage(word_table(counts, n, v, ends, model))
    common = common_words(table)
    end = table.where(F.col("word") == END).select("known", "base").first() or (0, 0.0)

    lines = lines_of(docs, id_col, text_col)
    known_lines = stage(lines.where(~held_out(F.col("doc_id"))).groupBy("lh").agg(F.count("*").alias("lc")))
    line_n, line_v = known_lines.agg(F.coalesce(F.sum("lc"), F.lit(0)), F.count("*")).first()
    # log10 chances: a word goes on or the line ends; a line follows or the text ends; a line is new
    word_on, line_end = _two_ways(n - ends, line_n)
    line_on, text_end = _two_ways(max(0, line_n - ends), ends)
    new_line = math.log10(DISCOUNT * line_v / line_n) if line_n else 0.0

    parts = split_sums(lines, common)
    # a sum's own key meets no word (it has a space) and spreads the sums over the partitions
    parts = parts.withColumn("key", F.coalesce("rare", F.concat(F.lit(END), F.col("lh").cast("string"), F.col("line_no").cast("string"))))
    full = parts.join(table.select(F.col("word").alias("key"), "known", "base", "score"), "key", "left")

    def total(name: str, common_sum: str):
        return F.sum(F.when(F.col("rare").isNull(), F.col(common_sum)).otherwise(F.col("t") * F.col(name))) / F.sum("lines")

    # rows that repeat an id and a text were summed together: "lines" counts them
    by_line = full.groupBy("doc_id", "th", "line_no", "lh").agg(
        F.sum("lines").alias("rows"), (F.sum("t") / F.sum("lines")).alias("t"), total("known", "k1").alias("k"),
        total("base", "b1").alias("b"), total("score", "s1").alias("s"))
    by_line = by_line.join(known_lines, "lh", "left")
    spelled = F.col("s") + F.col("t") * F.lit(word_on) + F.lit(line_end + new_line)
    whole = F.log10((F.col("lc") - F.lit(DISCOUNT)) / F.lit(max(1, line_n)))
    most = F.greatest(spelled, whole)
    either = F.when(F.col("lc").isNull(), spelled).otherwise(
        most + F.log10(F.pow(F.lit(10.0), spelled - most) + F.pow(F.lit(10.0), whole - most)))
    sums = by_line.groupBy("doc_id", "th").agg(
        F.max("rows").alias("rows"), F.count("*").alias("lines"), F.sum("t").alias("t"), F.sum("k").alias("k"), F.sum("b").alias("b"),
        F.sum(either).alias("s"))
    return sums.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), (F.round("t") + 1).cast("long").alias("n_tokens"),
        (F.round("k") + F.lit(end[0])).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("b") + F.lit(end[1])).alias("base_score"),
        (F.col("s") + (F.col("lines") - 1) * F.lit(line_on) + F.lit(text_end)).alias("score"))


def _two_ways(a: int, b: int) -> tuple[float, float]:
    """log10 chances of two events seen a and b times."""
    every = a + b + 2 * BASE_ADD
    return math.log10((a + BASE_ADD) / every), math.log10((b + BASE_ADD) / every)
