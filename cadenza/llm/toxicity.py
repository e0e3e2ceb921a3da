"""Toxicity by compression distance: two zstandard dictionaries, window by window.

The ordinary dictionary is trained on windows of ordinary text. The toxic one is
trained on the wording that marks toxic text and is laid in front of the same
ordinary content, so a window is coded alike under both unless the toxic part
explains some of it; the bytes saved are the window's gain. A document's score
is a logistic function of how many of its windows gain how much, fitted on
labelled documents that no dictionary has seen.

Wording is counted in distinct contexts (word with both neighbours), so that a
text copied a thousand times counts once. How common wording has to be is chosen
on the calibration documents.

Labels are learned only from rows with crc32(doc_id as text) mod 3 <> 1, of which
a bounded sample is used: about MAX_LABELLED documents of each label, chosen by a
hash of the id. Scoring covers every window of every text.

Defined results: null text counts as empty; an empty text gets the score of a
document without gains; several labels of one document: the largest counts, null
labels are ignored; a document without label is only scored; without labels of
both kinds every score is 0; repeated rows score alike; an empty table gives no
rows. Only the text enters a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import WORD, ascii_lower, let, stage

MAX_LABELLED = 20_000            # documents of each label, about
MAX_WINDOWS = 20_000             # ordinary windows that train the ordinary dictionary
MAX_MARKS = 4_000                # words that train the toxic dictionary
ORDINARY_BYTES, TOXIC_BYTES = 1 << 16, 1 << 14
WINDOW_BYTES = 56
CONTRAST = 20.0                  # times as common in toxic text
LEAST_SHARES = (0.005, 0.01, 0.02, 0.04)   # contexts for each toxic document: tried on calibration documents
GAINS = (1, 2, 3, 4, 6)
THRESHOLD = 0.7
_WINDOW = re.compile(rb"[^ ].{0,%d}[^ ]{0,200}" % WINDOW_BYTES, re.S)
_PARTS = 5                       # one part in five of the labelled sample calibrates


def windows(text: str | None) -> list[bytes]:
    """The whole text, lower-cased, spaces folded, in windows that end with a word."""
    return _WINDOW.findall(b" ".join((text or "").lower().encode("utf-8", "replace").split()))


class Model:
    """Dictionary contents and logistic weights; small enough to ship with every task."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: list[float] | None = None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def coders(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def coder(content: bytes) -> zstandard.ZstdCompressor:
            params = zstandard.ZstdCompressionParameters(
                compression_level=3, min_match=3, strategy=zstandard.STRATEGY_GREEDY, window_log=18, hash_log=17,
                chain_log=17, search_log=4, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False,
                write_checksum=False, write_dict_id=False)
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=words, compression_params=params)

        return coder(self.ordinary), coder(self.toxic + self.ordinary)

    def features(self, text: str | None, coders) -> list[float]:
        plain, toxic = coders
        cut = windows(text)
        gains = [len(plain.compress(w)) - len(toxic.compress(w)) for w in cut]
        return [*(float(np.log1p(sum(g >= t for g in gains))) for t in GAINS), max(gains, default=0) / 4.0,
                float(np.log1p(len(cut)))]

    def score(self, features: list[list[float]]) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), np.asarray(features, dtype=float).reshape(len(features), -1)])
        return 1 / (1 + np.exp(-np.clip(x @ np.asarray(self.weights), -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, toxic, weight, part): the bounded training sample; equal texts once."""
    known = (labels.select("doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL")
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
             .where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1"))
    known = stage(known.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)))
    shares = {r["toxic"]: min(1.0, MAX_LABELLED / r["n"]) for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return known.select("doc_id", F.lit("").alias("text"), "toxic", "u", F.lit(0).alias("part")).limit(0)
    share = F.when(F.col("toxic") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    chosen = known.where(F.col("u") < share).select("doc_id", "toxic", (1 / share).alias("weight"))
    # about 2 * MAX_LABELLED rows of three numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")
    return (rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(_PARTS)).cast("int"))
            .groupBy("text", "toxic", "part").agg(F.min("doc_id").alias("doc_id"), F.min("weight").alias("weight")))


def marking_words(fit: DataFrame, n_toxic: float, n_ordinary: float) -> list[tuple[str, int]]:
    """Words far more common in toxic text, with their distinct contexts there; MAX_MARKS at most."""
    words = F.concat(F.array(F.lit("")), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), F.array(F.lit("")))
    threes = let(words, lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.struct(
        F.get(ws, i).alias("word"), F.xxhash64(F.get(ws, i - 1), F.get(ws, i + 1)).alias("context"))))
    seen = fit.select("toxic", F.explode(threes).alias("t")).select("toxic", "t.*").where("word <> ''").distinct()
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    least = max(3, min(LEAST_SHARES) * n_toxic)
    contrast = (F.col("t") + 0.5) / n_toxic >= CONTRAST * (F.col("o") + 0.5) / n_ordinary
    top = counts.where((F.col("t") >= least) & contrast).orderBy(F.desc("t"), "word").limit(MAX_MARKS)
    return [(r["word"], r["t"]) for r in top.collect()]


def trained_content(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; the samples themselves where they are too few to train on."""
    plain = b" ".join(dict.fromkeys(samples))
    if len(plain) <= size:
        return plain
    return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit dictionaries and weights on the labelled sample; None without labels of both kinds."""
    sample = stage(labelled_sample(docs, labels, id_col, text_col))
    fit = sample.where(f"part < {_PARTS - 1}")
    n = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    marks = marking_words(fit, n[1], n[0])

    def some_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                cut, seed = windows(text), zlib.crc32(text.encode("utf-8", "replace"))
                out += [cut[(seed + j * 104729) % len(cut)] for j in range(4) if cut]
            yield pd.DataFrame({"w": out})

    share = min(1.0, MAX_WINDOWS / (4 * n[0]))
    ordinary = (fit.where("toxic = 0").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
                .select("text").mapInPandas(some_windows, "w binary").orderBy("w").limit(2 * MAX_WINDOWS))
    plain = trained_content([bytes(r["w"]) for r in ordinary.collect()], ORDINARY_BYTES)
    tried = []
    for least in LEAST_SHARES:
        words = [(w, t) for w, t in marks if t >= max(3, least * n[1])]
        content = trained_content([f" {w} ".encode() for w, t in reversed(words)], TOXIC_BYTES)
        if content not in [m.toxic for m in tried]:
            tried.append(Model(plain, content))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders = [m.coders() for m in tried]
        for b in batches:
            f = [[v for m, c in zip(tried, coders) for v in m.features(t, c)] for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "weight": b["weight"], "f": f})

    rows = (sample.where(f"part = {_PARTS - 1}").select("text", "toxic", "weight")
            .mapInPandas(measured, "toxic int, weight double, f array<double>").collect())     # numbers of the bounded sample
    rows.sort(key=lambda r: (r["toxic"], r["weight"], r["f"]))
    if len({r["toxic"] for r in rows}) < 2:
        return None
    y, w = np.array([float(r["toxic"]) for r in rows]), np.array([r["weight"] for r in rows])
    width, best = len(GAINS) + 2, (np.inf, tried[0])
    for i, m in enumerate(tried):
        x = np.array([r["f"][i * width:(i + 1) * width] for r in rows])
        m.weights = fit_logistic(x, y, w).tolist()
        p = np.clip(m.score(x.tolist()), 1e-6, 1 - 1e-6)
        loss = -float(np.sum(w * (y * np.log(p) + (1 - y) * np.log(1 - p))))
        best = min(best, (loss, m), key=lambda b: b[0])
    return best[1]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = add_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), docs, labels, id_col, text_col)
    return scored.select("doc_id", F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1").alias("held_out"),
                         "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def add_score(df: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              scored_col: str = "text") -> DataFrame:
    """``df`` with ``score`` of its column ``scored_col``, by a model trained on ``docs`` and ``labels``."""
    model = train(docs, labels, id_col, text_col)
    if model is None:
        return df.withColumn("score", F.lit(0.0))

    @F.pandas_udf("double")
    def toxic_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coders = model.coders()
        for texts in batches:
            yield pd.Series(model.score([model.features(t, coders) for t in texts]) if len(texts) else [], dtype="float64")

    return df.withColumn("score", toxic_score(F.col(f"`{scored_col}`")))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches THRESHOLD; all columns kept."""
    keyed = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    return add_score(keyed, docs, labels, id_col, text_col, "text").where(F.col("score") < THRESHOLD).select("_row.*")
