"""Product codes of vectors by exact integer arithmetic on float64 matrix products.

Components become integers floor(SCALE * x); vectors are cut into equal parts,
each with a codebook. A part's squared distance to an entry is |x|^2 - 2 x.c +
|c|^2 in integers. The dot products are matrix products: integers are split into
limbs so small that every float64 product sum stays below 2^53 and is exact, and
the limb products are recombined in int64. The first least distance wins, so
ties go to the lower index. Blocks whose numbers could leave int64 are computed
with Python integers instead; the results are the same.

A round is one pass over the vectors: tasks add up their parts per entry, Spark
adds the tasks' sums (in decimals, so that no table is too long), and only the
codebooks (parts x entries x part width numbers) come to the driver. Each pass
reads the vectors anew, so nothing of their size is written. Codes and errors
are staged once, since the errors are also summed per label.

Defined results: vectors that are null or hold a null or a non-finite component
are dropped. Of the others the table's width is that of the smallest vec_id (a
null id is the largest; of equal ids the smallest vector) whose length is a
positive multiple of the number of parts; vectors of another width get a null
code and error. Fewer vectors than entries make a smaller codebook. Repeated rows
are coded one by one. Errors and label errors stop at 2^63 - 1; a label none of
whose vectors has a code has a null label error. An empty table gives no rows;
other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_broadcast
from cadenza.staging import Stages

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MAX_LONG = (1 << 63) - 1
BLOCK = 4096                    # vectors per matrix product
MAX_BROADCAST_LABELS = 100_000


def limb_bits(width: int) -> int:
    """Bits per limb such that the sum of ``width`` products of two limbs stays below 2^53."""
    return (53 - max(1, width - 1).bit_length() - 1) // 2


def split_limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """``x`` = sum of limb[i] << (bits * i); all but the last are in [0, 2^bits), the last keeps the sign."""
    limbs = []
    for _ in range(count - 1):
        limbs.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return limbs + [x.astype(np.float64)]


def exact_dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(part, row, entry) dot products of x (part, row, width) and c (part, entry, width), int64, exact.

    The true dot products must be below 2^63.
    """
    bits = limb_bits(x.shape[2])
    counts = [max(1, -(-(int(np.abs(v).max(initial=0)).bit_length() + 1) // bits)) for v in (x, c)]
    turned = np.ascontiguousarray(c.transpose(0, 2, 1))
    out = np.zeros((x.shape[0], x.shape[1], c.shape[1]), dtype=np.int64)
    for i, a in enumerate(split_limbs(x, bits, counts[0])):
        for j, b in enumerate(split_limbs(turned, bits, counts[1])):
            out += np.matmul(a, b).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance), each (part, row); ties to the lower index."""
    top = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if x.shape[2] * top * top < 1 << 62:
        d = (x * x).sum(2)[:, :, None] - 2 * exact_dots(x, c) + (c * c).sum(2)[:, None, :]
    else:
        d = np.stack([((p.astype(object)[:, None, :] - e.astype(object)[None, :, :]) ** 2).sum(2) for p, e in zip(x, c)])
    at = d.argmin(2)
    return at, np.take_along_axis(d, at[:, :, None], 2)[:, :, 0]


def _scaled(column: pa.Array, width: int) -> np.ndarray:
    """(row, width) integers floor(SCALE * x), int64 where they fit, else Python integers."""
    flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE)
    if np.abs(flat).max(initial=0) < 2.0 ** 62:
        return flat.astype(np.int64).reshape(-1, width)
    return np.array([int(v) for v in flat], dtype=object).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their integers as (part, row, part width)) in blocks of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            x = _scaled(rows.column("embedding"), width)
            yield rows, np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2))


def _sums(width: int, parts: int, codebook: np.ndarray):
    """Map step: per task (cell = part * entries + entry, position, sum, count) of the parts nearest to each entry."""
    schema = pa.schema([("cell", pa.int32()), ("position", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])

    def work(batches):
        entries, part_width = codebook.shape[1], width // parts
        total = np.zeros((parts * entries, part_width), dtype=object)
        n = np.zeros(parts * entries, dtype=np.int64)
        for _rows, x in _blocks(batches, width, parts):
            at, _d = nearest(x, codebook)
            cell = (at + np.arange(parts)[:, None] * entries).ravel()
            flat = x.reshape(-1, part_width)
            n += np.bincount(cell, minlength=len(n))
            if flat.dtype != object and int(np.abs(flat).max(initial=0)) * len(flat) < 1 << 53:
                for i in range(part_width):      # whole numbers below 2^53 add up exactly as floats
                    add = np.bincount(cell, weights=flat[:, i].astype(np.float64), minlength=len(n))
                    total[:, i] += add.astype(np.int64).astype(object)
            else:
                np.add.at(total, cell, flat.astype(object))
        used = np.repeat(np.flatnonzero(n), part_width)
        if len(used):
            position = np.tile(np.arange(part_width), len(used) // part_width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(position, pa.int32()),
                 pa.array([Decimal(int(total[c, i])) for c, i in zip(used, position)], pa.decimal128(38, 0)),
                 pa.array(n[used], pa.int64())], schema=schema)

    return work, "cell int, position int, total decimal(38,0), n long"


def train(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, part width) after ``rounds`` from the ``entries`` smallest vec_ids of ``vectors``."""
    first = (vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
             .limit(entries).collect())          # a parameter bounds these rows
    x = _scaled(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width)
    codebook = np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        work, ddl = _sums(width, parts, codebook)
        rows = (vectors.select("embedding").mapInArrow(work, ddl).groupBy("cell", "position")
                .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())   # codebook-sized
        new = codebook.astype(object)
        for r in rows:
            new[r["cell"] // codebook.shape[1], r["cell"] % codebook.shape[1], r["position"]] = int(r["total"]) // r["n"]
        big = max((abs(v) for v in new.ravel().tolist()), default=0)
        codebook = new.astype(np.int64) if big < 1 << 62 else new
    return codebook


def codebooks_sha256(codebook: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in codebook.ravel().tolist()).encode()).hexdigest()


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, embedding (double) of the rows whose vector and components are all there and finite."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.where(x.isNotNull()).where(~bad).select("vec_id", "label", "embedding")


def code_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (two hex digits per part), error, label_error, codebooks_sha256 of every kept vector."""
    if entries > 256:
        raise ValueError("an index is two hex digits: at most 256 entries")
    kept = kept_vectors(embeddings)
    fits = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    head = (kept.where(fits).orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
            .select(F.size("embedding").alias("width")).first())
    width = head["width"] if head else parts
    fits = F.size("embedding") == width
    vectors = kept.where(fits)
    codebook = train(vectors, width, parts, entries, rounds) if head else np.zeros((parts, 0, 1), dtype=np.int64)
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def work(batches):
        for rows, x in _blocks(batches, width, parts):
            at, d = nearest(x, codebook)
            codes = ["".join(f"{v:02x}" for v in c) for c in at.T.tolist()]
            error = d.astype(object).sum(0).tolist() if d.dtype == object or int(d.max(initial=0)) >= (1 << 62) // parts else d.sum(0).tolist()
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), pa.array(codes, pa.string()),
                 pa.array([min(int(v), MAX_LONG) for v in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = vectors.mapInArrow(work, f"vec_id {id_type}, label {label_type}, code string, error long")
    other = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"),
                                     F.lit(None).cast("long").alias("error"))
    coded = Stages(embeddings.sparkSession, "vector-codes").keep(coded.unionByName(other))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(total.isNotNull(), F.least(total, F.lit(MAX_LONG).cast("decimal(38,0)"))).cast("long")
    labels = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_of")
    labels = bounded_broadcast(labels, MAX_BROADCAST_LABELS)
    return (coded.join(labels, F.col("label").eqNullSafe(F.col("_of")), "left")
            .select("vec_id", "label", "code", "error", "label_error",
                    F.lit(codebooks_sha256(codebook)).alias("codebooks_sha256")))
