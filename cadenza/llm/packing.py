"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts are encoded with an existing byte-level vocabulary, each followed by the
end-of-text id. A task packs pools of about POOL_TOKENS tokens, so its memory is
bounded and nothing is shuffled: documents longer than a row are cut, without
loss, into full rows and a rest; the rests go, longest first, into the row with
the least room that still holds them. A segment tree over room sizes finds it in
log(seq_len) steps.

One output row is one line of the id matrix: ``ids`` (little-endian unsigned
integers, 2 or 4 bytes each, padded to seq_len), ``cu_seqlens`` (0 and the end of
every segment), ``position_resets`` (columns where positions start again at 0,
the padding's start included), and for each segment its doc_id and its offset in
that document's ids. ``unpack_rows`` is the inverse; ``write_packed`` stores the
rows as Parquet.

Defined results: a null or empty text is an end-of-text id alone; a null id stays
null; repeated rows are packed one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the public pre-tokenisation pattern of this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQ_LEN = 2048
POOL_TOKENS = 1 << 20
# the pattern looks ahead over white space word by word on a stack; longer runs are cut, which loses nothing
LONG_SPACE = re.compile(r"(?s)\s{1024}")


def pieces(text: str) -> list[str]:
    """``text`` cut after every 1,024 characters of one run of white space; joined they are the text."""
    cuts = [0, *(m.end() for m in LONG_SPACE.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


class Rooms:
    """Rows by the room they have left: a segment tree of counts over room sizes 0..seq_len."""

    def __init__(self, seq_len: int):
        self.width = 1 << seq_len.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(seq_len + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        if room:
            self.rows[room].append(row)
            self._add(room, 1)

    def best(self, size: int) -> tuple[int, int] | None:
        """Take out the row with the least room that holds ``size``."""
        at = size + self.width
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):      # up until a right neighbour has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.width
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], seq_len: int) -> list[list[int]]:
    """Items of each row, for item sizes from 1 to seq_len."""
    rooms, rows = Rooms(seq_len), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.best(sizes[i])
        if found is None:
            row, room = len(rows), seq_len
            rows.append([])
        else:
            row, room = found
        rows[row].append(i)
        rooms.put(row, room - sizes[i])
    return rows


def pack_pool(docs: list[tuple[object, np.ndarray]], seq_len: int, pad_id: int) -> Iterator[tuple]:
    """(ids, n_tokens, cu_seqlens, position_resets, doc_ids, doc_offsets) for each row of one pool."""
    pieces = [(doc_id, at, ids[at:at + seq_len]) for doc_id, ids in docs for at in range(0, len(ids), seq_len)]
    for row in best_fit_decreasing([len(p[2]) for p in pieces], seq_len):
        chosen = [pieces[i] for i in row]
        ends = np.cumsum([0] + [len(p[2]) for p in chosen])
        line = np.full(seq_len, pad_id, dtype=chosen[0][2].dtype)
        line[:ends[-1]] = np.concatenate([p[2] for p in chosen])
        resets = ends if ends[-1] < seq_len else ends[:-1]
        yield line.tobytes(), int(ends[-1]), ends.tolist(), resets.tolist(), [p[0] for p in chosen], [p[1] for p in chosen]


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, seq_len: int = SEQ_LEN,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of all documents: row_id, ids, n_tokens, cu_seqlens, position_resets, doc_ids, doc_offsets."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    end_id = len(ranks)
    kind = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    vocab = rows.sparkSession.sparkContext.broadcast(ranks)            # the vocabulary file, a constant

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab.value, special_tokens={})
        part, made = TaskContext.get().partitionId(), 0
        pool, held, kept_type = [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal made
            out = list(zip(*pack_pool(pool, seq_len, end_id)))
            ids = pa.array([(part << 36) + made + i for i in range(len(out[0]))], pa.int64())
            made += len(out[0])
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], ints), pa.array(out[3], ints),
                 pa.array(out[4], pa.list_(kept_type)), pa.array(out[5], pa.list_(pa.int64()))],
                ["row_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"])

        for b in batches:
            kept_type = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([i for piece in pieces(text.as_py()) for i in encoding.encode_ordinary(piece)] + [end_id], dtype=kind)
                pool.append((doc_id, ids))
                held += len(ids)
                if held >= POOL_TOKENS:
                    yield flush()
                    pool, held = [], 0
        if pool:
            yield flush()

    return rows.mapInArrow(packed, f"row_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
                                   f"doc_ids array<{id_type}>, doc_offsets array<long>")


def unpack_rows(rows: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """(doc_id, doc_offset, piece binary) for every segment of rows packed with ``seq_len``; another one is an error."""
    width = F.length("ids") / F.lit(seq_len)
    width = F.when(width.isin(2, 4), width).otherwise(F.raise_error(F.lit(f"the rows were not packed with seq_len={seq_len}")))
    return (rows.select("ids", F.length("ids").alias("n"), "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_offsets")).alias("i", "s"))
            .select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_offsets").alias("doc_offset"), "ids",
                    width.cast("int").alias("w"), F.get("cu_seqlens", F.col("i")).alias("a"), F.get("cu_seqlens", F.col("i") + 1).alias("b"))
            .select("doc_id", "doc_offset", F.expr("substring(ids, a * w + 1, (b - a) * w)").alias("piece")))


def write_packed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
