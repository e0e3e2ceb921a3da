"""Periodic runs of words, found in a Re-Pair grammar of each document.

A run is a stretch of consecutive words with smallest period q and at least
max(MIN_LENGTH, MIN_EXPONENT * q) words that no neighbouring word extends.

1. Re-Pair (``repair``): pairs of neighbouring symbols that recur in a document
   become nonterminals, more frequent pairs before less frequent neighbours, until
   none recurs. All documents of an Arrow batch are compressed together, a symbol
   belonging to one document. What is left is the start rule.
2. A run lies in one smallest piece of the derivation tree and crosses the
   boundary between that piece's two parts. So each nonterminal is looked at once,
   at its first place in the text (``crossing``): a run of four periods across a
   boundary has a whole square on one side of it, so its period is a distance at
   which the words next to the boundary recur: up to 7 words compared directly,
   from L to 2L words by equal L-word strings for L = 8, 16, 32, ... How far the
   period goes on is found by bisection over fingerprints, within the piece. The
   start rule is looked at in the same way at each of its boundaries.
3. What a nonterminal holds is moved to every place where it is derived, and
   pieces of one run are merged into the maximal one (``merged``).

Documents are the unit of work, batches of them are independent tasks, and a
batch is bounded by bytes, so nothing is shuffled and a lost task is run again.

Defined results: a null or empty text has no words, no runs and four nulls; a
null doc_id has no words rewritten by ``repeated_tail``; repeated rows give a row
each; an empty table gives no rows; other columns, whatever their names, are not
touched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bytehash import scramble

MIN_LENGTH, MIN_EXPONENT = 6, 4
SHORT = 8                       # periods below this are compared word by word
BATCH_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Prints:
    """64-bit fingerprints of any stretch of a sequence of word ids, in constant time."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        ups = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, dtype=np.uint64)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK, dtype=np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(scramble(ids.astype(np.uint64) + np.uint64(1)) * ups[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return scramble((self.sums[start + length] - self.sums[start]) * self.back[start])

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree, at most ``most``."""
        return _bisect(lambda n: self.of(i, n) == self.of(j, n), most)

    def behind(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before i and before j agree, at most ``most``."""
        return _bisect(lambda n: self.of(i - n, n) == self.of(j - n, n), most)


def _bisect(agrees, most: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        yes = agrees(mid)
        low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
    return low


def repair(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Grammar of all documents: symbol, start, length of the left part and length of every derived pair, and the
    starts of the start rule's symbols.

    ``ids`` are symbols that differ between documents. In a round a pair is replaced where it is more frequent than
    the pairs it overlaps (ties by its symbols; in a row of equal pairs every second one), if that leaves two places.
    """
    sym, start, owner = ids.astype(np.int64), np.arange(len(ids)), doc
    size = np.ones(len(ids), dtype=np.int64)
    next_symbol = int(ids.max()) + 1 if len(ids) else 0
    live = np.concatenate([owner[1:] == owner[:-1], [False]]) if len(ids) else np.zeros(0, dtype=bool)
    found = []
    while True:
        at = np.flatnonzero(live)
        if not len(at):
            break
        key = (sym[at] << 32) | sym[at + 1]
        by_key = np.argsort(key, kind="stable")
        ordered = key[by_key]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.empty(len(at), dtype=np.int64)
        count[by_key] = np.repeat(np.diff(np.append(edge, len(at))), np.diff(np.append(edge, len(at))))
        live[at[count < 2]] = False                       # no new place of an old pair ever arises
        some = count >= 2
        at, key, count = at[some], key[some], count[some]
        if not len(at):
            break
        # rank by (count, key); neighbours are the entries at at-1 and at+1
        beside = np.concatenate([[False], at[1:] == at[:-1] + 1])
        less = np.zeros(len(at), dtype=bool)
        same = np.zeros(len(at), dtype=bool)
        i = np.flatnonzero(beside)
        left_more = (count[i - 1] > count[i]) | ((count[i - 1] == count[i]) & (key[i - 1] > key[i]))
        equal = key[i - 1] == key[i]
        same[i[equal]] = True
        less[i[left_more]] = True
        less[i[~left_more & ~equal] - 1] = True
        # a row of equal overlapping pairs: every second one, counted from its start
        row = np.arange(len(at)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        pick = np.flatnonzero(~less & (row % 2 == 0))
        pick = pick[np.concatenate([[True], at[pick[1:]] > at[pick[:-1]] + 1])] if len(pick) else pick
        kinds, kind, places = np.unique(key[pick], return_inverse=True, return_counts=True)
        twice = places[kind] >= 2
        pick, kind = pick[twice], kind[twice]
        if not len(pick):
            break
        left = at[pick]
        numbers = np.cumsum(places >= 2) - 1 + next_symbol
        next_symbol = int(numbers[-1]) + 1
        new = numbers[kind]
        found.append((new, start[left], size[left], size[left] + size[left + 1]))
        size[left] += size[left + 1]
        sym[left] = new
        gone = np.zeros(len(sym), dtype=bool)
        gone[left + 1] = True
        changed = np.zeros(len(sym), dtype=bool)
        changed[left] = True
        keep = ~gone
        sym, start, size, owner, live, changed = sym[keep], start[keep], size[keep], owner[keep], live[keep], changed[keep]
        inside = np.concatenate([owner[1:] == owner[:-1], [False]])
        live |= changed | np.concatenate([changed[1:], [False]])
        live &= inside
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, start
    symbol, place, left_size, whole = (np.concatenate(x) for x in zip(*found))
    return symbol, place, left_size, whole, start


def crossing(ids: np.ndarray, prints: Prints, low: np.ndarray, at: np.ndarray, high: np.ndarray) -> tuple:
    """(index of the boundary, start, end, period) of runs in [low, high) that cross the boundary ``at``."""
    cand: list[tuple] = []                        # (boundary, period, side)
    index = np.arange(len(at))
    for q in range(1, SHORT):
        for side in (0, 1):                       # a square after the boundary, or before it
            first = at if side == 0 else at - 2 * q
            ok = (first >= low) & (first + 2 * q <= high) & (high - low >= max(MIN_LENGTH, MIN_EXPONENT * q))
            k = index[ok]
            k = k[ids[first[k]] == ids[first[k] + q]]
            k = k[prints.of(first[k], q) == prints.of(first[k] + q, q)]
            cand.append((k, np.full(len(k), q), np.full(len(k), side)))
    n, span = len(ids), SHORT
    places = np.arange(max(0, n - span + 1))
    while len(places):
        places = places[places + span <= n]
        h = prints.of(places, span)
        by = np.argsort(h, kind="stable")         # equal strings side by side, by place
        again = h[by][1:] == h[by][:-1]
        group = np.concatenate([[0], np.cumsum(~again)]) if len(by) else np.zeros(0, dtype=np.int64)
        many = np.concatenate([again, [False]]) | np.concatenate([[False], again]) if len(by) else np.zeros(0, dtype=bool)
        places, group = places[by[many]], group[many]
        if not len(places):
            break
        step = n + 1
        line = group * step + places              # ascending
        of_place = np.full(n + 1, -1, dtype=np.int64)
        of_place[places] = group
        for side in (0, 1):
            anchor = at if side == 0 else at - span
            ok = (anchor >= low) & (anchor + span <= high) & (high - low >= MIN_EXPONENT * span)
            k = index[ok]
            k = k[of_place[anchor[k]] >= 0]
            base = of_place[anchor[k]] * step + anchor[k]
            if side == 0:
                a, b = np.searchsorted(line, base + span), np.searchsorted(line, base + 2 * span)
            else:
                a, b = np.searchsorted(line, base - 2 * span + 1), np.searchsorted(line, base - span + 1)
            many_k = np.repeat(k, b - a)
            which = np.arange(len(many_k)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            other = line[which] % step
            mine = np.repeat(of_place[anchor[k]], b - a)
            right = line[which] // step == mine
            many_k, other = many_k[right], other[right]
            q = np.abs(other - anchor[many_k])
            first = at[many_k] if side == 0 else at[many_k] - 2 * q
            ok = (first >= low[many_k]) & (first + 2 * q <= high[many_k]) & (high[many_k] - low[many_k] >= MIN_EXPONENT * q)
            many_k, q, first = many_k[ok], q[ok], first[ok]
            ok = prints.of(first, q) == prints.of(first + q, q)
            cand.append((many_k[ok], q[ok], np.full(int(ok.sum()), side)))
        places = np.sort(places)
        span *= 2
    k, q, side = (np.concatenate(x) for x in zip(*cand))
    b, lo, hi = at[k], low[k], high[k]
    first = np.where(side == 0, b, b - 2 * q)     # a square of period q starts here
    end = first + 2 * q + prints.ahead(first + q, first + 2 * q, hi - first - 2 * q)
    begin = first - prints.behind(first, first + q, first - lo)
    ok = (end - begin >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)) & (begin < b) & (end > b)
    return k[ok], begin[ok], end[ok], q[ok]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs by start, then period, from pieces: pieces of one period that overlap by it are one run, and of
    several periods of one stretch the smallest counts."""
    order = np.lexsort((end, start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    # reach: the furthest end of the pieces of this period so far
    shift = (np.concatenate([[0], np.cumsum(period[1:] != period[:-1])]) * (int(end.max()) + 1))
    reach = np.maximum.accumulate(end + shift) - shift
    fresh = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] + period[1:] > reach[:-1])])
    first = np.flatnonzero(fresh)
    start, period, end = start[first], period[first], np.maximum.reduceat(end, first)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    start, end, period = start[once], end[once], period[once]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def word_runs(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the documents' words, given as one sequence; ``ids`` differ between documents."""
    if not len(ids):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    prints = Prints(ids)
    symbol, place, left, whole, rest = repair(ids, doc)
    kinds, once = np.unique(symbol, return_index=True)
    once = once[whole[once] >= MIN_LENGTH]
    k, start, end, period = crossing(ids, prints, place[once], place[once] + left[once], place[once] + whole[once])
    # to every place where the nonterminal is derived
    by_symbol = np.argsort(symbol, kind="stable")
    first = np.searchsorted(symbol[by_symbol], symbol[once[k]])
    times = np.searchsorted(symbol[by_symbol], symbol[once[k]], "right") - first
    which = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    moved = place[by_symbol[which]] - np.repeat(place[once[k]], times)
    start, end, period = np.repeat(start, times) + moved, np.repeat(end, times) + moved, np.repeat(period, times)
    # the start rule: boundaries inside a document
    rest = rest[np.concatenate([[False], doc[rest[1:]] == doc[rest[:-1]]])]
    begins = np.searchsorted(doc, doc[rest])
    ends = np.searchsorted(doc, doc[rest], "right")
    _k, start2, end2, period2 = crossing(ids, prints, begins, rest, ends)
    return merged(np.concatenate([start, start2]), np.concatenate([end, end2]), np.concatenate([period, period2]))


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of n places: one document in ten goes on periodically from some word."""
    at = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _batch_rows(doc_ids: list, texts: list[bytes], tail) -> Iterator[tuple]:
    words = [t.split() for t in texts]            # ASCII white space: the six characters between words
    places = [tail(d, len(w)) if tail else np.arange(len(w)) for d, w in zip(doc_ids, words)]
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for w in words for x in w), dtype=np.int64, count=len(doc))
    offsets = np.cumsum([0] + [len(w) for w in words])
    if len(ids):
        ids = ids[np.concatenate([p + o for p, o in zip(places, offsets)])]
        # one number per document and word
        ids = np.unique(doc * len(number) + ids, return_inverse=True)[1]
    start, end, period = word_runs(ids, doc)
    cuts = np.searchsorted(start, offsets)
    for i, (doc_id, w) in enumerate(zip(doc_ids, words)):
        s, e, q = (x[cuts[i]:cuts[i + 1]] for x in (start, end, period))
        s, e = s - offsets[i], e - offsets[i]
        drop = np.zeros(len(w) + 1, dtype=np.int64)
        np.add.at(drop, s + q, 1)
        np.add.at(drop, e, -1)
        kept = places[i][np.cumsum(drop[:-1]) == 0]
        lines = "".join(f"{a},{b - a},{p}\n" for a, b, p in zip(s.tolist(), e.tolist(), q.tolist()))
        best = min(range(len(s)), key=lambda j: (s[j] - e[j], s[j], q[j])) if len(s) else None
        top = (None,) * 4 if best is None else (int(s[best]), int(e[best] - s[best]), int(q[best]),
                                                1000 * int(e[best] - s[best]) // int(q[best]))
        yield (doc_id, len(s), *top, hashlib.sha256(lines.encode()).hexdigest(),
               hashlib.sha256(b" ".join([w[j] for j in kept.tolist()] if len(kept) < len(w) or tail else w)).hexdigest(),
               s.tolist(), (e - s).tolist(), q.tolist())


_OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                  ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                  ("collapsed_sha256", pa.string()), ("starts", pa.list_(pa.int64())),
                  ("lengths", pa.list_(pa.int64())), ("periods", pa.list_(pa.int64()))])
_DDL = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string, starts array<long>, lengths array<long>, periods array<long>")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail=None) -> DataFrame:
    """One row per document: all its runs (starts, lengths, periods), the longest one, and digests of the runs and of
    the text with every run collapsed to its first period.

    ``tail`` (document id, number of words) -> places may rewrite the word order first, as ``repeated_tail`` does.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = list(_batch_rows(ids, texts, tail))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(d)
                texts.append((t or "").encode("utf-8", "replace"))
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, _DDL)
