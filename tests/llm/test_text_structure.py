"""Vector codes, suffix dedup and periodic runs against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import bytehash, periodic_runs, suffix_family, vector_codes


# ------------------------------------------------------------------ op11

def _plain_codes(rows, parts, entries, rounds):
    """(vec_id -> (code, error, label_error), codebooks) with Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(math.floor(256 * x) for x in v[p * width:(p + 1) * width]) for p in range(parts)] for _i, v, _l in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
                for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got) if g[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine))
    got = assign()
    errors = [sum(d for d, _k in g) for g in got]
    by_label = Counter()
    for (_i, _v, lab), e in zip(kept, errors):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, lab, "".join(f"{k:02x}" for _d, k in g), e, by_label[lab], digest)
                   for (i, _v, lab), g, e in zip(kept, got, errors)), key=repr)


def _codes(spark, rows, schema="vec_id long, embedding array<double>, label int, code string", **kw):
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], schema)
    return sorted((tuple(r[c] for c in ("vec_id", "label", "code", "error", "label_error", "codebooks_sha256"))
                   for r in vector_codes.code_vectors(df, **kw).collect()), key=repr)


def test_vector_codes_match_plain_integers(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, rnd.uniform(-1, 1)]) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(60)]
    rows += [rows[3], rows[3], (7, [0.25] * 8, 1), (None, [0.5] * 8, 2)]                      # repeats, equal ids, null id
    rows += [(100, None, 1), (101, [None] + [0.0] * 7, 1), (102, [math.nan] + [0.0] * 7, 1), (103, [math.inf] * 8, None)]
    rnd.shuffle(rows)
    assert _codes(spark, rows, parts=4, entries=6, rounds=2) == _plain_codes(rows, 4, 6, 2)


def test_vector_codes_big_numbers_few_rows_and_odd_widths(spark):
    rows = [(i, [x * 2.0 ** e for x in (1, -3, 5, 7)], 0) for i, e in enumerate((0, 14, 19, 27, 40))]
    got = _codes(spark, rows, parts=2, entries=64, rounds=2)
    want = _plain_codes(rows, 2, 64, 2)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == [min(r[3], 2 ** 63 - 1) for r in want]
    got = _codes(spark, [(1, [1.0, 2.0], 5), (2, [1.0], 6), (3, [], 6)], parts=2)
    assert [r[:5] for r in got] == [(1, 5, "0000", 0, 0), (2, 6, None, None, None), (3, 6, None, None, None)]
    assert _codes(spark, [(1, None, 5)]) == []


@pytest.mark.parametrize("width", [1, 4, 33])
def test_limb_products_are_exact(width):
    rng = np.random.default_rng(width)
    top = 1 << ((62 - width.bit_length()) // 2)
    x, c = rng.integers(-top, top, (3, 17, width)), rng.integers(-top, top, (3, 9, width))
    exact = np.stack([(p.astype(object) @ e.astype(object).T) for p, e in zip(x, c)])
    assert (vector_codes.exact_dots(x, c) == exact).all()
    assert width * (1 << 2 * vector_codes.limb_bits(width)) <= 1 << 53


# ------------------------------------------------------------------ op12

def _plain_removed(texts, length=suffix_family.LENGTH):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        go = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                go[i:i + length] = b"\1" * length
        n = sum(1 for i in range(len(b)) if go[i] and (i == 0 or not go[i - 1]))
        out.append((len(b), sum(go), n, hashlib.sha256(bytes(x for x, g in zip(b, go) if not g)).hexdigest()))
    return out


def _documents(rnd):
    words = ["".join(rnd.choice("abcdefghijklmnopq é") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    passages = [prose(rnd.randrange(25, 90)) for _ in range(10)] + ["a" * 230, "ab" * 150, "=" * 199]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 500]
    for _ in range(90):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            if rnd.random() < .45:
                p = rnd.choice(passages)
                a = rnd.randrange(max(1, len(p) - 190))
                parts.append(p[a:a + rnd.choice([190, 199, 200, 201, 202, 205, 215, 300, 1000])])
            else:
                parts.append(prose(rnd.randrange(1, 60)))
        texts.append(rnd.choice([" ", "", "\n"]).join(parts))
    texts += texts[20:26]
    for _ in range(4):
        near = list(texts[40])
        near[rnd.randrange(len(near))] = "#"
        texts.append("".join(near))
    return texts


@pytest.mark.parametrize("batches", [1, 4])
def test_suffix_family_matches_every_window(spark, batches):
    texts = _documents(random.Random(batches))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, starts int")
    got = {r.doc_id: r for r in suffix_family.remove_repeats(df, batches=batches).collect()}
    want = _plain_removed(texts)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert all(sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed for r in got.values())


def test_fingerprints_of_every_substring_and_kept_tables():
    raw = np.frombuffer(random.Random(8).randbytes(5000), dtype=np.uint8)
    prints, at = bytehash.Fingerprints(raw), np.arange(5000 - 63)
    assert (prints.every(64) == prints.of(at, at + 64)).all()
    large = bytehash._tables((1 << 20) + 1)
    assert bytehash._tables(10) is large               # a short piece does not throw the large tables away


def test_suffix_family_levels_and_empty_table(spark):
    family = suffix_family.SuffixFamily(spark)
    for i in range(5):
        hits = family.add(spark.createDataFrame([("a b c d e " * 30 + f"batch {i}",)], "text string"))
        assert i == 0 or hits.count() > 0
    assert sorted(family.levels) == [0, 2]        # five batches: one level of four, one of one
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_family.remove_repeats(empty).count() == 0


# ------------------------------------------------------------------ op13

def _plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(w[j] == w[j + r] for j in range(s, e - r)) for r in range(1, q)):
                out.add((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _plain_row(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    n, h = len(w), (1 if doc_id is None else zlib.crc32(str(doc_id).encode()))
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = _plain_runs(w)
    gone = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{ln},{q}\n" for s, ln, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_periodic_runs_match_plain_search(spark):
    rnd = random.Random(4)
    texts = [None, "", "  \t\n", "a", "a " * 5, "a " * 6, "a b " * 4, "ü ü ü ü ü ü ü\x0bx"]
    for _ in range(150):
        words = []
        for _ in range(rnd.randrange(0, 6)):
            unit = [f"w{rnd.randrange(rnd.choice([1, 2, 3, 30]))}" for _ in range(rnd.choice([1, 2, 3, 5, 9, 13, 20, 33]))]
            words += (unit * rnd.randrange(1, 8))[:rnd.randrange(1, 150)]
        texts.append(rnd.choice([" ", "\n", " \t "]).join(words))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[9], 1), (None, "x y " * 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    cols = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted(((r.doc_id, *(r[c] for c in cols)) for r in
                  periodic_runs.periodic_runs(df, tail=periodic_runs.repeated_tail).collect()), key=repr)
    assert got == sorted(((i, *_plain_row(i, t)) for i, t, _ in rows), key=repr)
    assert any(r[1] > 1 for r in got)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_periodic_runs_of_many_words():
    rnd = random.Random(9)
    w = [rnd.randrange(50) for _ in range(3000)] + [rnd.randrange(1000) for _ in range(700)] * 5 + [1] * 4000
    ids = np.array(w)
    start, end, period = periodic_runs.word_runs(ids, np.zeros(len(w), dtype=np.int64))
    found = set(zip(start.tolist(), end.tolist(), period.tolist()))
    assert {(e - s, q) for s, e, q in found if q in (1, 700) and e - s > 3000} >= {(4000, 1)}
    assert any(q == 700 and e - s >= 3500 for s, e, q in found)
    symbol, place, left, whole, rest = periodic_runs.repair(ids, np.zeros(len(w), dtype=np.int64))
    assert len(rest) < 4200 and (left < whole).all()          # 3,000 + 700 words and a logarithm of the rest


def test_suffix_pieces_stay_small(monkeypatch):
    """3 MB of texts in one Arrow batch: pieces and power tables stay within 1 << 19 bytes, with the rows of one large piece."""
    rnd = np.random.default_rng(3)
    texts = ["".join(chr(97 + c) for c in rnd.integers(0, 26, 1000)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    def rows():
        monkeypatch.setattr(bytehash, "_powers", {})
        return sorted(r for b in suffix_family._suffix_rows(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns)))

    pieces = [raw for _rows, raw, _at in suffix_family._pieces(suffix_family._arrow_rows(iter([batch]), 0), 0)]
    assert max(map(len, pieces)) <= 1 << 19 and sum(map(len, pieces)) == 3_000_000
    small = rows()
    assert max(bytehash._powers) <= 1 << 19
    monkeypatch.setattr(suffix_family, "BATCH_BYTES", 1 << 23)
    assert rows() == small
