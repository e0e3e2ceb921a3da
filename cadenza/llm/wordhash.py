"""Vectorised 64-bit hashes of words and word shingles for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BATCH_BYTES = 1 << 21


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, dtype=np.uint64)]), dtype=np.uint64)
                              for b in (_BASE, _BACK))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (all bits of the result depend on all bits of x)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_batches(texts: Iterator[str | None]) -> Iterator[list[bytes]]:
    """UTF-8 texts, A-Z lower-cased, in lists of about BATCH_BYTES; null as empty."""
    out, size = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "replace").lower()
        out.append(b)
        size += len(b) + 1
        if size >= BATCH_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets of each text's words); words are runs of [^\\x20\\x09-\\x0D]."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[:len(raw)], dtype=np.uint64)])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(start, begins)


def shingle_hashes(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; fewer words make one shingle, no words none."""
    h, at = word_hashes(texts)
    n = len(h)
    every = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        every += mix(h[j:j + len(every)] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
    every = mix(every)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            yield np.unique(every[a:b - k + 1])
        elif b > a:
            one = np.uint64(b - a)
            for j in range(a, b):
                one = mix(one + h[j:j + 1])[0]
            yield np.array([one], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)
