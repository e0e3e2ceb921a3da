"""Vectorised fingerprints of byte strings and content-defined anchors for Arrow batches."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(11)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_VALUES = tuple(_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in _BASES)
_ORDINAL_BITS = 20
_powers: dict[int, tuple] = {}


def _tables(n: int) -> tuple:
    size = max([1 << 19, 1 << max(0, n - 1).bit_length(), *_powers])        # larger ones serve shorter strings too
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(
            tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, dtype=np.uint64)]), dtype=np.uint64)
                  for b in (base, np.uint64(pow(int(base), -1, 1 << 64)))) for base in _BASES)
    return _powers[size]


def scramble(x: np.ndarray) -> np.ndarray:
    """All bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Fingerprints:
    """64-bit fingerprints of any substring of ``raw`` in constant time; two independent kinds, 0 and 1."""

    def __init__(self, raw: np.ndarray):
        self.raw, self._sums, self._tables = raw, {}, _tables(len(raw))

    def of(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        sums, down = self._prefix(kind), self._tables[kind][1]
        return scramble((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """``of`` all substrings of ``width`` bytes in order, kind 0."""
        sums, down = self._prefix(0), self._tables[0][1]
        x = sums[width:] - sums[:len(sums) - width]
        x *= down[:len(x)]
        x += np.uint64(width)
        for _ in range(2):                           # ``scramble`` in place
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x

    def _prefix(self, kind: int) -> np.ndarray:
        if kind not in self._sums:
            terms = _VALUES[kind][self.raw]
            terms *= self._tables[kind][0][:len(terms)]
            sums = np.zeros(len(terms) + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            self._sums[kind] = sums
        return self._sums[kind]


def _window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by running minima of blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def anchors(prints: Fingerprints, span: int, core: int) -> np.ndarray:
    """For every ``span``-byte window the start of its least ``core``-byte string (the last of equals).

    The choice depends on the window's bytes alone, so equal windows choose alike.
    """
    n = len(prints.raw) - core + 1
    w = span - core + 1
    if n < w:
        return np.zeros(0, dtype=np.int64)
    h = prints.every(core)
    h &= ~np.uint64((1 << _ORDINAL_BITS) - 1)
    step, out = (1 << _ORDINAL_BITS) - w, []
    for a in range(0, n - w + 1, step):          # ordinals within a piece never wrap
        piece = h[a:a + step + w - 1]
        ordinal = np.arange(len(piece), dtype=np.uint64)
        least = _window_minimum(piece | (np.uint64((1 << _ORDINAL_BITS) - 1) - ordinal), w)
        out.append(a + ((1 << _ORDINAL_BITS) - 1) - (least & np.uint64((1 << _ORDINAL_BITS) - 1)).astype(np.int64))
    return np.concatenate(out)
