"""Word shingles as sorted 64-bit hashes, and sketches of them (NumPy, used inside Arrow batches)."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator: a bijection on 64-bit words."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class _Words(dict):
    """Hash of each word; emptied when it gets large, so a worker's memory stays bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


_CACHE = _Words()


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles.

    With fewer words than n the whole sequence is one shingle; without words there is none.
    """
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_CACHE.__getitem__, w), np.uint64, len(w))
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        acc = mix(acc * _M1 + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def fast_sketch(h: np.ndarray, k: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: k coordinates, each filled.

    In round i < k every element falls in one hashed bin with a value in [i, i+1); in round
    k + j every element falls in bin j. A bin keeps its least value; rounds end when all bins
    hold one, so after 2k rounds at the latest and after few for sets that are not tiny.
    """
    out = np.full(k, _TOP)
    empty = k
    for i in range(2 * k):
        x = mix(h ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((x >> _S32) * np.uint64(k)) >> _S32 if i < k else np.full(len(h), i - k, np.uint64)
        value = (np.uint64(i) << _S32) | (x & np.uint64(0xFFFFFFFF))
        if i:
            open_ = out[bins] == _TOP
            if not open_.any():
                continue
            bins, value = bins[open_], value[open_]
        np.minimum.at(out, bins, value)
        empty = int((out == _TOP).sum())
        if not empty:
            break
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` coordinates, with the band's number mixed in."""
    s = sketch[: len(sketch) // rows * rows].reshape(-1, rows)
    acc = np.arange(1, len(s) + 1, dtype=np.uint64) * _M2
    for i in range(rows):
        acc = mix(acc * _M1 + s[:, i])
    return acc.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in integers; empty sets link with nothing."""
    m, n = len(a), len(b)
    if not m or not n or 100 * min(m, n) < percent * max(m, n):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (m + n - both)
