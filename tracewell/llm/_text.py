"""Vectorised text primitives on numpy: word hashes and ranges, without a loop over words."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n (kept and grown as needed)."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each range; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 20  # bytes at a time keep the powers table and the sums small
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, lo + step)))
        hi = int(ends[to - 1])
        pw, inv = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE_CODE[data[lo:hi]] * pw[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by one newline, and where each begins (one more than texts)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=off[1:])
    data = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8)
    return data, off


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~WHITE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words of all texts, and the first word of each text (one more than texts).

    keep: a table of 256 flags of bytes that belong to words; others separate.  Default: all but ASCII white space.
    """
    data, off = joined(texts)
    data = LOWER[data]
    if keep is not None:
        data = np.where(keep[data], data, np.uint8(32))
    s, e = word_ranges(data)
    return range_hashes(data, s, e), np.searchsorted(s, off)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each place (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    return mix(out)


def flat_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + size)."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
