"""Vectorised work on UTF-8 texts: word bounds, word hashes and rolling hashes of word or byte runs, for many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
#: Random 64-bit values stand for bytes, so that equal hashes mean equal bytes but for a chance of about 2**-64 a pair.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps, at most; texts that need more make them anew.
KEPT_POWERS = 1 << 20
#: Bytes whose words are hashed in one step.
STEP_BYTES = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if (got := _powers.get(base)) is None or len(got) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > KEPT_POWERS:
            return out[:n]
        got = _powers[base] = out
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums of byte values times powers, for run(): one more than there are bytes."""
    out = np.zeros(len(raw) + 1, np.uint64)
    t = (_LOWER if lower else _BYTE)[raw]
    t *= _power(_BASE, len(raw))
    np.cumsum(t, out=out[1:])
    return out


def run(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end)."""
    h = sums[end] - sums[start]
    h *= _power(_INVERSE, len(sums))[start]
    return mix(h)


def bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t\\n\\v\\f\\r]+ of all texts, and how many words stand before each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words stand before each text."""
    start, end, before = bounds(raw, off)
    if len(raw) <= STEP_BYTES:
        return run(prefix(raw, lower), start, end), before
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        z = max(a + 1, int(np.searchsorted(end, start[a] + STEP_BYTES, "right")))
        lo = start[a]
        out[a:z] = run(prefix(raw[lo : end[z - 1]], lower), start[a:z] - lo, end[a:z] - lo)
        a = z
    return out, before


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive values, over all bounds: len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # doubling: a run of 2m is a run of m, and the run of m after it
    done, have, out = 0, 1, None
    power = h
    shift = _WORD_BASE
    rest = k
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * shift_of(have) + part
            done += have
        rest >>= 1
        if rest:
            power = power[: len(power) - have] * shift_of(have) + power[have:]
            have *= 2
    return mix(out * shift)


def shift_of(m: int) -> np.uint64:
    return np.uint64(pow(int(_WORD_BASE), m, 2**64))


def inside(before: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k (by start, as from grams) lie within one text."""
    total = int(before[-1])
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(total + 1, np.int32)
    size = np.diff(before)
    has = size >= k
    np.add.at(ok, before[:-1][has], 1)
    np.add.at(ok, before[1:][has] - k + 1, -1)
    return np.cumsum(ok)[:n] > 0
