"""Hashes of all words of a run of bytes at once."""

from __future__ import annotations

import numpy as np
import xxhash

_WHITE = np.zeros(256, np.int8)
_WHITE[[9, 10, 11, 12, 13, 32]] = 1
_BYTE = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, kept for the next call."""
    if not _POWERS or len(_POWERS[0]) <= n:
        most = max(n, 1 << 18)
        found = []
        for base in (_ODD, _BACK):
            steps = np.full(most + 1, np.uint64(base), np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps))
        _POWERS[:] = found
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of every run of bytes that are not ASCII white space."""
    steps = np.diff(_WHITE[raw], prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(steps == -1), np.flatnonzero(steps == 1)


# Polynomials modulo a power of two agree on some long runs of two letters.
LONG = 256


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each run of bytes: a polynomial over random numbers for bytes, mixed.

    A run of more than LONG bytes has its XXH64 instead.
    """
    power, back = _powers(len(raw))
    summed = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=summed[1:])
    runs = (summed[ends] - summed[starts]) * back[starts]
    found = mix(runs + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        found[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return found
