"""Rolling polynomial hashes over bytes, modulo 2**64, vectorised.

``prefix(data)`` gives P with P[i] = sum of T[data[j]] * B**j for j < i; the hash of
the bytes s..e is then (P[e] - P[s]) * B**-s, which depends on the bytes alone.
B is odd, so B**-1 exists modulo 2**64.
"""

from __future__ import annotations

import numpy as np

from .common import mix

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: A fixed 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        if size > 1 << 23:  # rare: a very long text; not kept
            return out
        _powers[base] = have = out
    return have


def prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, max(len(data), 1))[: len(data)], out=out[1:])
    return out


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    return (p[ends] - p[starts]) * powers(INVERSE, int(starts.max()) + 1)[starts]
