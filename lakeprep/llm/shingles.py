"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]), 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of all words together if there are fewer.

    Words are runs without blank and without the code points 9 to 13, A-Z in lower case. A null, empty or
    blank text has the empty set.
    """
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(data, np.uint8)
    up, down = _power(len(points))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[points] * up[:len(points)], dtype=np.uint64)])
    gaps = np.flatnonzero(points == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(points)]])
    word = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = min(words, len(word))
    total = np.full(len(word) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        total = total * _BASE + word[k:len(word) - n + 1 + k]
    return np.unique(mix64(total))


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, whatever its order, as signed integers."""
    mixed = mix64(shingles)
    a = mix64(np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))
    b = mix64(np.array([np.bitwise_xor.reduce(mix64(mixed + _BASE)) if len(mixed) else 0], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])
