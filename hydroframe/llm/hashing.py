"""64-bit hashes of words and of runs of words, by numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    up = down = np.ones(0, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up.size < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text (its UTF-8 bytes), in order; the words are those of bytes.split()."""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    chars = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[chars], [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _Powers.of(chars.size)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[chars] * up, dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts])


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if words.size < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(words.size - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + out.size]
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all windows of n values, by doubling."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: x.size - (n - width)], x[n - width :]) if n > width else x
