"""Word shingles of whole texts as sorted 64-bit hashes; used on the executors."""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 17
_rng = np.random.default_rng(90_071)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << n.bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words of a UTF-8 text, A-Z lower-cased; of the whole sequence if it has fewer.

    Words are separated by space, \\t, \\n, \\x0b, \\f or \\r. A run's hash is a polynomial over its words joined by single
    spaces, with a random 64-bit value for each byte, read off running sums; the text is taken in chunks of words.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    found = []
    for low in range(0, len(words) - size + 1, _CHUNK):
        part = words[low : low + _CHUNK + size - 1]
        joined = np.frombuffer(b" ".join(part), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        _grow(len(joined) + 1)
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[joined] * _powers[: len(joined)], out=sums[1:])
        a, b = starts[: len(part) - size + 1], ends[size - 1 :]
        found.append((sums[b] - sums[a]) * _inverses[a])
    return np.unique(mix(np.concatenate(found)))
