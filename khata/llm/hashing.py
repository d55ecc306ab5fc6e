"""Normal form of words, and their hashes, a buffer at a time."""

from __future__ import annotations

import numpy as np

_FORM = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _FORM[_b] = ord("0") if _c.isdigit() else ord(_c.lower()) if _c.isalnum() else 10 if _c == "\n" else 32
FORM = bytes(_FORM)
_RANDOM = np.random.default_rng(20240229)
#: Odd weights for the bytes of a word, by place.
WEIGHTS = _RANDOM.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit sums."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sums) of the words in bytes where exactly one space parts two words; ``mixed`` spreads the sums."""
    space = data == 32
    starts = np.concatenate([[0], np.flatnonzero(space) + 1])
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(data))))
    place &= 4095
    weights = WEIGHTS.take(place)
    weights *= data
    weights[space] = 0
    return starts, np.add.reduceat(weights, starts)
