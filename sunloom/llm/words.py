"""Words of a text as 64-bit hashes, all at once."""

from __future__ import annotations

import numpy as np

from sunloom.llm.common import SPACED_WORDS, mixed

_draw = np.random.Generator(np.random.PCG64(20240301))
_BYTE = _draw.integers(1, 2**64, 256, dtype=np.uint64)
_ODD = _draw.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word, in order; A-Z are lower-cased, words are what ASCII white space separates."""
    data = np.frombuffer(text.encode().translate(SPACED_WORDS) if text else b"", np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    turns = np.flatnonzero(np.diff(inside))
    start, end = turns[::2], turns[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct runs of `size` words as sorted hashes; of fewer words one run of all."""
    words = word_hashes(text)
    width = min(size, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k:k + n] * _ODD[k]
    return np.unique(mixed(total))
