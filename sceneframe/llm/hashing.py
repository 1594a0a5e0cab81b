"""Hashes of all the words of a batch of texts at once.

A word's hash is a polynomial over a random table of its bytes, computed from
running sums, so no loop over words is needed.
"""

from __future__ import annotations

import numpy as np

from sceneframe.llm.common import scramble

_BASE = 0xD1342543DE82EF95
_TABLE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < size:
        size = 1 << (size - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def word_hashes(texts: list[bytes], lower: bool = False, apart: int = 32):
    """``(data, owner, start, end, hash)`` of the words `[^\\x20\\x09-\\x0D]+` of all texts.

    ``data`` holds the texts joined by the byte ``apart``; ``owner`` is each word's text number.
    """
    data = np.frombuffer(bytes([apart]).join([b"", *texts, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    blank = _SPACES[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * powers[:len(data)], out=sums[1:])
    hashes = scramble((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
    return data, np.searchsorted(limits, start, side="right"), start, end, hashes


def chunks_of(texts: list, size: int = 1 << 19):
    """Slices of a list of texts with about ``size`` bytes or characters each (or one longer text)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(t) + 1
    if texts:
        yield slice(start, len(texts))
