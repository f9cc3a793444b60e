"""Hashed word shingles of many texts at a time."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LETTER = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of text that are hashed together.
BLOCK_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word [^\\x20\\x09-\\x0D]+ with A-Z in lower case."""
    text = np.frombuffer(data.translate(_LOWER), np.uint8)
    inside = np.flatnonzero(~_SPACE[text])
    if not len(inside):
        return inside, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    length = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, length)
    powers = np.full(int(length.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_LETTER[text[inside]] * powers[place], first)
    return inside[first], mix(sums + length.astype(np.uint64))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text has one shingle, an empty one none."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at, words = word_hashes(b"\n".join(texts))
    bounds = np.searchsorted(at, starts)
    count = len(words) - width + 1
    folded = np.zeros(max(count, 0), np.uint64)
    for i in range(width):
        folded = folded * _STEP + words[i : i + count] if count > 0 else folded
    folded = mix(folded)
    sets = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= width:
            sets.append(np.unique(folded[lo : hi - width + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], np.uint64)
            for i in range(lo, hi):
                whole = whole * _BASE + words[i]
            sets.append(mix(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sets_of_batch(batch, column: int, width: int):
    """(row, set) for each row of a record batch, in blocks of BLOCK_BYTES."""
    block, first, size = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        text = (value.as_py() or "").encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield from enumerate(shingle_sets(block, width), first)
            block, first, size = [], i, 0
        block.append(text)
        size += len(text)
    if block:
        yield from enumerate(shingle_sets(block, width), first)
