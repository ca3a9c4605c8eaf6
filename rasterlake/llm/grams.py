"""Words and shingles of many texts at once, as 64-bit hashes in arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rasterlake.llm.suffix_dedup import ODD, mixed

_LETTER = np.random.default_rng(77).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = 0x9E3779B97F4A7C15


@dataclass
class Words:
    """Words of concatenated texts: hash, text and byte range [start, end) of each; ``ends``: words up to each text's end."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ends: np.ndarray


def words(raws: list[bytes], lower: bool = True) -> Words:
    """A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``, with A-Z in lower case; byte places count within each text."""
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum(sizes)
    text = np.searchsorted(bounds, start, "right")
    length = end - start
    hashes = np.zeros(len(start), np.uint64)
    if len(start):
        powers = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()), _FACTOR, np.uint64)), dtype=np.uint64)
        for a in range(0, len(start), 1 << 16):  # some words at a time, so that arrays stay in the cache
            b = min(a + (1 << 16), len(start))
            part = data[start[a] : end[b - 1]]
            letters = _LETTER[_LOWER[part] if lower else part]
            place = np.arange(start[a], end[b - 1]) - np.repeat(start[a:b], np.diff(np.append(start[a:b], end[b - 1])))
            letters *= powers[np.minimum(place, len(powers) - 1)]
            letters[_SPACE[part]] = 0
            hashes[a:b] = np.add.reduceat(letters, start[a:b] - start[a])
    hashes = mixed(hashes + length.astype(np.uint64) * ODD[8])
    base = bounds - sizes
    return Words(hashes, text, start - base[text], end - base[text], np.searchsorted(text, np.arange(len(raws)), "right"))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they are all of one text."""
    m = len(w.hash) - size + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out = np.zeros(m, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(_FACTOR) + w.hash[k : k + m])
    return out, w.text[:m] == w.text[size - 1 :]
