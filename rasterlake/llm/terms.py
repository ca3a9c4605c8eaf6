"""Terms of many texts at once: maximal runs of bytes of a class, with A-Z in lower case, as numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from rasterlake.llm.suffix_dedup import ODD, mixed

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 .. 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def without(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to terms: all but those in ``ranges`` (ends included). Bytes of longer UTF-8 characters are 0x80 and more."""
    inside = np.ones(256, bool)
    for a, b in ranges:
        inside[a : b + 1] = False
    return inside


LETTERS_DIGITS = without((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LETTERS = without((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass
class Terms:
    """Terms of concatenated texts: a 64-bit hash, text and byte range of each, in order; ``data`` is in lower case."""

    data: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def strings(self, which: np.ndarray) -> pa.Array:
        return strings(self.data, self.start[which], self.end[which])


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges of ``data`` as an Arrow array of strings."""
    length = end - start
    offsets = np.append(0, np.cumsum(length))
    raw = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def edges(raws: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Concatenated texts, starts and ends of terms, and how many terms each text has."""
    data = np.frombuffer(b"\n".join([*raws, b"\n" * 8]), np.uint8)
    edge = np.diff(inside[data].view(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.append(0, np.cumsum([len(r) + 1 for r in raws])).astype(np.int64)
    return data, start, end, np.diff(np.searchsorted(start, bounds))


def terms(raws: list[bytes], inside: np.ndarray) -> Terms:
    data, start, end, count = edges(raws, inside)
    data = _LOWER[data]
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = end - start
    h = mixed((words[start] & _FIRST[np.minimum(length, 8)]) * ODD[0])
    more, at = np.flatnonzero(length > 8), 8
    while len(more):
        h[more] = mixed(h[more] * ODD[1] + (words[start[more] + at] & _FIRST[np.minimum(length[more] - at, 8)]))
        at += 8
        more = more[length[more] > at]
    return Terms(data, h, np.repeat(np.arange(len(raws)), count), start, end)


def counted(t: Terms, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of a term and a ``group`` (of the occurrences): an occurrence of the term for each term, then term, group and number of the pairs, by term and group."""
    known, first, which = np.unique(t.hash, return_index=True, return_inverse=True)
    many = int(group.max()) + 1 if len(group) else 1
    pairs = which.astype(np.int64) * many + group
    pairs.sort()
    at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    pairs, n = pairs[at], np.diff(np.append(at, len(pairs)))
    return first, pairs // many, pairs % many, n
