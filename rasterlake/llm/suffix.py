"""Suffix arrays of a task's text, in whole-array steps."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket; names of a recursion level over it are ranked by doubling.
BUCKETS = 4096


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting. ``text`` holds small non-negative integers and ends in its only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    if int(text.max()) >= BUCKETS:
        return _doubled(text)
    smaller = _smaller_types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    names = _names(text, smaller, leftmost)
    order = np.argsort(names) if int(names.max()) + 1 == len(names) else suffix_array(names)
    return _induced(text, smaller, leftmost[order])


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; equal neighbours take the type of the next change."""
    step = np.sign(np.diff(text.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[following] > 0, True)


def _names(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, in text order.

    Elements carry their type, so no substring is a prefix of another; they are compared some packed elements at a time, and only those still tied go on.
    """
    elements = text.astype(np.uint64) * 2 + smaller + 1
    bits = int(elements.max()).bit_length()
    pack = 64 // bits
    length = np.diff(np.append(leftmost, leftmost[-1])) + 1
    names = np.zeros(len(leftmost), np.int64)
    tied, depth = np.arange(len(leftmost)), 0
    padded = np.append(elements, np.zeros(pack, np.uint64))
    while len(tied):
        key = np.zeros(len(tied), np.uint64)
        for k in range(depth, depth + pack):
            part = np.where(k < length[tied], padded[np.minimum(leftmost[tied] + k, len(elements))], 0)
            key = (key << np.uint64(bits)) | part
        order = np.lexsort((key, names[tied]))
        key, old = key[order], names[tied][order]
        new_group = np.append(True, (key[1:] != key[:-1]) | (old[1:] != old[:-1]))
        first = np.append(True, old[1:] != old[:-1])
        at = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        group_start = np.maximum.accumulate(np.where(first, at, 0))
        names[tied[order]] = old + start - group_start
        depth += pack
        size = np.diff(np.append(np.flatnonzero(new_group), len(tied)))
        still = np.repeat(size > 1, size) & (length[tied[order]] > depth)
        tied = np.sort(tied[order[still]])
    return np.unique(names, return_inverse=True)[1]


def _doubled(text: np.ndarray) -> np.ndarray:
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (len(rank) + 1) + np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64))
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        rank = np.empty_like(new)
        rank[order] = new
        if new[-1] + 1 == len(rank) or step >= len(rank):
            return order
        step *= 2


def _place(found: np.ndarray, letters: np.ndarray, into: np.ndarray, ends: np.ndarray, step: int) -> None:
    """Append ``found`` to the buckets of ``letters`` in order, moving ``ends`` by ``step``."""
    if not len(found):
        return
    order = np.argsort(letters, kind="stable")
    letters = letters[order]
    starts = np.flatnonzero(np.append(True, letters[1:] != letters[:-1]))
    sizes = np.diff(np.append(starts, len(letters)))
    within = np.arange(len(letters)) - np.repeat(starts, sizes)
    into[ends[letters] + step * within] = found[order]
    ends[letters[starts]] += step * sizes


def _induced(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order: larger types bucket by bucket upwards, smaller ones downwards.

    What a bucket adds to itself comes in waves, as many as its letter's longest run.
    """
    n, size = len(text), np.bincount(text)
    letters = text.astype(np.int64)
    head = np.append(0, size.cumsum())
    out = np.full(n, -1, np.int64)
    seeds = leftmost
    seed_ends = np.searchsorted(letters[seeds], np.arange(len(size) + 1))
    ends = head[:-1].copy()
    for c in np.flatnonzero(size):
        at = head[c]
        while at < ends[c]:
            wave, at = out[at : ends[c]], ends[c]
            before = wave[wave > 0] - 1
            same = before[(letters[before] == c) & ~smaller[before]]
            out[ends[c] : ends[c] + len(same)] = same
            ends[c] += len(same)
        scanned = np.concatenate([out[head[c] : ends[c]], seeds[seed_ends[c] : seed_ends[c + 1]]])
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before] & (letters[before] > c)]
        _place(before, letters[before], out, ends, 1)
    larger_ends = ends
    ends = head[1:] - 1
    for c in np.flatnonzero(size)[::-1]:
        at = head[c + 1] - 1
        while at > ends[c]:
            wave, at = out[ends[c] + 1 : at + 1][::-1], ends[c]
            before = wave[wave > 0] - 1
            same = before[(letters[before] == c) & smaller[before]]
            out[ends[c] - len(same) + 1 : ends[c] + 1] = same[::-1]
            ends[c] -= len(same)
        scanned = np.concatenate([out[ends[c] + 1 : head[c + 1]][::-1], out[head[c] : larger_ends[c]][::-1]])
        before = scanned[scanned > 0] - 1
        before = before[smaller[before] & (letters[before] < c)]
        _place(before, letters[before], out, ends, -1)
    out[0] = n - 1
    return out


def bounded_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether ``data`` (bytes, at least ``length`` from each place) agrees over ``length`` bytes at places ``a`` and ``b``, eight bytes at a time."""
    words = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))
    same = np.ones(len(a), bool)
    going = np.arange(len(a))
    for k in [*range(0, length - 8, 8), length - 8]:
        going = going[words[a[going] + k] == words[b[going] + k]]
        if not len(going):
            break
    same[:] = False
    same[going] = True
    return same


def permuted_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """By place in the text: whether the suffix shares ``length`` bytes with the one before it in ``order``.

    ``order`` holds the places to compare, in suffix order; comparing in text order keeps reads close together.
    """
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before >= 0)
    out = np.zeros(len(data), bool)
    out[places] = bounded_prefixes(data, places, before[places], length)
    return out
