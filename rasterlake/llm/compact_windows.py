"""Operator 8, substring dedup: near-duplicate passages by compact windows.

Tokens are 5-word shingles (A-Z in lower case). For each of ``functions`` hash functions, the Cartesian tree over a
text's token hashes groups all subsequences with the same least token into compact windows (left, place, right):
every passage [i, j] with left <= i <= place <= j <= right has that token as its min-hash. Only windows
of ``min_words`` words or more are made: their places are the minima of the sliding windows of that width, and the tree over
these places alone gives their exact extents.

1. Texts equal to an earlier one, by SHA-256, are passages as a whole; they make no windows, as the earlier one has them all.
2. Windows meet by min-hash, in tasks and then in shards, whose number follows the input, and are joined on the intervals around their places. A window that has
   ``min_words`` words around it in common with an earlier document repeats that stretch and is linked to the earliest document that has it, so a hot passage makes
   a link a document. A task looks for all such stretches in its texts and verifies those pairs at once; shards look at some places (``OFFSETS``).
3. Of two passages that are alike to 0.8, an edit takes four tokens at least and all edits a ninth of them, so what they share are runs of over twenty tokens on
   average, and a common least token has equal tokens on one side of it. A window without a common stretch is therefore linked, for each length in ``CONTEXTS``
   and each side, to the earliest and to the nearest earlier document with the same min-hash and that context: documents that share only a phrase fall into other
   classes than those that share the passage. No pairs are made inside a class; the links of a window are bounded, those of all functions are merged by pair of documents.
4. What these links leave out is compared after that, whole: two passages that are near enough share a run of ``least_run`` tokens (21 for 50 words and 0.8), and all documents with such
   a run in common meet at the least token of one function in it, on the stretch around it. Of these pairs only those are left whose later document has a passage there
   already and is in one component with the earlier one, so that nothing could be added to classes or cuts. Classes of more than ``CROWD`` documents compare what their members have around the run by themselves (``linking``),
   as long as it can add something, and return the pairs that do.
5. Both texts' tokens in the ranges of linked windows are compared: all runs of equal tokens are chained in the order of both texts, and a passage is the longest range of a
   chain whose Jaccard similarity to the range it matches is ``similarity`` or more, without ends that hold more other tokens than shared ones.

Result: a row per passage of a document that repeats in an earlier one, with word and character ranges in both. Null texts are empty;
texts under ``min_words`` words have no passages; of repeated rows (one doc_id twice) none is earlier than the other; rows with a
null doc_id are left out. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import SPACE_CLASS, among, batched, components, flagged, id_text, in_rows, requested, written
from rasterlake.llm.grams import shingles, words
from rasterlake.llm.jaccard_join import shared_counts
from rasterlake.llm.suffix_dedup import mixed

SIZE = 5
#: Tokens before a window's place at which stretches begin that go to the shuffle, as shares of the longest way.
OFFSETS = (0, 0.5, 1)
STRETCHES = [f"s{k}" for k in range(len(OFFSETS))]
#: Tokens of the contexts on each side of a window's place, itself included.
CONTEXTS = (8, 15, 30)
SIDES = [f"c{n}{side}" for n in CONTEXTS for side in "ab"]
ROW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("place", "<i4"), ("left", "<i4"), ("right", "<i4"), ("linked", "i1"), *((c, "<u4") for c in STRETCHES), *((c, "<u2") for c in SIDES)])
LINK = np.dtype([("a", "<i8"), ("b", "<i8"), ("a_from", "<i4"), ("a_to", "<i4"), ("b_from", "<i4"), ("b_to", "<i4")])
#: Shifts between two texts along which runs are taken for one passage's.
NEAR_SHIFT = 16
#: Documents of one class up to which all pairs of it are compared without looking at the others', and those of a block.
CROWD, BLOCK = 4, 1000
MEMBER = np.dtype([("key", "<u8"), ("doc", "<i8"), ("group", "<i8"), ("known", "i1"), ("lo", "<i4"), ("hi", "<i4")])
LINKS = "a long, b long, a_from int, a_to int, b_from int, b_to int"
CROWDED = ["key", "doc", "group", "known", "lo", "hi"]
PASSAGE = "doc_id long, source_doc_id long, start_word int, end_word int, source_start_word int, source_end_word int, shared int, similarity double"
COLUMNS = [c.split(" ")[0] for c in PASSAGE.split(", ")]


def least_places(values: np.ndarray, width: int, chunk: int = 1 << 14) -> np.ndarray:
    """Leftmost place of the least of ``width`` 32-bit values from each place on: value and place are one number, so that minima of pairs do."""
    out = np.empty(len(values) - width + 1, np.int64)
    for at in range(0, len(out), chunk):
        part = values[at : at + chunk + width - 1]
        key = (part.astype(np.uint64) << np.uint64(32)) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            key = np.minimum(key[:-step], key[step:])
            reach += step
        out[at : at + len(key)] = (key & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
    return out


def compact_windows(tokens: np.ndarray, text: np.ndarray, good: np.ndarray, width: int, function: int) -> np.ndarray:
    """Windows of at least ``width`` tokens: rows (token's place, left, right), places in the concatenated tokens."""
    if len(tokens) < width:
        return np.empty((0, 3), np.int64)
    factor = np.uint64((0xD1342543DE82EF95 * (2 * function + 1)) % (1 << 64))
    value = (mixed(tokens ^ np.uint64(function * 0x51ED270B)) * factor) >> np.uint64(32)
    value = value.astype(np.uint32)
    place = least_places(value, width)
    whole = good[: len(place)] & good[width - 1 :] & (text[: len(place)] == text[width - 1 : len(tokens)])
    place = place[whole]
    if not len(place):
        return np.empty((0, 3), np.int64)
    at = place[np.append(True, place[1:] != place[:-1])]
    v, t = value[at], text[at]
    # Nearest smaller to the left (an equal one counts) and to the right, by following the neighbours' own answers.
    n = len(at)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    open_ = np.arange(n)
    while len(open_):
        near = before[open_]
        open_ = open_[(near >= 0) & (t[near] == t[open_]) & (v[near] > v[open_])]
        before[open_] = before[before[open_]]
    open_ = np.arange(n)
    while len(open_):
        near = np.minimum(after[open_], n - 1)
        open_ = open_[(after[open_] < n) & (t[near] == t[open_]) & (v[near] >= v[open_])]
        after[open_] = after[after[open_]]
    first = np.searchsorted(text, t, "left")
    last = np.searchsorted(text, t, "right") - SIZE  # the last tokens of a text would reach into the next
    left = np.where((before >= 0) & (t[before] == t), at[before] + 1, first)
    right = np.where((after < n) & (t[np.minimum(after, n - 1)] == t), at[np.minimum(after, n - 1)] - 1, last)
    keep = right - left + 1 >= width
    return np.stack([at, left, right], 1)[keep]


def matches(a: np.ndarray, b: np.ndarray, most: int | None = None, order: np.ndarray | None = None) -> np.ndarray:
    """Maximal runs of equal tokens: rows (place in a, place in b, length), by place. ``order`` sorts b.

    With ``most``, a token that stands more often in b is placed by what is around it: at the first ``most`` places of the token and of each stretch of 2, 4, .. tokens
    that begins with it, and at its places nearest to where the tokens before and behind it that are rare in b would put it. Runs go as far as tokens are equal, so a
    phrase that b has again and again is part of any run that begins or ends outside of it. Of the runs through a place, the ``most`` with the most support remain; ``open_shifts`` has the rest.
    """
    order = np.argsort(b, kind="stable") if order is None else order
    first, last = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = np.minimum(last - first, most or len(b))
    i, j = _placed(np.arange(len(a)), first, count, order)
    if most and (often := last - first > most).any():
        stretches, power = [a, b], 1
        waiting = np.flatnonzero(often)
        while len(waiting) and 2 * power <= min(len(a), len(b)):
            stretches = [mixed(x[:-power] * np.uint64(0x9E3779B97F4A7C15) + x[power:]) for x in stretches]
            power *= 2
            waiting = waiting[waiting < len(stretches[0])]
            by = np.argsort(stretches[1], kind="stable")
            lo, hi = (np.searchsorted(stretches[1][by], stretches[0][waiting], side) for side in ("left", "right"))
            more = _placed(waiting, lo, np.minimum(hi - lo, most), by)
            i, j = np.append(i, more[0]), np.append(j, more[1])
            waiting = waiting[hi - lo > most]
        near = _nearest(np.flatnonzero(often), np.flatnonzero((last > first) & ~often), first, last, order, most)
        return supported(extended(a, b, np.append(i, near[0]), np.append(j, near[1])), len(a), most)
    o = np.lexsort((i, i - j))
    i, j = i[o], j[o]
    begin = np.flatnonzero(np.append(True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1))[: len(i)])
    runs = np.column_stack([i[begin], j[begin], np.diff(np.append(begin, len(i)))])
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def _placed(at: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``at`` with ``count`` entries of ``order`` from ``first`` on."""
    i = np.repeat(at, count)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count - first, count)] if len(i) else i


def _nearest(often: np.ndarray, rare: np.ndarray, first: np.ndarray, last: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a token that b has often: its places next to where each place of the nearest rare token, before and behind, would have it."""
    if not len(rare):
        return often[:0], often[:0]
    after = np.searchsorted(rare, often)
    made = [(often[:0], often[:0])]
    for side in (after - 1, after):
        ok = (side >= 0) & (side < len(rare))
        at, anchor = often[ok], rare[side[ok]]
        for k in range(most):
            has = first[anchor] + k < last[anchor]
            i, r = at[has], anchor[has]
            want = order[first[r] + k] + i - r
            # Places of one token are in ascending order, so bisection between its first and its last finds the next one.
            lo, hi = first[i].copy(), last[i].copy()
            while (go := lo < hi).any():
                mid = (lo + hi) // 2
                less = order[np.minimum(mid, len(order) - 1)] < want
                lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
            for x in (lo - 1, lo):
                inside = (x >= first[i]) & (x < last[i])
                made.append((i[inside], order[x[inside]]))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def supported(runs: np.ndarray, size: int, most: int, near: int = NEAR_SHIFT) -> np.ndarray:
    """Runs in order of what is equal along about the same shift between the texts, if half of their places are in fewer than ``most`` runs before them: texts that repeat themselves have a run for each pair of periods."""
    shift = (runs[:, 0] - runs[:, 1]) // near
    shift -= shift.min()
    total = np.bincount(shift, runs[:, 2], shift.max() + 3)
    total = total + np.append(0, total[:-1]) + np.append(total[1:], 0)
    covered, keep = np.zeros(size, np.int64), []
    for k in np.lexsort((runs[:, 1], runs[:, 0], -runs[:, 2], -total[shift])).tolist():
        x, _, n = runs[k]
        if 2 * (covered[x : x + n] < most).sum() >= n:
            covered[x : x + n] += 1
            keep.append(k)
    return runs[np.sort(keep)]


def extended(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The maximal runs of equal tokens through the pairs of places: rows (place in a, place in b, length), each once, by place."""
    base, most = 0x9E3779B97F4A7C15, max(len(a), len(b))
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(most, x, np.uint64)), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    sums = [np.append(np.uint64(0), np.cumsum(mixed(x) * power[: len(x)], dtype=np.uint64)) for x in (a, b)]

    def equal(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        ok = (x >= 0) & (y >= 0) & (x + n <= len(a)) & (y + n <= len(b))
        x, y = np.where(ok, x, 0), np.where(ok, y, 0)
        u, v = np.minimum(x + n, len(a)), np.minimum(y + n, len(b))
        return ok & ((sums[0][u] - sums[0][x]) * back[x] == (sums[1][v] - sums[1][y]) * back[y])

    pairs = np.unique(i.astype(np.int64) * (len(b) + 1) + j)
    i, j = pairs // (len(b) + 1), pairs % (len(b) + 1)
    ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for n in (1 << t for t in reversed(range(max(1, min(len(a), len(b))).bit_length()))):
        ahead += n * equal(i + ahead, j + ahead, n)
        behind += n * equal(i - behind - n, j - behind - n, n)
    runs = np.unique(np.column_stack([i - behind, j - behind, behind + ahead]), axis=0)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def chain(runs: np.ndarray, reach: int, gap_cost: float = 0.1) -> tuple[list[int], list[int]]:
    """The runs in the order of both texts that share most, and how much of each the one before it has; a gap costs too little to part a range that is near enough."""
    p, q, n = runs.T
    if (p[1:] >= (p + n)[:-1]).all() and (q[1:] >= (q + n)[:-1]).all():
        # All runs follow each other in both texts: the best one before a run is the last, as going by way of it adds its tokens.
        cost = np.where(p[1:] - (p + n)[:-1] > reach, np.inf, gap_cost * (p[1:] + q[1:] - (p + q + 2 * n)[:-1])).tolist()
        most, now, at, first = float(n[0]), float(n[0]), (0, 0), 0
        for k, (size, c) in enumerate(zip(n[1:].tolist(), cost, strict=True), 1):
            now, first = (now - c + size, first) if now >= c else (float(size), k)
            if now > most:
                most, at = now, (first, k)
        path = list(range(at[0], at[1] + 1))
        return path, [0] * len(path)
    best, before, cover = n.astype(float), np.full(len(runs), -1), np.zeros(len(runs), np.int64)
    end = np.maximum.accumulate(p + n)
    for k in range(1, len(runs)):
        lo = int(np.searchsorted(end[:k], p[k] - reach))
        over = np.maximum(np.maximum(p[lo:k] + n[lo:k] - p[k], q[lo:k] + n[lo:k] - q[k]), 0)
        gap = p[k] + q[k] + 2 * over - p[lo:k] - q[lo:k] - 2 * n[lo:k]
        gain = np.where((p[lo:k] < p[k]) & (q[lo:k] < q[k]) & (over < n[k]), best[lo:k] - over - gap_cost * gap, -1.0)
        if len(gain) and gain[m := int(gain.argmax())] >= 0:
            best[k], before[k], cover[k] = n[k] + gain[m], lo + m, over[m]
    k, path = int(best.argmax()), []
    while k >= 0:
        path.append(k)
        k = int(before[k])
    return path[::-1], [int(cover[k]) for k in path[::-1]]


def near_ranges(chosen: np.ndarray, over: np.ndarray, a: np.ndarray, b: np.ndarray, need: float, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """Of one chain the longest range that is near enough, then the longest before and behind it."""
    start, other, n = chosen.T
    stop, there = start + n, other + n
    sums = np.append(0, np.cumsum(n - over))
    low = (1 + similarity) * (sums[:-1] - over) - similarity * (start + other)
    high = (1 + similarity) * sums[1:] - similarity * (stop + there)
    made, waiting = [], [(0, len(chosen))]
    while waiting:
        x, y = waiting.pop()
        if y <= x or sums[y] - sums[x] + over[x] < need:
            continue
        # The first start that is low enough, for each end.
        least = np.minimum.accumulate(low[x:y])
        k = np.searchsorted(-least, -high[x:y] - 1e-9) + x
        ends = np.arange(x, y)
        fits = k <= ends
        k = np.minimum(k, ends)
        length = np.where(fits & (sums[ends + 1] - sums[k] + over[k] >= need), stop[ends] - start[k], -1)
        e = int(length.argmax())
        if length[e] < 0:
            continue
        k, e = int(k[e]), x + e
        lo, hi = k, e
        # Ends that hold more other tokens than shared ones are left off.
        while hi > lo and n[hi] - over[hi] < start[hi] + over[hi] - stop[hi - 1] and sums[hi] - sums[lo] + over[lo] >= need:
            hi -= 1
        while hi > lo and n[lo] < start[lo + 1] - stop[lo] and sums[hi + 1] - sums[lo + 1] + over[lo + 1] >= need:
            lo += 1
        u, v, w, z = int(start[lo]), int(stop[hi]), int(other[lo]), int(there[hi])
        s, t = np.unique(a[u:v]), np.unique(b[w:z])
        both = len(np.intersect1d(s, t, True))
        score = both / (len(s) + len(t) - both)
        if score >= similarity:
            made.append((u, v, w, z, both, score))
            waiting += [(hi + 1, y), (x, lo)]
        else:
            # Repeated tokens make it too unlike as a set: part it at its widest gap.
            cut = lo + 1 + int((start[lo + 1 : hi + 1] + other[lo + 1 : hi + 1] - stop[lo:hi] - there[lo:hi]).argmax())
            waiting += [(cut, y), (x, cut)]
    return made


def repeated_ranges(a: np.ndarray, b: np.ndarray, hit: np.ndarray, where: np.ndarray, need: float, width: int, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """Stretches full of shared tokens that stand in them again and again, in whatever order: alike as sets, from the first such token to the last."""
    total = np.append(0, np.cumsum(hit))
    edge = np.diff((total[width:] - total[:-width] >= need).astype(np.int8), prepend=0, append=0)
    out = []
    for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + width - 1, strict=True):
        at = np.flatnonzero(hit[x:y]) + x
        u, v, w, z = int(at[0]), int(at[-1]) + 1, int(where[at].min()), int(where[at].max()) + 1
        s = np.unique(a[u:v])
        if 2 * len(s) > v - u:
            continue
        t = np.unique(b[w:z])
        both = len(np.intersect1d(s, t, True))
        if (score := both / (len(s) + len(t) - both)) >= similarity:
            out.append((u, v, w, z, both, score))
    return out


def outside(runs: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """What is left of ``runs`` without the places of a that are ``taken``."""
    if not taken.any():
        return runs
    at = np.repeat(np.arange(len(runs)), runs[:, 2])
    step = np.arange(len(at)) - np.repeat(np.cumsum(runs[:, 2]) - runs[:, 2], runs[:, 2])
    free = ~taken[runs[at, 0] + step]
    at, step = at[free], step[free]
    if not len(at):
        return runs[:0]
    begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (step[1:] != step[:-1] + 1)))
    out = np.column_stack([runs[at[begin], 0] + step[begin], runs[at[begin], 1] + step[begin], np.diff(np.append(begin, len(at)))])
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def passages(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """Passages of ``a`` that are near ``b``: (start, end, start in b, end in b, shared, similarity), token ranges, ends exclusive.

    Two ranges of ``width`` distinct tokens with Jaccard similarity s share 2 s / (1 + s) of them. Runs of equal tokens are chained in the order of both
    texts, and ranges of a chain that are near enough are passages: first of what no passage has yet, then of all runs that reach out of the passages found.
    """
    need = 2 * similarity / (1 + similarity) * width - 1e-9
    if len(a) < width or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    found = np.searchsorted(b[order], a)
    found[found == len(b)] = 0
    hit = b[order[found]] == a
    total = np.append(0, np.cumsum(hit))
    # A range with ``similarity`` of its tokens shared has a stretch of ``width`` tokens that is no more than one stretch's share below that.
    if total[-1] < need or (total[width:] - total[:-width]).max() < (2 * similarity - 1) * width - 1:
        return []
    out = repeated_ranges(a, b, hit, order[found], need, width, similarity)
    taken = np.zeros(len(a), bool)
    for u, v, *_ in out:
        taken[u:v] = True

    def dense(runs: np.ndarray) -> np.ndarray:
        """Runs that can be in a range of which shared tokens make ``similarity`` or more, with one that isn't taken."""
        if runs[:, 2].sum() < need:
            return runs[:0]
        here = np.zeros(len(a) + 1, np.int64)
        np.add.at(here, runs[:, 0], 1)
        np.add.at(here, runs[:, 0] + runs[:, 2], -1)
        hit = here.cumsum()[:-1] > 0
        if not (hit & ~taken).any():
            return runs[:0]
        v = np.append(0, np.cumsum(hit - similarity))
        inside = np.maximum.accumulate(v[:0:-1])[::-1] - np.minimum.accumulate(v[:-1]) >= -1e-6
        part = np.cumsum(np.diff(inside.astype(np.int8), prepend=0) == 1)
        enough = (np.bincount(part, hit & inside) >= need) & (np.bincount(part, hit & inside & ~taken) > 0)
        good = np.append(0, np.cumsum(inside & enough[part]))
        return runs[good[runs[:, 0] + runs[:, 2]] > good[runs[:, 0]]]

    if not (hit & ~taken).any():
        return out
    reach = int(min(len(a), len(b)) * (1 - similarity) / similarity) + 1

    parted = False  # a chain over several shifts had nothing, so its runs may belong to others

    def near(every: np.ndarray, least: float = 0) -> list[tuple[int, int, int, int, int, float]]:
        """Near ranges of chains of these runs, with ``least`` distinct tokens shared; their places are taken then."""
        nonlocal parted
        found = []
        for all_runs in (False, True):
            runs = dense(every if all_runs else outside(every, taken))
            while len(runs):
                path, cover = chain(runs, reach)
                over = np.array(cover)
                if (runs[path, 2] - over).sum() < need:
                    break
                made = [x for x in near_ranges(runs[path], over, a, b, need, similarity) if x[4] >= least and not taken[x[0] : x[1]].all()]
                for u, v, *_ in made:
                    taken[u:v] = True
                if not made:
                    parted = parted or np.ptp(runs[path, 0] - runs[path, 1]) > NEAR_SHIFT
                    runs = np.delete(runs, path, 0)
                runs = dense(runs if all_runs else outside(runs, taken))
                found += made
        return found

    out += near(outside(matches(a, b, 3, order), taken))
    # Runs beyond the three of a place: all that are along one shift between the texts are chained by themselves, wherever they can still add something.
    # Stretches of few tokens again and again are taken by now.
    for shift in open_shifts(a, b, order, taken, need, 0 if parted else 3):
        out += near(runs_along(a, b, shift, shift + 3 * NEAR_SHIFT), need)
    return out


def open_shifts(a: np.ndarray, b: np.ndarray, order: np.ndarray, taken: np.ndarray, need: float, most: int, chunk: int = 1 << 20) -> Iterator[int]:
    """Where shifts (place in a less place in b) begin whose ``3 * NEAR_SHIFT`` next ones have ``need`` distinct tokens in common, and a place that isn't ``taken``; most tokens first.

    None if every token of a stands in b ``most`` times or less, as then ``matches`` has left no run out. Edits move a passage of the least length by fewer than ``NEAR_SHIFT`` places, so it lies within one such stretch of shifts.
    """
    ordered = b[order]
    first = np.searchsorted(ordered, a, "left")
    count = np.searchsorted(ordered, a, "right") - first
    hits = np.flatnonzero(count)
    if count.max() <= most or taken[hits].all():
        return
    token, which = np.unique(a[hits], return_inverse=True)
    by = np.argsort(which, kind="stable")
    hits, which = hits[by], which[by]
    bands, sums = (len(a) + len(b)) // NEAR_SHIFT + 4, np.append(0, np.cumsum(count[hits]))
    several, free = np.zeros(bands - 2, np.int64), np.zeros(bands, bool)
    step = max(1, (chunk << 2) // bands)
    for t in range(0, len(token), step):  # tokens whose flags for all bands are of bounded size, and some of their pairs of places at a time
        has = np.zeros((min(step, len(token) - t), bands), bool)
        x, stop = np.searchsorted(which, (t, t + step)).tolist()
        while x < stop:
            y = min(stop, max(x + 1, int(np.searchsorted(sums, sums[x] + chunk, "right")) - 1))
            at = hits[x:y]
            i, j = _placed(at, first[at], count[at], order)
            band = (i - j + len(b)) // NEAR_SHIFT
            has[np.repeat(which[x:y] - t, count[at]), band] = True
            free[band[~taken[i]]] = True
            x = y
        several += (has[:, :-2] | has[:, 1:-1] | has[:, 2:]).sum(0)
    often = np.flatnonzero((several >= need) & (free[:-2] | free[1:-1] | free[2:]))
    for k in often[np.argsort(-several[often], kind="stable")].tolist():
        if not taken[hits].all():
            yield k * NEAR_SHIFT - len(b)


def runs_along(a: np.ndarray, b: np.ndarray, least: int, end: int) -> np.ndarray:
    """All maximal runs of equal tokens whose shift is ``least`` or more and below ``end``: rows as of ``matches``."""
    made = [np.empty((0, 3), np.int64)]
    for shift in range(max(least, 1 - len(b)), min(end, len(a))):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        edge = np.diff((a[lo:hi] == b[lo - shift : hi - shift]).view(np.int8), prepend=0, append=0)
        begin = np.flatnonzero(edge == 1)
        made.append(np.column_stack([begin + lo, begin + lo - shift, np.flatnonzero(edge == -1) - begin]))
    runs = np.concatenate(made)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def stretch_hashes(tokens: np.ndarray, text: np.ndarray, good: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` tokens from each place on; 0 where they aren't of one text."""
    if len(tokens) < width:
        return np.zeros(len(tokens), np.uint64)
    base = 0x9E3779B97F4A7C15
    power = np.cumprod(np.append(np.uint64(1), np.full(len(tokens), base, np.uint64)), dtype=np.uint64)
    back = np.cumprod(np.append(np.uint64(1), np.full(len(tokens), pow(base, -1, 1 << 64), np.uint64)), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(mixed(tokens) * power[:-1], dtype=np.uint64))
    n = len(tokens) - width + 1
    whole = good[:n] & good[width - 1 :] & (text[:n] == text[width - 1 : len(tokens)])
    return np.append(np.where(whole, mixed((sums[width:] - sums[:n]) * back[:n]) | np.uint64(1), np.uint64(0)), np.zeros(width - 1, np.uint64))


def earliest(group: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each entry the least ``row`` of its ``group``."""
    order = np.lexsort((row, group))
    new = np.append(True, group[order][1:] != group[order][:-1])[: len(order)]
    out = np.empty(len(row), np.int64)
    out[order] = row[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else row
    return out


def begins(*columns: np.ndarray) -> np.ndarray:
    """For each row of sorted columns the first row that is equal in them."""
    new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], 0))[: len(columns[0])]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.empty(0, np.int64)


def window_links(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked rows, later and earlier; ``rows`` are in order of key, document and place."""
    key, doc = rows["key"], rows["doc"]
    first, own = begins(key), begins(key, doc)
    at = np.flatnonzero(np.bincount(first, own != first, len(rows))[first] > 0)  # keys of several documents
    linked = rows["linked"] != 0

    def classes(r: np.ndarray, column: str) -> np.ndarray:
        return mixed(key[r] ^ (rows[column][r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    for c in STRETCHES:
        r = at[rows[c][at] != 0]
        head = earliest(classes(r, c), r)
        use = doc[head] != doc[r]
        linked[r[use]] = True
        yield r[use], head[use]
    for c in SIDES:
        r = at[rows[c][at] != 0]
        r = r[np.argsort(classes(r, c), kind="stable")]
        group = classes(r, c)
        head, mine = begins(group), begins(group, doc[r])
        use = np.flatnonzero((mine > head) & ~linked[r])
        yield np.concatenate([r[use], r[use]]), np.concatenate([r[head[use]], r[mine[use] - 1]])


def merged(links: np.ndarray) -> np.ndarray:
    """One link for each pair of documents, with the widest ranges."""
    links = links[np.lexsort((links["b"], links["a"]))]
    if not len(links):
        return links
    at = np.flatnonzero(np.append(True, (links["a"][1:] != links["a"][:-1]) | (links["b"][1:] != links["b"][:-1])))
    out = links[at].copy()
    for c, f in (("a_from", np.minimum), ("a_to", np.maximum), ("b_from", np.minimum), ("b_to", np.maximum)):
        out[c] = f.reduceat(links[c], at)
    return out


def least_run(width: int, similarity: float) -> int:
    """Tokens in a row that two passages of ``width`` tokens and that similarity share at least.

    Each gap between runs costs both passages SIZE - 1 tokens or more that span it, unless words repeat just there; so k gaps ask for enough shared tokens, in k + 1 runs.
    """
    need = 2 * similarity / (1 + similarity) * width - 1e-9
    each = 2 * (SIZE - 1) * similarity / (1 - similarity) if similarity < 1 else np.inf
    return int(min(np.ceil(max(need, each * k if k else 0.0) / (k + 1)) for k in range(int(need) + 1)))


def starts_of(run: int) -> tuple[int, list[int]]:
    """Length of the stretches around a place in a run, and how far before the place they start: one of them is in the run, wherever the place is."""
    slack = run // 4
    return run - slack, [min(k, run - slack - 1) for k in range(0, run, slack + 1)]


def rest_dtype(run: int) -> np.dtype:
    return np.dtype([("token", "<u8"), ("doc", "<i8"), ("group", "<i8"), ("place", "<i4"), ("known", "i1"), *((f"p{k}", "<u8") for k in range(len(starts_of(run)[1])))])


def run_places(ids: list[int], groups: list[int], known: list[list[tuple[int, int]]], held: list[bytes], run: int) -> np.ndarray:
    """A row for each place at which texts with a common run meet: whether a known passage has it, and the hashes of the stretches around it."""
    part, starts = starts_of(run)
    tokens, good, text = tokens_of(held)
    at = compact_windows(tokens, text, good, run, 0)[:, 0]
    first, t = np.searchsorted(text, np.arange(len(held))), text[at]
    inside = np.zeros(len(tokens) + 1, bool)
    for k, spans in enumerate(known):
        for a, b in spans:
            inside[first[k] + a : first[k] + b] = True
    rows = np.zeros(len(at), rest_dtype(run))
    rows["token"] = mixed(tokens[at])
    rows["doc"], rows["group"] = np.array(ids, np.int64)[t], np.array(groups, np.int64)[t]
    rows["place"], rows["known"] = at - first[t], inside[at]
    hashes = stretch_hashes(tokens, text, good, part)
    for k, before in enumerate(starts):
        start = np.maximum(at - before, 0)
        rows[f"p{k}"] = np.where((at >= before) & (text[start] == t), hashes[start], np.uint64(0))
    return rows


def open_classes(rows: np.ndarray, column: str) -> np.ndarray:
    """Documents by class of that stretch, first and last place in it, where a pair can still add something: rows (key, doc, group, known, lo, hi), in order of key and document."""
    rows = rows[rows[column] != 0]
    rows = rows[np.lexsort((rows["place"], rows["doc"], rows[column]))]
    key, doc = rows[column], rows["doc"]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(rows)]
    at = np.flatnonzero(new)
    out = np.zeros(len(at), MEMBER)
    if not len(at):
        return out
    out["key"], out["doc"], out["group"] = key[at], doc[at], rows["group"][at]
    out["known"] = np.minimum.reduceat(rows["known"], at)
    out["lo"], out["hi"] = rows["place"][at], np.maximum.reduceat(rows["place"], at)
    head = begins(out["key"])
    size = np.bincount(head, minlength=len(out))[head]
    # The earliest document of a class needs no earlier one.
    wants = (head != np.arange(len(out))) & ((out["known"] == 0) | (out["group"] != out["group"][head]))
    return out[(size > 1) & (np.bincount(head, wants, len(out))[head] > 0)]


def joined_classes(rows: np.ndarray, columns: list[str]) -> np.ndarray:
    """For each row the least hash of its class: places of one token belong together if they have one of the stretches around them in common, directly or by way of others."""
    # One stretch around different places of it makes different classes.
    every, place = np.unique(np.concatenate([mixed(rows[c] + np.uint64(k)) | np.uint64(1) for k, c in enumerate(columns)]), return_inverse=True)
    place, label = place.reshape(len(columns), len(rows)), np.arange(len(every))
    has = np.stack([rows[c] != 0 for c in columns])
    while True:
        least = np.where(has, label[place], len(every)).min(0)
        new = label.copy()
        for k in range(len(columns)):
            np.minimum.at(new, place[k][has[k]], least[has[k]])
        if (new == label).all():
            return np.where(has.any(0), every[np.minimum(least, len(every) - 1)], np.uint64(0)) if len(every) else np.zeros(len(rows), np.uint64)
        label = new


def open_pairs(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Which pairs of members can add a passage to the later document or join two components."""
    return (later["doc"] > earlier["doc"]) & ((later["known"] == 0) | (later["group"] != earlier["group"]))


def member_links(later: np.ndarray, earlier: np.ndarray, reach: int) -> np.ndarray:
    links = np.empty(len(later), LINK)
    for name, r in (("a", later), ("b", earlier)):
        links[name] = r["doc"]
        links[f"{name}_from"], links[f"{name}_to"] = np.maximum(r["lo"] - reach, 0), r["hi"] + reach + 1
    return links


class Around:
    """What can be near around the places at which members of a class meet: an upper bound for any two of them, without comparing them."""

    def __init__(self, members: np.ndarray, texts: list[np.ndarray], need: float, similarity: float, reach: int):
        self.need, self.similarity, self.reach, self.members = need, similarity, reach, members
        sizes = np.array([len(t) for t in texts], np.int64)
        ids, inverse = np.unique(np.concatenate([np.empty(0, np.uint64), *texts]), return_inverse=True)
        self.tokens, owner = len(ids), np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(inverse)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # A column is a place as seen from the common token, which all have in column ``reach``.
        column = place + np.repeat(reach - np.minimum(members["lo"], reach), sizes)
        self.one_place = members["lo"] == members["hi"]
        inside = column <= 2 * reach
        self.at = np.full((len(texts), 2 * reach + 1), self.tokens, np.int32)
        self.at[owner[inside], column[inside]] = inverse[inside]
        # A token that a member has again counts once among the distinct ones, so that no place of it counts as one that isn't shared.
        key = owner * np.int64(self.tokens + 1) + inverse
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        self.loss = np.zeros(self.at.shape, np.float32)
        self.loss[owner[inside], column[inside]] = np.where(again[inside], 0, similarity)
        by = np.argsort(inverse, kind="stable")
        self.owner, self.begin = owner[by], np.searchsorted(inverse[by], np.arange(self.tokens + 1))
        self.mine = np.split(inverse, np.cumsum(sizes)[:-1])
        # Each token's members once.
        self.single = np.append(True, (self.owner[1:] != self.owner[:-1]) | (inverse[by][1:] != inverse[by][:-1]))[: len(self.owner)]

    def hits(self, u: int, where: np.ndarray | None = None) -> np.ndarray:
        """For each member how many places of u, of those in ``where``, have a token that it has."""
        token, times = np.unique(self.mine[u] if where is None else self.mine[u][where], return_counts=True)
        first = self.begin[token]
        which, at = _placed(np.arange(len(token)), first, self.begin[token + 1] - first, np.arange(len(self.owner)))
        once = self.single[at]
        return np.bincount(self.owner[at[once]], times[which[once]], len(self.at))

    def adds(self, u: int, covered: np.ndarray) -> np.ndarray:
        """Which members can have a passage over a place of u that isn't ``covered``: it begins and ends with shared tokens, so one of them isn't covered unless it closes a gap."""
        if (np.diff(covered.astype(np.int8), prepend=0) == 1).sum() > 1:
            return np.ones(len(self.at), bool)
        return self.hits(u, ~covered) > 0

    def may(self, u: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` can have a near passage over the place that they have in common with u.

        A range of each text around that place is near enough if (1 + s) shared tokens are s times both ranges' tokens or more, and ``need`` are shared. Shared places gain
        and others lose; the best ranges of both texts are taken by themselves, with the missing shared tokens at some prices: if that falls short at one price, no range will do.
        """
        ok = np.ones(len(others), bool)
        if not self.one_place[u]:
            return ok
        rest = np.flatnonzero(self.one_place[others])
        row = np.full(len(self.at), -1)
        row[others] = np.arange(len(others))
        mine = self.at[u]
        columns = np.flatnonzero(mine < self.tokens)
        first = self.begin[mine[columns]]
        count = self.begin[mine[columns] + 1] - first
        column, who = _placed(columns, first, count, self.owner)
        hit = np.zeros((len(others), len(mine)), bool)
        hit[row[who[row[who] >= 0]], column[row[who] >= 0]] = True
        has = np.zeros(self.tokens + 1, bool)
        has[mine[columns]] = True
        back = has[self.at[others]]
        for price in (0.3, 0.15, 0.6):
            if not len(rest):
                break
            best = self._best(hit[rest], self.loss[[u]], price) + self._best(back[rest], self.loss[others[rest]], price)
            low = best - 2 * price * self.need < -1e-3
            ok[rest[low]] = False
            rest = rest[~low]
        if len(rest):
            ok[rest] = self._most(hit[rest], self.loss[[u]]) + self._most(back[rest], self.loss[others[rest]]) >= -1e-3
        return ok

    def _most(self, hit: np.ndarray, loss: np.ndarray) -> np.ndarray:
        """The best of the ranges that have ``need`` shared places."""
        value, c, need = np.where(hit, np.float32((1 - self.similarity) / 2), -loss), self.reach, int(np.ceil(self.need))
        ahead, behind = np.cumsum(value[:, c:], 1, dtype=np.float32), np.cumsum(value[:, c - 1 :: -1], 1, dtype=np.float32)
        shared_ahead, shared_behind = np.cumsum(hit[:, c:], 1, dtype=np.int16), np.cumsum(hit[:, c - 1 :: -1], 1, dtype=np.int16)
        best = np.full(len(hit), -np.inf, np.float32)
        for n in range(need + 1):
            back = np.where(shared_behind >= n, behind, -np.inf).max(1)
            best = np.maximum(best, np.where(shared_ahead >= need - n, ahead, -np.inf).max(1) + (back if n else np.maximum(back, 0)))
        return best

    def _best(self, hit: np.ndarray, loss: np.ndarray, price: float) -> np.ndarray:
        value = np.where(hit, np.float32((1 - self.similarity) / 2 + price), -loss)
        c = self.reach
        return np.cumsum(value[:, c:], 1, dtype=np.float32).max(1) + np.maximum(np.cumsum(value[:, c - 1 :: -1], 1, dtype=np.float32).max(1), 0)


def linking(members: np.ndarray, texts: list[np.ndarray], one: np.ndarray, two: np.ndarray, width: int, similarity: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of members of one class, of ``one`` and ``two``, with a passage in the ``texts`` around their common place.

    Pairs are compared one after the other, a member's nearest ones first. What they settle isn't compared any more: a member whose place lies in a passage of an earlier round meets other components only,
    and one whose place lies in a passage found here also those that share a token that no passage has. Compared is what ``passages`` can find anything in: ``need`` places of the later text have tokens of the earlier one, however often these stand there.
    Of pairs with a passage those are returned that join two components or have places of the later member that no other returned one has.
    """
    later, earlier = [], []
    if not len(one) or not len(two):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    need = 2 * similarity / (1 + similarity) * width - 1e-9
    sets = [np.unique(t) for t in texts]
    shared, again = shared_counts(sets, one, two), np.array([len(t) - len(s) for t, s in zip(texts, sets, strict=True)])
    # Ranges of few distinct tokens again and again are near with fewer tokens shared, and with fewer places of the earlier text: the bound doesn't hold for them.
    often = 2 * again >= need
    bound = Around(members, texts, need, similarity, reach)
    groups, root = np.unique(members["group"], return_inverse=True)
    known, doc = members["known"] != 0, members["doc"]
    place_in_one, place_in_two = (np.full(len(members), -1) for _ in range(2))
    place_in_one[one], place_in_two[two] = np.arange(len(one)), np.arange(len(two))
    every = np.unique(np.append(one, two))
    for u in every[np.argsort(doc[every], kind="stable")].tolist():
        k, m = place_in_one[u], place_in_two[u]
        counts = np.concatenate([shared[k] if k >= 0 else [], shared[:, m] if m >= 0 and k < 0 else []])
        others = two if k >= 0 else one
        use = (counts >= need - again[u]) & (doc[others] < doc[u])
        waiting = others[use][np.argsort(-counts[use], kind="stable")]
        settled = known[u]
        if settled:
            waiting = waiting[root[waiting] != root[u]]
        if len(waiting) and again[u]:
            waiting = waiting[bound.hits(u)[waiting] >= need]
        if not len(waiting):
            continue
        waiting = waiting[often[u] | often[waiting] | bound.may(u, waiting)]
        at, covered = min(int(members["lo"][u]), reach), np.zeros(len(texts[u]), bool)
        while len(waiting):
            v, waiting = int(waiting[0]), waiting[1:]
            made = passages(texts[u], texts[v], width, similarity)
            if not made:
                continue
            before, joins = covered.sum(), root[u] != root[v]
            for a, b, *_ in made:
                covered[a:b] = True
            if joins or covered.sum() > before:
                later.append(u)
                earlier.append(v)
            root[root == root[u]] = root[v]
            known[u] |= covered[at : at + members["hi"][u] - members["lo"][u] + 1].all()
            if settled:
                waiting = waiting[root[waiting] != root[u]]
            elif known[u] and len(waiting):
                waiting = waiting[(root[waiting] != root[u]) | bound.adds(u, covered)[waiting]]
    return np.array(later, np.int64), np.array(earlier, np.int64)


def tokens_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = words(raws)
    t, good = shingles(w, SIZE)
    return t, good, w.text


def windows_of(ids: list[int], held: list[bytes], width: int, functions: int, similarity: float) -> tuple[np.ndarray, list[dict]]:
    """Rows of the texts' windows, with those marked that have a stretch in common with an earlier text here, and the passages of such pairs."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, held = np.array([ids[k] for k in order], np.int64), [held[k] for k in order]
    tokens, good, text = tokens_of(held)
    first = np.searchsorted(text, np.arange(len(held)))
    stretch = stretch_hashes(tokens, text, good, width)
    context = [stretch_hashes(tokens, text, good, n) for n in CONTEXTS]

    def at_place(hashes: np.ndarray, at: np.ndarray, before: int) -> np.ndarray:
        start = at - before
        return np.where((start >= 0) & (text[np.maximum(start, 0)] == text[at]), hashes[np.maximum(start, 0)], np.uint64(0))

    made, pairs = [], set()
    for f in range(functions):
        got = compact_windows(tokens, text, good, width, f)
        key = mixed(tokens[got[:, 0]] + np.uint64(f))
        got, key = got[(o := np.lexsort((got[:, 0], key)))], key[o]  # texts are in order of their ids
        rows = np.zeros(len(got), ROW)
        t = text[got[:, 0]]
        rows["key"], rows["doc"] = key, ids[t]
        rows["place"], rows["left"], rows["right"] = got[:, 0] - first[t], got[:, 0] - got[:, 1], got[:, 2] - got[:, 0]
        for c, share in zip(STRETCHES, OFFSETS, strict=True):
            rows[c] = at_place(stretch, got[:, 0], int(share * (width - 1))) >> np.uint64(32)
        for c, h, before in zip(SIDES, (h for h in context for _ in "ab"), (k for n in CONTEXTS for k in (n - 1, 0)), strict=True):
            rows[c] = at_place(h, got[:, 0], before) >> np.uint64(48)
        several = begins(key)
        several = np.flatnonzero(np.bincount(several, ids[t] != ids[t[several]], len(got))[several] > 0)
        for before in range(width):
            h = at_place(stretch, got[several, 0], before)
            r = several[h != 0]
            head = earliest(mixed(key[r] ^ (h[h != 0] * np.uint64(0x9E3779B97F4A7C15))), r)
            use = ids[t[head]] != ids[t[r]]
            rows["linked"][r[use]] = 1
            pairs |= set(zip(t[r[use]].tolist(), t[head[use]].tolist(), strict=True))
        made.append(rows)
    local, span = [], np.append(first, len(tokens) + SIZE - 1)
    for d, e in sorted(pairs):
        a, b = (tokens[span[x] : max(span[x], span[x + 1] - SIZE + 1)] for x in (d, e))
        local += [dict(zip(COLUMNS, (int(ids[d]), int(ids[e]), i, j, k, m, n, s), strict=True)) for i, j, k, m, n, s in passages(a, b, width, similarity)]
    return np.concatenate(made), local


def near_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, functions: int = 6, task_bytes: int = 2 << 20, shuffle_bytes: int = 8 << 20, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per passage: doc_id, source_doc_id (an earlier document), word ranges in both, shared tokens and similarity."""
    import zstandard

    spark = docs.sparkSession
    width = min_words - SIZE + 1
    texts = id_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    # Whole copies: the earliest document of each text stands for the others.
    enough = F.size(F.filter(F.split("text", SPACE_CLASS), lambda w: w != "")) >= min_words
    marked = written(texts.where(enough).select("doc_id", F.sha2("text", 256).alias("h")), "texts")
    firsts = marked.groupBy("h").agg(F.min("doc_id").alias("source"), F.count_distinct("doc_id").alias("k")).where("k > 1")
    copies = written(marked.join(firsts, "h").where("doc_id > source").select("doc_id", F.col("source").alias("source_doc_id")).distinct(), "copies")
    copied = copies.select("doc_id").distinct()
    # Their first text has all their windows, so they make none; an id with other texts too keeps its windows.
    several = marked.groupBy("doc_id").agg(F.count_distinct("h").alias("k")).where("k > 1").select("doc_id")
    single = written(copied.join(several, "doc_id", "left_anti"), "single-copies")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress

        def dealt(made: list[np.ndarray], local: list[dict]) -> pa.RecordBatch:
            rows = np.concatenate(made)
            shard = (rows["key"] % np.uint64(shards)).astype(np.int64)
            o = np.lexsort((rows["place"], rows["doc"], shard))
            rows, shard = rows[o], shard[o]
            parts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(rows)])
            out = [(int(shard[a]), press(packed(rows[a:b])), None) for a, b in zip(parts, np.append(parts[1:], len(rows)), strict=False)]
            if local:
                out.append((local[0]["doc_id"] % shards, None, local))
            kinds = (pa.int64(), pa.binary(), LOCAL)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], ["shard", "rows", "local"])

        made, local, size = [], [], 0
        for ids, held in batched(batches, task_bytes):
            rows, found = windows_of(ids, held, width, functions, similarity)
            made.append(rows)
            local += found
            size += sum(map(len, held))
            if size >= shuffle_bytes:
                yield dealt(made, local)
                made, local, size = [], [], 0
        if made:
            yield dealt(made, local)

    LOCAL = pa.list_(pa.struct([("doc_id", pa.int64()), ("source_doc_id", pa.int64()), *((c, pa.int32()) for c in ("start_word", "end_word", "source_start_word", "source_end_word", "shared")), ("similarity", pa.float64())]))
    local_type = f"array<struct<{','.join(':'.join(c.split(' ')) for c in PASSAGE.split(', '))}>>"
    def link(part: pa.Table) -> pa.Table:
        press, open_ = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        rows = np.concatenate([np.empty(0, ROW), *(unpacked(open_(r)) for r in part["rows"].to_pylist() if r)])
        rows = rows[np.lexsort((rows["place"], rows["doc"], rows["key"]))]
        buckets, packs = [], []
        for later, earlier in window_links(rows):
            later, earlier = rows[later], rows[earlier]
            links = np.empty(len(later), LINK)
            links["a"], links["b"] = later["doc"], earlier["doc"]
            # A passage reaches as far as its window, and no farther than its likeness allows from its reach in the other text.
            for name, r, o in (("a", later, earlier), ("b", earlier, later)):
                left, right = (np.minimum(r[c], (o[c] / similarity).astype(np.int64) + 1) for c in ("left", "right"))
                links[f"{name}_from"], links[f"{name}_to"] = np.maximum(r["place"] - left - width, 0), r["place"] + right + width + 1
            links = merged(links)
            bucket = (mixed(links["a"].astype(np.uint64) * np.uint64(31) + links["b"].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            links, bucket = links[(o := np.argsort(bucket, kind="stable"))], bucket[o]
            parts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(links)])
            packs += [press(links[a:b].tobytes()) for a, b in zip(parts, np.append(parts[1:], len(links)), strict=False)]
            buckets += bucket[parts].tolist()
        local = [x for r in part["local"].to_pylist() if r for x in r]
        n = len(packs)
        return pa.table({"bucket": pa.array([*buckets, *[None] * bool(local)], pa.int64()), "links": pa.array([*packs, *[None] * bool(local)], pa.binary()), "local": pa.array([*[None] * n, *[local] * bool(local)], LOCAL)})

    own = among(texts, "doc_id", single, "left_anti")
    stage = written(own.mapInArrow(emit, f"shard long, rows binary, local {local_type}").groupBy("shard").applyInArrow(link, f"bucket long, links binary, local {local_type}"), "window-links")
    local = stage.where("local IS NOT NULL").select(F.explode("local").alias("x")).select("x.*")
    pairs = stage.where("links IS NOT NULL").select("bucket", "links").groupBy("bucket").applyInArrow(gathered, LINKS)
    # A task compared the whole texts of its own pairs.
    settled = local.select(F.col("doc_id").alias("a"), F.col("source_doc_id").alias("b")).distinct()
    pairs = written(pairs.join(copied, pairs["a"] == copied["doc_id"], "left_anti").join(settled, ["a", "b"], "left_anti"), "window-pairs")
    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for requests, held in batched(batches, task_bytes, 1, 0):
            rows = []
            tokens, _, text = tokens_of(held)
            ends = np.searchsorted(text, np.arange(len(held)), "right")
            for asked, begin, end in zip(requests, np.append(0, ends[:-1]).tolist(), np.maximum(ends - SIZE + 1, 0).tolist(), strict=True):
                rows += [(r["a"], r["b"], r["side"], r["lo"], tokens[begin + r["lo"] : max(min(begin + r["hi"], end), begin + r["lo"])].tobytes()) for r in asked]
                if len(rows) >= 2000:
                    yield excerpt_batch(rows)
                    rows = []
            if rows:
                yield excerpt_batch(rows)

    def excerpt_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["a", "b", "side", "lo", "tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 200) for whole in batches for k in range(0, len(whole), 200)):
            rows = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for i, j, k, m, n, s in passages(np.frombuffer(x["tokens"], "<u8"), np.frombuffer(y["tokens"], "<u8"), width, similarity):
                    rows.append((a, b, i + x["lo"], j + x["lo"], k + y["lo"], m + y["lo"], n, s))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64()], strict=True)], COLUMNS)

    def compared(pairs: DataFrame) -> DataFrame:
        """Passages of all ``pairs`` (a written table), in their ranges."""
        # Requests of a document come in rows of bounded size, whatever number of later ones points to it.
        sides = pairs.select(F.col("a").alias("doc_id"), F.lit(0).alias("side"), "a", "b", F.col("a_from").alias("lo"), F.col("a_to").alias("hi")).union(pairs.select("b", F.lit(1), "a", "b", "b_from", "b_to"))
        cut = requested(texts, in_rows(sides)).select("text", "asked").mapInArrow(excerpts, "a long, b long, side int, lo int, tokens binary")
        sides = cut.groupBy("a", "b").agg(*(F.max(F.when(F.col("side") == k, F.struct("lo", "tokens"))).alias(f"s{k}") for k in (0, 1)))
        return sides.where("s0 IS NOT NULL AND s1 IS NOT NULL").mapInArrow(verify, PASSAGE)

    first = written(local.join(copied, "doc_id", "left_anti").union(compared(pairs)), "linked-passages")
    rest = compared(rest_pairs(own, texts, copied, first, width, similarity, shards, task_bytes, shuffle_bytes))
    # What lies in a passage of the same two documents is known.
    seen = first.select(F.col("doc_id").alias("d"), F.col("source_doc_id").alias("s"), F.col("start_word").alias("u"), F.col("end_word").alias("v"))
    rest = rest.join(seen, (F.col("doc_id") == F.col("d")) & (F.col("source_doc_id") == F.col("s")) & (F.col("start_word") >= F.col("u")) & (F.col("end_word") <= F.col("v")), "left_anti")
    # Token ranges become word ranges: the last token has the words after it.
    found = first.union(rest).withColumns({"end_word": F.col("end_word") + SIZE - 1, "source_end_word": F.col("source_end_word") + SIZE - 1})
    whole = copies.select("doc_id", "source_doc_id", F.lit(0).alias("start_word"), F.lit(None).cast("int").alias("end_word"), F.lit(0).alias("source_start_word"), F.lit(None).cast("int").alias("source_end_word"), F.lit(None).cast("int").alias("shared"), F.lit(1.0).alias("similarity"))
    return found.unionByName(whole)


def gathered(part: pa.Table) -> pa.Table:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    links = merged(np.concatenate([np.frombuffer(open_(r), LINK) for r in part["links"].to_pylist()]))
    return pa.table({c: pa.array(links[c]) for c in LINK.names})


def rest_pairs(own: DataFrame, texts: DataFrame, copied: DataFrame, first: DataFrame, width: int, similarity: float, shards: int, task_bytes: int, shuffle_bytes: int) -> DataFrame:
    """All pairs of documents with a run in common that could have a passage which ``first`` lacks, or join components that it leaves apart: (a, b, a_from, a_to, b_from, b_to), written."""
    import zstandard

    run, reach, need = least_run(width, similarity), 2 * width, 2 * similarity / (1 + similarity) * width - 1e-9
    kind = rest_dtype(run)
    joined = components(first.select("doc_id", "source_doc_id"), "doc_id", "source_doc_id")
    spans = first.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("spans"))
    state = written(joined.join(spans, joined["node"] == spans["doc_id"], "left").select(F.col("node").alias("__node"), "component", "spans"), "found-state")
    known = flagged(own, "doc_id", state).join(state.hint("merge"), F.col("doc_id") == F.col("__node"), "left").drop("__node")
    others = flagged(own, "doc_id", state, "left_anti").withColumns({"component": F.lit(None).cast("long"), "spans": F.lit(None).cast("array<struct<a:int,b:int>>")})
    marked = known.union(others).select("text", F.struct("doc_id", F.coalesce("component", "doc_id").alias("component"), "spans").alias("who"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress

        def dealt(made: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(made)
            shard = (rows["token"] % np.uint64(shards)).astype(np.int64)
            o = np.lexsort((rows["place"], rows["doc"], shard))
            rows, shard = rows[o], shard[o]
            parts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(rows)])
            packs = [press(packed(rows[a:b])) for a, b in zip(parts, np.append(parts[1:], len(rows)), strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(shard[parts], pa.int64()), pa.array(packs, pa.binary())], ["shard", "rows"])

        made, size = [], 0
        for who, held in batched(batches, task_bytes, 1, 0):
            spans = [[(x["a"], x["b"]) for x in w["spans"] or ()] for w in who]
            made.append(run_places([w["doc_id"] for w in who], [w["component"] for w in who], spans, held, run))
            size += sum(map(len, held))
            if size >= shuffle_bytes:
                yield dealt(made)
                made, size = [], 0
        if made:
            yield dealt(made)

    def meet(part: pa.Table) -> pa.Table:
        press, open_ = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        rows = np.concatenate([unpacked(open_(r), kind) for r in part["rows"].to_pylist()])
        links, columns = [np.empty(0, LINK)], [f"p{k}" for k in range(len(starts_of(run)[1]))]
        rows["p0"] = joined_classes(rows, columns)
        members = open_classes(rows, "p0")
        head = begins(members["key"])
        size = np.bincount(head, minlength=len(members))[head]
        crowd, few, head = members[size > CROWD], members[size <= CROWD], head[size <= CROWD]
        for step in range(1, min(CROWD, len(few))):
            later, earlier = few[step:], few[:-step]
            use = (head[step:] == head[:-step]) & open_pairs(later, earlier)
            links.append(member_links(later[use], earlier[use], reach))
        links = merged(np.concatenate(links))
        bucket = (mixed(links["a"].astype(np.uint64) * np.uint64(31) + links["b"].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        links, bucket = links[(o := np.argsort(bucket, kind="stable"))], bucket[o]
        parts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(links)])
        packs = [press(links[a:b].tobytes()) for a, b in zip(parts, np.append(parts[1:], len(links)), strict=False)]
        crowd["key"] = mixed(crowd["key"])
        members = [dict(zip(CROWDED, x, strict=True)) for x in zip(crowd["key"].astype(np.int64).tolist(), *(crowd[c].tolist() for c in CROWDED[1:]), strict=True)]
        n = len(packs)
        return pa.table({"bucket": pa.array([*bucket[parts].tolist(), *[None] * bool(members)], pa.int64()), "links": pa.array([*packs, *[None] * bool(members)], pa.binary()), "crowd": pa.array([*[None] * n, *[members] * bool(members)], pa.list_(pa.struct([(c, pa.int64()) for c in CROWDED])))})

    crowd_type = f"array<struct<{','.join(f'{c}:bigint' for c in CROWDED)}>>"
    stage = written(marked.mapInArrow(emit, "shard long, rows binary").groupBy("shard").applyInArrow(meet, f"bucket long, links binary, crowd {crowd_type}"), "runs")
    few = stage.where("links IS NOT NULL").groupBy("bucket").applyInArrow(gathered, LINKS)
    # Members of large classes meet by blocks, with the tokens around what they share.
    crowd = written(stage.where("crowd IS NOT NULL").select(F.explode("crowd").alias("x")).select("x.*"), "crowd")
    asked = in_rows(crowd.select("doc", "key", "group", "known", "lo", "hi").withColumnRenamed("doc", "doc_id"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for who, held in batched(batches, task_bytes, 1, 0):
            tokens, _, text = tokens_of(held)
            ends = np.searchsorted(text, np.arange(len(held)), "right")
            rows = []
            for w, begin, end in zip(who, np.append(0, ends[:-1]).tolist(), np.maximum(ends - SIZE + 1, 0).tolist(), strict=True):
                for r in w["asked"]:
                    at = max(r["lo"] - reach, 0)
                    near = tokens[begin + at : max(min(begin + r["hi"] + reach + 1, end), begin + at)]
                    rows.append((*(r[c] if c != "doc" else w["doc_id"] for c in CROWDED), near.tobytes()))
            for a in range(0, len(rows), 2000):
                cols = list(zip(*rows[a : a + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], [*CROWDED, "tokens"])

    def count(part: pa.Table) -> pa.Table:
        side = part["block"].to_numpy()
        x, y = part["x"][0].as_py(), part["y"][0].as_py()
        members = np.zeros(len(part), MEMBER)
        for c in CROWDED[1:]:
            members[c] = part[c].to_numpy()
        texts_around = [np.frombuffer(r, "<u8") for r in part["tokens"].to_pylist()]
        later, earlier = linking(members, texts_around, np.flatnonzero(side == x), np.flatnonzero(side == y), width, similarity, reach)
        links = merged(member_links(members[later], members[earlier], reach))
        return pa.table({c: pa.array(links[c]) for c in LINK.names})

    near = requested(texts, asked).select("text", F.struct("doc_id", "asked").alias("who")).mapInArrow(around, ", ".join(f"{c} long" for c in CROWDED) + ", tokens binary")
    blocks = crowd.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    near = near.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    near = near.select(*CROWDED, "tokens", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    many = near.groupBy("key", "x", "y").applyInArrow(count, LINKS)
    both = few.union(many).groupBy("a", "b").agg(F.min("a_from").alias("a_from"), F.max("a_to").alias("a_to"), F.min("b_from").alias("b_from"), F.max("b_to").alias("b_to"))
    return written(both.join(copied, both["a"] == copied["doc_id"], "left_anti"), "rest-pairs")


def packed(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(np.diff(rows[c], prepend=0) if c == "doc" else rows[c]).tobytes() for c in rows.dtype.names)


def unpacked(raw: bytes, kind: np.dtype = ROW) -> np.ndarray:
    n = len(raw) // kind.itemsize
    rows, at = np.empty(n, kind), 0
    for name in kind.names:
        column = np.frombuffer(raw, kind[name], n, at)
        rows[name] = column.cumsum() if name == "doc" else column
        at += n * kind[name].itemsize
    return rows


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the repeated passages: the words of each are cut from the text, with the white space behind them.

    A document that repeats an earlier one as a whole is left out, as is one of which no word is left; all else stays, null texts too.
    """
    found = near_passages(docs, id_col=id_col, text_col=text_col, **settings)
    cuts = found.groupBy("doc_id").agg(F.max(F.col("end_word").isNull()).alias("copy"), F.collect_list(F.struct("start_word", "end_word")).alias("cuts"))
    cuts = written(cuts, "cuts").select(F.col("doc_id").alias("__cut_id"), F.struct("copy", "cuts").alias("__cut"))
    ids = cuts.select("__cut_id")
    whole, part = among(docs, id_col, ids, "left_anti"), flagged(docs, id_col, ids)
    joined = part.join(cuts.hint("merge"), part[id_col] == F.col("__cut_id")).where("NOT __cut.copy").select(*[part[c] for c in docs.columns], F.col("__cut.cuts").alias("__cuts"))
    columns, at = docs.columns, docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, ranges in zip(batch.column(at), batch.column(len(columns)).to_pylist(), strict=True):
                texts.append(text.as_py() if not ranges else trimmed(text.as_py(), [(r["start_word"], r["end_word"]) for r in ranges]))
                keep.append(not ranges or bool(texts[-1].strip()))
            out = pa.RecordBatch.from_arrays([batch.column(k) if k != at else pa.array(texts, pa.string()) for k in range(len(columns))], columns)
            yield out.filter(pa.array(keep, pa.bool_()))

    return whole.union(joined.mapInArrow(cut, docs.schema))


def trimmed(text: str, ranges: list[tuple[int, int]]) -> str:
    raw = text.encode()
    w = words([raw])
    out, at = [], 0
    for a, b in sorted(ranges):
        lo, hi = int(w.start[a]), int(w.start[b]) if b < len(w.start) else len(raw)
        if hi > at:
            out.append(raw[at : max(lo, at)])
            at = hi
    return b"".join([*out, raw[at:]]).decode()

