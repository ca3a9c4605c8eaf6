"""The context-adaptive method on a difference raster, one image a task.

A head is a place with three cells right of it in its row; heads go down the columns, and the four cells of a head make a code 1..15 (0: all
zeros). The method keeps how often each code stands among the ``length`` heads behind the current one, and three codes have a role there: the
most frequent one carries bits, its rarest substitute stands for a 1, and a second rare code of the same parity makes room for that substitute.

Counts change by one code at each end of the window while nothing is edited, so a stretch of heads is looked at as a whole: its counts are running sums, its roles are
found for all its heads at once, and the stretch ends at the first head that is edited. An edit changes four cells, so the codes of seven heads at most.
"""

from __future__ import annotations

import numpy as np

from rasterlake.plans import steps

STRETCH = 256
_SUBSTITUTES = np.zeros((16, 3), np.int64)
for _p in range(1, 16):
    _qs = sorted(q for x, q in steps.substitutes() if x == _p and q)
    _SUBSTITUTES[_p] = (_qs * 3)[:3] if len(_qs) < 3 else _qs
_ODD = np.bitwise_count(np.arange(16, dtype=np.uint8)) % 2
_FAR = np.iinfo(np.int64).max


def roles(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of sixteen counts the carrier, its rarest substitute and the rarest other code of that one's parity; of equals the smallest code."""
    rows = np.arange(len(counts))
    carrier = 1 + counts[:, 1:].argmax(1)
    options = np.sort(_SUBSTITUTES[carrier], axis=1)
    rare = options[rows, counts[rows[:, None], options].argmin(1)]
    open_ = counts.copy()
    open_[:, 0] = _FAR
    open_[_ODD[None, :] != _ODD[rare][:, None]] = _FAR
    open_[rows, carrier] = open_[rows, rare] = _FAR
    return carrier, rare, open_.argmin(1)


class Stream:
    """Codes of all heads of ``bits`` (edited in place), and the counts behind the head it stands at."""

    def __init__(self, bits: np.ndarray, length: int, head: int) -> None:
        self.bits, self.height, self.length = bits, bits.shape[0], max(1, length)
        b = bits.astype(np.uint8)
        self.codes = (b[:, :-3] << 3 | b[:, 1:-2] << 2 | b[:, 2:-1] << 1 | b[:, 3:]).T.ravel()
        self.head = head
        self.counts = np.bincount(self.codes[head + 1 : head + 1 + self.length], minlength=16).astype(np.int64)

    def stretch(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The next heads in the direction of ``step`` from the current one on, and the counts at each."""
        n, heads = len(self.codes), self.head + step * np.arange(STRETCH)
        heads = heads[(heads >= 0) & (heads < n)]
        # From head k to k + 1 the code of k + 1 leaves the window and that of k + 1 + length enters it; backward it's the other way round.
        left = heads[:-1] + (1 if step > 0 else 0)
        change = np.zeros((len(heads), 16), np.int64)
        rows = np.arange(1, len(heads))
        change[rows, self.codes[left]] -= step
        inside = left + self.length < n
        np.add.at(change, (rows[inside], self.codes[(left + self.length)[inside]]), step)
        return heads, self.counts + change.cumsum(0)

    def stand(self, head: int, counts: np.ndarray) -> None:
        self.head, self.counts = head, counts.copy()

    def write(self, code: int) -> None:
        """Put ``code`` at the current head; codes that its cells belong to follow, and the counts of those in the window."""
        column, row = divmod(self.head, self.height)
        self.bits[row, column : column + 4] = [code >> 3 & 1, code >> 2 & 1, code >> 1 & 1, code & 1]
        for c in range(max(0, column - 3), min(column + 4, self.bits.shape[1] - 3)):
            k = c * self.height + row
            a = self.bits[row, c : c + 4]
            new = int(a[0]) << 3 | int(a[1]) << 2 | int(a[2]) << 1 | int(a[3])
            if self.head < k <= self.head + self.length:
                self.counts[self.codes[k]] -= 1
                self.counts[new] += 1
            self.codes[k] = new

    def move(self, step: int) -> bool:
        """To the next head; False where there is none."""
        to = self.head + step
        if not 0 <= to < len(self.codes):
            return False
        edge = self.head + (step > 0)
        self.counts[self.codes[edge]] -= step
        if edge + self.length < len(self.codes):
            self.counts[self.codes[edge + self.length]] += step
        self.head = to
        return True


def first(found: np.ndarray) -> int:
    return int(found.argmax()) if found.any() else _FAR


def embed(diff: np.ndarray, payload: list[int], length: int) -> tuple[int, list[int]]:
    """Edit ``diff`` in place; (last head, marks). Raises ValueError when it can't hold the payload."""
    if not payload:
        return -1, []
    bits, used, marks, at = np.array(payload), 0, [], Stream(diff, length, 0)
    while True:
        heads, counts = at.stretch(1)
        carrier, rare, other = roles(counts)
        code = at.codes[heads]
        carries, stands, spare = code == carrier, code == rare, code == other
        order = used + carries.cumsum() - 1  # the bit that a carrier takes
        edited = first(stands | (carries & (bits[np.minimum(order, len(bits) - 1)] == 1)))
        full = first(carries & (order == len(bits) - 1))
        stop = min(edited, full, len(heads) - 1)
        marks += [0] * int(spare[: stop + 1].sum())
        used += int(carries[: stop + 1].sum())
        at.stand(int(heads[stop]), counts[stop])
        if stop == edited:
            at.write(int(other[stop]) if stands[stop] else int(rare[stop]))
            marks += [1] * bool(stands[stop])
        if stop == full:
            return int(heads[stop]), marks
        if not at.move(1):
            raise ValueError("the stream can't hold the payload")


def extract(diff: np.ndarray, marks: list[int], end: int, length: int) -> list[int]:
    """Undo ``embed`` from its last head back, in place; the payload. Raises ValueError when marks and codes don't fit."""
    if end < 0:
        return []
    waiting, out, at = np.array(marks[::-1], np.int64), [], Stream(diff, length, end)
    used = 0
    while True:
        heads, counts = at.stretch(-1)
        carrier, rare, other = roles(counts)
        code = at.codes[heads]
        carries, stands, spare = code == carrier, code == rare, code == other
        order = used + spare.cumsum() - 1
        short = first(spare & (order >= len(waiting)))
        marked = spare & (order < len(waiting)) & (np.append(waiting, 0)[np.minimum(order, len(waiting))] == 1)
        edited = first(stands | marked)
        stop = min(edited, short, len(heads) - 1)
        if stop == short:
            raise ValueError("marks are used up")
        out += stands[: stop + 1][(carries | stands)[: stop + 1]].astype(int).tolist()
        used += int(spare[: stop + 1].sum())
        at.stand(int(heads[stop]), counts[stop])
        if stop == edited:
            at.write(int(carrier[stop]) if stands[stop] else int(rare[stop]))
        if not at.move(-1):
            break
    if used < len(waiting):
        raise ValueError("marks are left over")
    return out[::-1]


def difference(image: np.ndarray) -> np.ndarray:
    """Each cell against the one left of it, cells of the first column against the one above."""
    before = np.concatenate([np.concatenate([[0], image[:-1, 0]])[:, None].astype(image.dtype), image[:, :-1]], 1)
    return image ^ before


def undifference(diff: np.ndarray) -> np.ndarray:
    start = np.bitwise_xor.accumulate(diff[:, 0])[:, None]
    return np.bitwise_xor.accumulate(np.concatenate([start, diff[:, 1:]], 1), axis=1)
