"""Operator 1, SentencePiece encoding and decoding by suffix-array matching.

A task takes some megabytes of texts at a time. Spaces become the model's mark and texts fall into units (marks and what follows,
since no piece has a mark behind another character); each distinct unit is encoded once. The units' text is indexed by a
suffix array, every piece is binary-searched for its range of occurrences, and the occurrences are put by position
into a table (place, length) -> piece. Then units are relaxed all at once: in each round every unit joins its
adjacent pair of best rank, the leftmost of equals, as long as a joined range is an edge of the table. Ranks are the scores of
a BPE model, whose merges aren't a shortest path, so this order is what makes the ids those of the model.
Characters in no piece become byte pieces. Units over ``LONG`` characters use a heap instead of rounds, with the same result.

Null and empty texts have no ids and decode to the empty text. A text that holds the mark itself decodes to a space there.
Repeated rows give repeated results, a null doc_id too; no rows give none. Other columns aren't read. No shuffle.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import id_text
from rasterlake.llm.jaccard_join import batched
from rasterlake.llm.suffix import suffix_array

MARK = "▁"
NONE = 65535
LONG = 160


@dataclass
class Vocabulary:
    """matrix: code points of each piece (-1 behind its end); ids by piece; ranks by piece, NONE from the last on; raw: the bytes of each id, ``raw_at`` their places."""

    matrix: np.ndarray
    length: np.ndarray
    ids: np.ndarray
    ranks: np.ndarray
    bytes_id: np.ndarray
    raw: np.ndarray
    raw_at: np.ndarray


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(m.get_piece_size())
    names = [m.id_to_piece(i) for i in every]
    plain = [i for i in every if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    if any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain):
        raise ValueError("pieces with a mark behind another character aren't supported")
    scores = np.array([m.get_score(i) for i in plain])
    ranks = np.unique(-scores, return_inverse=True)[1]
    if len(plain) >= NONE:
        raise ValueError("a model of fewer than 65,535 pieces is needed")
    length = np.array([len(names[i]) for i in plain])
    matrix = np.full((len(plain), int(length.max())), -1, np.int32)
    for row, i in zip(matrix, plain, strict=True):
        row[: len(names[i])] = [ord(c) for c in names[i]]
    bytes_id = np.zeros(256, np.int32)
    raw = []
    for i in every:
        if m.is_byte(i):
            bytes_id[int(names[i][1:-1], 16)] = i
            raw.append(bytes([int(names[i][1:-1], 16)]))
        else:
            raw.append(b"" if m.is_control(i) or m.is_unknown(i) else names[i].replace(MARK, " ").encode())
    return Vocabulary(matrix, length, np.array(plain, np.int32), np.append(ranks, np.full(NONE + 1 - len(plain), NONE)).astype(np.int64), bytes_id, np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))


def edge_table(points: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Number of the piece that stands at each place with each length (column length - 1), or NONE.

    ``points``: code points of all units, each followed by a 0.
    """
    width = v.matrix.shape[1]
    letters, dense = np.unique(points, return_inverse=True)
    text = np.append(dense + 1, 0)
    order = suffix_array(text)[1:].astype(np.int64)
    padded = np.append(points.astype(np.int32), np.full(width, -2, np.int32))
    table = np.full((len(points), width), NONE, np.uint16)
    known = np.isin(v.matrix, letters) | (v.matrix < 0)
    use = np.flatnonzero(known.all(1))
    pieces, length = v.matrix[use], v.length[use]
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(use), np.int64), np.full(len(use), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            above, tied = np.zeros(len(use), bool), np.ones(len(use), bool)
            for k in range(width):
                go = np.flatnonzero(tied & (length > k))
                if not len(go):
                    break
                here = padded[np.minimum(at[go] + k, len(padded) - 1)]
                above[go] = here > pieces[go, k]
                tied[go] = here == pieces[go, k]
            right = ~above & (tied if upper else False) | (~above & ~tied)
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        bounds.append(lo)
    count = bounds[1] - bounds[0]
    which = np.repeat(np.arange(len(use)), count)
    place = order[np.repeat(bounds[0], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    table[place, length[which] - 1] = use[which]
    return table


def relaxed(table: np.ndarray, ranks: np.ndarray, start: np.ndarray, end: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join symbols (start, end, unit) in rounds, until no adjacent pair of a unit is an edge."""
    width = table.shape[1]
    done: list[tuple[np.ndarray, ...]] = []
    while len(start):
        size = end[1:] - start[:-1]
        rank = np.full(len(start), NONE, np.int64)
        fits = (unit[1:] == unit[:-1]) & (size <= width)
        rank[:-1][fits] = ranks[table[start[:-1][fits], size[fits] - 1]]
        key = (rank << 32) | np.arange(len(start))
        begins = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(key, begins)
        live = (best >> 32) < NONE
        sizes = np.diff(np.append(begins, len(start)))
        stay = np.repeat(live, sizes)
        done.append((start[~stay], end[~stay], unit[~stay]))
        join = best[live] & 0xFFFFFFFF
        end[join] = end[join + 1]
        stay[join + 1] = False
        start, end, unit = start[stay], end[stay], unit[stay]
    start, end, unit = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (start, end, unit)
    order = np.argsort(start, kind="stable")
    return start[order], end[order], unit[order]


def relaxed_long(table: np.ndarray, ranks: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """The same for one long unit [a, b), with a heap."""
    width, n = table.shape[1], b - a
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), [a + k + 1 for k in range(n)]
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and stop[j] - (a + i) <= width and (rank := int(ranks[table[a + i, stop[j] - (a + i) - 1]])) != NONE:
            heapq.heappush(heap, (rank, i, stop[j]))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= n or stop[after[i]] != end:
            continue
        j = after[i]
        gone[j], stop[i], after[i] = True, end, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(a + i, stop[i]) for i in range(n) if not gone[i]]


def encode(texts: list[str], v: Vocabulary) -> list[np.ndarray]:
    """The ids of each text."""
    index: dict[str, int] = {}
    split = re.compile(f"{MARK}+[^{MARK}]*").findall
    used = []
    for text in texts:
        units = split(MARK + text.replace(" ", MARK)) if text else []
        used.append(np.fromiter((index.setdefault(u, len(index)) for u in units), np.int64, len(units)))
    if not index:
        return [np.empty(0, np.int32) for _ in texts]
    units = list(index)
    length = np.array([len(u) for u in units], np.int64)
    points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(length + 1) - length - 1
    table = edge_table(points, v)
    unit = np.repeat(np.arange(len(units)), length)
    start = np.arange(len(unit)) + unit
    short = length[unit] <= LONG
    s, e, u = relaxed(table, v.ranks, start[short], start[short] + 1, unit[short])
    for k in np.flatnonzero(length > LONG):
        got = np.array(relaxed_long(table, v.ranks, int(begin[k]), int(begin[k] + length[k])), np.int64)
        s, e, u = np.append(s, got[:, 0]), np.append(e, got[:, 1]), np.append(u, np.full(len(got), k))
    order = np.argsort(s, kind="stable")
    s, e, u = s[order], e[order], u[order]
    piece = table[s, e - s - 1]
    known = piece != NONE
    ids = np.where(known, v.ids[np.where(known, piece, 0)], 0)
    if not known.all():  # characters in no piece
        raw = [list(chr(c).encode("utf-8", "surrogatepass")) for c in points[s[~known]]]
        count = np.ones(len(s), np.int64)
        count[~known] = [len(r) for r in raw]
        unknown, ids, u = np.repeat(~known, count), np.repeat(ids, count), np.repeat(u, count)
        ids[unknown] = v.bytes_id[[b for r in raw for b in r]]
    ends = np.searchsorted(u, np.arange(len(units)), "right")
    begins = np.append(0, ends[:-1])
    size = ends - begins
    out = []
    for k in used:
        n = size[k]
        at = np.repeat(begins[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(ids[at].astype(np.int32))
    return out


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    begins, n = v.raw_at[ids], v.raw_at[ids + 1] - v.raw_at[ids]
    at = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    text = v.raw[at].tobytes().decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: str | None = None, task_bytes: int = 10 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for doc, held in batched(batches, task_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(encode([h.decode() for h in held], v), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, text; null ids are none."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(np.asarray(x, np.int64), v) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str | None = None, task_bytes: int = 10 << 20) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (whether decoding gives the text back)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for doc, held in batched(batches, task_bytes):
            texts = [h.decode() for h in held]
            ids = encode(texts, v)
            rows = [(len(x), zlib.crc32(x.astype("<u4").tobytes()), decode(x, v) == t) for x, t in zip(ids, texts, strict=True)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
