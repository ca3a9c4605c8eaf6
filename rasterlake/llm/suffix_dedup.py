"""Operator 2, suffix-array dedup: bytes covered by a ``WINDOW``-byte string that also starts earlier are removed.

1. Each task hashes the 32-byte grams of its texts and gives every 100-byte window the leftmost gram of least hash in
   it, its anchor: equal windows have equal anchors at the same place. Windows with one anchor in a row form a run.
   Runs of equal content in a task are folded to the earliest: the others are removed whole, and a hot
   passage reaches the shuffle once for each task, however many documents have it.
2. Runs, as packed arrays of hashes and places, are dealt by anchor to shards, whose number follows the text's bytes.
   Equal runs fold again; anchors with two different runs or more go on, with the text of those runs alone.
3. Each shard concatenates its runs' texts in order of (doc_id, start), builds the suffix array by induced sorting
   and the permuted common prefixes; windows that share 100 bytes with their neighbour form groups, and all but the
   first place of a group are removed.
4. Removed intervals meet their documents, and the remaining bytes are hashed.

Folding compares 128 bits of two hashes and lengths; all else compares bytes. A null text is empty. Rows with the same doc_id are
versions of one document: a place in them isn't earlier than the same place in another, and what is
found in one applies to all. Rows with a null doc_id match nothing and keep all bytes. Texts under 100 bytes and empty
tables have nothing to remove. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import id_text, written
from rasterlake.llm.suffix import permuted_prefixes, suffix_array

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
ODD = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, size=12, dtype=np.uint64) | np.uint64(1)
ROW = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<i4")])
FOUND = "kind int, doc_id long, start long, n int, anchor long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    m = len(data) - GRAM + 1
    total = words[:m] * ODD[0]
    for k in range(1, GRAM // 8):
        total ^= mixed(total) + words[8 * k : 8 * k + m] * ODD[k]
    return mixed(total)


def least_from(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the least value among ``width`` values from each place on."""
    best, place = values, np.arange(len(values), dtype=np.int32)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        take = best[step:] < best[:-step]
        best = np.where(take, best[step:], best[:-step])
        place = np.where(take, place[step:], place[:-step])
        reach += step
    return place


def runs(data: np.ndarray, sizes: np.ndarray, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: each run's first window, its number of windows, its anchor's hash and its content's hash."""
    ends = np.cumsum(sizes)
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(data) - WINDOW + 1, chunk):
        part = data[at : at + chunk + WINDOW - 1]
        grams = gram_hashes(part)
        place = least_from(grams, SPAN)
        windows = np.arange(at, at + len(place))
        text = np.searchsorted(ends, windows, "right") if len(sizes) > 1 else np.zeros(len(place), np.int64)
        inside = windows + WINDOW <= ends[text]
        change = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])))
        n = np.diff(np.append(change, len(place)))
        keep = inside[change]
        first, n = change[keep], n[keep]
        anchor = grams[place[first]]
        # Content: the grams that cover the run, each with a factor for its turn, the last gram, the length and the anchor's place.
        length = n + WINDOW - 1
        content = mixed(grams[first + length - GRAM] * ODD[4]) + length.astype(np.uint64) * ODD[5] + (place[first] - first).astype(np.uint64) * ODD[6]
        for turn in range(0, 168 // GRAM):
            more = length - GRAM >= turn * GRAM
            content = np.where(more, mixed(content ^ grams[np.minimum(first + turn * GRAM, len(grams) - 1)] * ODD[7]), content)
        out.append((first + at, n, anchor, content))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def folded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` sorted by anchor, content and place; and which are the first of their content. A place given twice counts once."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["content"], rows["anchor"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["content"][1:] != rows["content"][:-1])
    return rows, new


def later(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The rows that stand after the first place of their content."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) if len(rows) else np.empty(0, np.int64)
    return rows[(rows["doc"] != rows["doc"][first]) | (rows["start"] != rows["start"][first])]


def _found(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows["doc"]), pa.array(rows["start"]), pa.array(rows["n"]), pa.array(rows["anchor"].view(np.int64))], ["kind", "doc_id", "start", "n", "anchor"])


def _joined(rows: np.ndarray) -> np.ndarray:
    """Runs of windows of a document that overlap or touch, as one."""
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    if not len(rows):
        return rows
    apart = np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["start"][1:] > rows["start"][:-1] + rows["n"][:-1]))
    out = rows[apart].copy()
    out["n"] = np.maximum.reduceat(rows["start"] + rows["n"], np.flatnonzero(apart)) - out["start"]
    return out


def removed_windows(docs: DataFrame, task_bytes: int = 24 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, start, n): the windows that start at ``start`` .. ``start + n - 1`` also start earlier. ``docs``: doc_id, text."""
    import zstandard

    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL").where(F.octet_length("text") >= WINDOW)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list[int], held: list[bytes]) -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=ids.__getitem__)
            held, ids = [held[k] for k in order], np.array(ids, np.int64)[order]
            sizes = np.array([len(b) for b in held], np.int64)
            first, n, anchor, content = runs(np.frombuffer(b"".join(held), np.uint8), sizes)
            ends = np.cumsum(sizes)
            text = np.searchsorted(ends, first, "right")
            rows = np.empty(len(first), ROW)
            rows["anchor"], rows["content"], rows["doc"], rows["start"], rows["n"] = anchor, content, ids[text], first - (ends - sizes)[text], n
            rows, new = folded(rows)
            gone = _joined(later(rows, new))
            rows = rows[new]
            shard = (rows["anchor"] % np.uint64(shards)).astype(np.int64)
            rows, shard = rows[(o := np.lexsort((rows["start"], rows["doc"], shard)))], shard[o]
            begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(rows) else np.empty(0, np.int64)
            press = zstandard.ZstdCompressor(level=1).compress
            out = [(int(shard[a]), 0, press(packed(rows[a:b]))) for a, b in zip(begins, np.append(begins[1:], len(rows)), strict=False)]
            if len(gone):
                out.append((int(gone["anchor"][0] % np.uint64(shards)), 1, press(packed(gone))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["shard", "kind", "rows"])

        ids, held, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                held.append(text.as_py().encode())
                size += len(held[-1])
                if size >= task_bytes:
                    yield flush(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield flush(ids, held)

    def resolve(part: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        got = [(k, unpacked(open_(b))) for k, b in zip(part["kind"].to_pylist(), part["rows"].to_pylist(), strict=True)]
        gone = [r for k, r in got if k == 1]
        rows, new = folded(np.concatenate([np.empty(0, ROW), *(r for k, r in got if k == 0)]))
        gone.append(_joined(later(rows, new)))
        rows = rows[new]
        begins = np.append(True, rows["anchor"][1:] != rows["anchor"][:-1])[: len(rows)]
        size = np.diff(np.append(np.flatnonzero(begins), len(rows)))
        return pa.Table.from_batches([*(_found(1, r) for r in gone), _found(2, rows[np.repeat(size > 1, size)])])

    found = written(texts.mapInArrow(emit, "shard long, kind int, rows binary").groupBy("shard").applyInArrow(resolve, FOUND), "runs")

    wanted = found.where("kind = 2").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("runs"))

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, ids, start, n, data = [], [], [], [], []
            for doc, text, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                for r in rows:
                    piece = raw[r["start"] : r["start"] + r["n"] + WINDOW - 1]
                    if len(piece) >= WINDOW:
                        shard.append(r["anchor"] % shards)
                        ids.append(doc)
                        start.append(r["start"])
                        n.append(len(piece) - WINDOW + 1)
                        data.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["shard", "doc_id", "start", "n", "data"])

    def sort_suffixes(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        ids, start, n = (part[c].to_numpy() for c in ("doc_id", "start", "n"))
        pieces = part["data"].to_pylist()
        # Bytes are letters from 2 on; 1 ends each run and 0 the whole, so no window reaches into the next run.
        raw = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8)
        text = raw.astype(np.uint16) + 2
        ends = np.cumsum(n.astype(np.int64) + WINDOW)
        begins = ends - n - WINDOW
        text[ends - 1], text[-1] = 1, 0
        order = suffix_array(text)
        counted = np.zeros(len(text) + 1, np.int64)
        np.add.at(counted, begins, 1)
        np.add.at(counted, begins + n, -1)
        window = counted.cumsum()[:-1] > 0
        order = order[window[order]]
        same = permuted_prefixes(raw, order, WINDOW)[order]
        groups = np.flatnonzero(~same)
        # Places follow (doc_id, start), so the least place of a group is the earliest one.
        first = np.repeat(np.minimum.reduceat(order, groups), np.diff(np.append(groups, len(order))))
        run, first_run = (np.searchsorted(begins, x, "right") - 1 for x in (order, first))
        at, first_at = start[run] + order - begins[run], start[first_run] + first - begins[first_run]
        late = (ids[run] != ids[first_run]) | (at != first_at)
        rows = np.zeros(int(late.sum()), ROW)
        rows["doc"], rows["start"], rows["n"] = ids[run][late], at[late], 1
        return pa.Table.from_batches([_found(1, _joined(rows))])

    cut = texts.join(wanted, "doc_id").select("doc_id", "text", "runs").mapInArrow(excerpts, "shard long, doc_id long, start long, n int, data binary")
    sorted_ = cut.groupBy("shard").applyInArrow(sort_suffixes, FOUND)
    return found.where("kind = 1").union(sorted_).select("doc_id", "start", "n")


def packed(rows: np.ndarray) -> bytes:
    """Column after column, documents and places as differences, which press well."""
    doc, start = np.diff(rows["doc"], prepend=0), np.diff(rows["start"], prepend=0)
    return b"".join(np.ascontiguousarray(c).tobytes() for c in (rows["anchor"], rows["content"], doc, start, rows["n"]))


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // ROW.itemsize
    rows, at = np.empty(n, ROW), 0
    for name in ROW.names:
        kind = ROW[name]
        column = np.frombuffer(raw, kind, n, at)
        rows[name] = column.cumsum() if name in ("doc", "start") else column
        at += n * kind.itemsize
    return rows


def spans_of(windows: list, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs [a, b) of a text of ``size`` bytes."""
    out: list[list[int]] = []
    for a, n in sorted((w["start"], w["n"]) for w in windows):
        b = min(a + n + WINDOW - 1, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges, as text)."""
    texts = id_text(docs, id_col, text_col)
    windows = removed_windows(texts).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("windows"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, digest, at = text.as_py().encode(), hashlib.sha256(), 0
                spans = spans_of(found or [], len(raw))
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.join(windows, "doc_id", "left").select("doc_id", "text", "windows").mapInArrow(measure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
