"""Operator 9, token-ID output: fixed-stride shards of token sequences in a keyed training order.

Each document's ids are cut into sequences of at most ``length`` ids. A sequence (doc_id, piece) has a
place in a bounded domain, (doc_id - smallest doc_id) * pieces + piece, known before anything is
tokenized: ``pieces`` bounds the pieces of any document by its bytes, since a token has a byte at least.
A balanced Feistel network keyed by ``seed`` permutes the next power of four; walking the cycle until the
value falls into the domain makes it a permutation of the domain itself. The permuted domain is cut into
equal ranges, one for each shard, so payloads are shuffled once, straight to their shard, and hot
documents or keys don't matter. Within a shard, records are written in permuted order with one stride.
The global slot is the shard's base (records in the shards before it) plus the place in the shard, so
slots are dense and a reader resumes at slot s by seeking to (s - base) * stride.

Record: doc_id int64, piece uint32, n_ids uint32, then ``length`` uint16 or uint32 ids, little-endian, zeros behind the
last. Strings of special tokens in a text are ordinary text here, so that a text can't end its own sequence in training.
A null doc_id takes the place after the largest; a null or empty text is one sequence of only the closing id. Repeated rows are written once
each and tie by their ids' checksum. No rows give no shards. Other columns aren't read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import id_text, written
from rasterlake.llm.packing import byte_bpe, default_vocabulary, token_ids
from rasterlake.stages import shared_folder

HEADER = 16


def feistel(values: np.ndarray, domain: int, seed: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of range(domain), applied to ``values`` (uint64)."""
    half = max(1, -(-(max(domain, 2) - 1).bit_length() // 2))
    shift, low = np.uint64(half), np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, size=rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for key in keys:
            z = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & low)
        return (left << shift) | right

    out = once(values.astype(np.uint64))
    while (walk := out >= np.uint64(domain)).any():
        out[walk] = once(out[walk])
    return out


def write_shards(docs: DataFrame, folder: str, length: int = 512, closing_id: int = 50256, seed: int = 7, shard_mb: int = 32, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to ``folder`` (any address that pyarrow opens) and return their index, a row per sequence:
    doc_id, piece, n_ids, ids_crc32, slot, shard, shard_base, byte_offset. A task that runs again writes its shard again under the same name.
    """
    texts, vocabulary = id_text(docs, id_col, text_col), vocabulary or default_vocabulary()
    low, high, longest, total, rows = texts.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    low, high = (0, -1) if low is None else (low, high)
    most = -(-((longest or 0) + 1) // length)
    domain = (high - low + 2) * most
    if domain >= 1 << 62:
        raise ValueError("doc_ids are too far apart; number them densely first")
    width = 2 if byte_bpe(vocabulary).max_token_value < 1 << 16 else 4
    stride = HEADER + width * length
    # About 0.4 ids a byte, and half a sequence of padding for each document: only the shards' number depends on it.
    shards = max(1, int(((total or 0) * 0.4 / length + rows * 0.5) * stride / (shard_mb << 20)))
    kind = f"<u{width}"
    payload = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(vocabulary)
        for batch in batches:
            doc_ids, piece, ids = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.append(token_ids(encoding, text.as_py()), closing_id).astype(kind).tobytes()
                for k, at in enumerate(range(0, len(raw), width * length)):
                    doc_ids.append(doc)
                    piece.append(k)
                    ids.append(raw[at : at + width * length])
            whole = np.array([high + 1 if d is None else d for d in doc_ids], np.int64) - low
            place = feistel((whole * most + np.array(piece, np.int64)).astype(np.uint64), domain, seed)
            shard = (place.astype(np.float64) * (shards / domain)).astype(np.int32).clip(0, shards - 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place.astype(np.int64)), pa.array(doc_ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(ids, pa.binary())], schema=payload)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now, out, at, temp = None, None, 0, ""

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(temp, f"{root}/shard-{now:06d}.bin")

        for batch in batches:
            shard, ids = batch.column(0).to_numpy(), batch.column(4).to_pylist()
            doc_ids, piece = batch.column(2).fill_null(0).to_numpy(), batch.column(3).to_numpy()
            begins = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                if shard[a] != now:
                    close()
                    now, at, temp = int(shard[a]), 0, f"{root}/.tmp-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                n = np.array([len(x) // width for x in ids[a:b]], np.uint32)
                record = np.zeros(b - a, np.dtype([("doc", "<i8"), ("piece", "<u4"), ("n", "<u4"), ("ids", f"S{width * length}")]))
                record["doc"], record["piece"], record["n"], record["ids"] = doc_ids[a:b], piece[a:b], n, ids[a:b]
                out.write(record.tobytes())
                local = np.arange(at, at + b - a, dtype=np.int64)
                at += b - a
                crc = np.array([zlib.crc32(x) for x in ids[a:b]], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(2)[a:b], batch.column(3)[a:b], pa.array(n.astype(np.int32)), pa.array(crc), batch.column(0)[a:b], pa.array(local)], ["doc_id", "piece", "n_ids", "ids_crc32", "shard", "local"])
        close()

    dealt = texts.mapInArrow(cut, "shard int, place long, doc_id long, piece int, ids binary").repartition(shards, "shard").sortWithinPartitions("shard", "place", F.crc32("ids"))
    index = written(dealt.mapInArrow(write, "doc_id long, piece int, n_ids int, ids_crc32 long, shard int, local long"), "shard-index")
    bases = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("shard_base", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", F.coalesce("shard_base", F.lit(0)).alias("shard_base"))
    return index.join(bases, "shard").select("doc_id", "piece", "n_ids", "ids_crc32", (F.col("shard_base") + F.col("local")).alias("slot"), "shard", "shard_base", (F.col("local") * stride).alias("byte_offset"))


def read_from(folder: str, shard: int, byte_offset: int, count: int, length: int = 512, width: int = 2) -> list[tuple[int, int, np.ndarray]]:
    """Up to ``count`` records of one shard from ``byte_offset`` on: (doc_id, piece, ids); no row before them is read."""
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    stride = HEADER + width * length
    with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
        f.seek(byte_offset)
        raw = f.read(count * stride)
    out = []
    for at in range(0, len(raw), stride):
        head = np.frombuffer(raw, np.dtype([("doc", "<i8"), ("piece", "<u4"), ("n", "<u4")]), 1, at)[0]
        out.append((int(head["doc"]), int(head["piece"]), np.frombuffer(raw, f"<u{width}", int(head["n"]), at + HEADER)))
    return out


def shards_query(docs: DataFrame) -> DataFrame:
    return write_shards(docs, f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}")
