"""Operator 7, best-fit packing: token pieces of documents into as few fixed-length sequences as possible.

Every document becomes its token ids and a closing id 0; one longer than a sequence is cut into full
pieces behind a first piece that may be shorter. Pieces are dealt by a hash of the document into
groups of bounded size, and each group is packed by best-two-fit: a sequence is filled greedily with
the largest pieces that fit, then its smallest piece is replaced by the two unpacked pieces that fill
the gap more tightly, if there are such. A group leaves at most about one sequence part-empty, so the
loss is one sequence in many thousands.

Null and empty texts are one piece of length 1 (the closing id). Repeated rows are packed once each;
a null doc_id is packed like any other. No rows give no rows. Other columns aren't read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import id_text

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=4)
def byte_bpe(path: str, special: tuple[tuple[str, int], ...] = ()):
    """The byte-level BPE of a rank file; strings of ``special`` tokens in a text become their ids, other text is ordinary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def default_vocabulary() -> str:
    """The rank file of byte_bpe_50k.json: the same vocabulary and merges, read by the faster of the two libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str | None = None) -> tuple[tuple[str, int], ...]:
    """The added tokens of a tokenizer file (byte_bpe_50k.json): `tokenizers` splits a text at them before anything else."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return tuple((t["content"], int(t["id"])) for t in json.load(f)["added_tokens"])


def token_ids(encoding, text: str) -> np.ndarray:
    return np.asarray(encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()), dtype="<u4")


def pieces(docs: DataFrame, length: int, closing_id: int, vocabulary: str, special: tuple[tuple[str, int], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; no shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(vocabulary, special)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(encoding, text.as_py()), np.uint32(closing_id)).astype("<u4")
                at, n, k = 0, len(ids), 0
                size = n % length or length
                while at < n:
                    rows.append((doc, k, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, k, size = at + size, k + 1, length
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every item. ``waiting`` has the items of each length, ``mask`` a bit for each length that has some."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        waiting[lengths[i]].append(i)
    mask = sum(1 << n for n in range(1, capacity + 1) if waiting[n])

    def largest(room: int) -> int:
        return (mask & ((2 << room) - 1)).bit_length() - 1 if room > 0 else -1

    def take(n: int) -> int:
        nonlocal mask
        i = waiting[n].pop()
        if not waiting[n]:
            mask &= ~(1 << n)
        return i

    def back(i: int) -> None:
        nonlocal mask
        n = int(lengths[i])
        waiting[n].append(i)
        mask |= 1 << n

    def tighter(room: int, than: int) -> tuple[int, int] | None:
        """The two waiting lengths with the largest sum over ``than`` and at most ``room``."""
        found, best, a = None, than, largest(room - 1)
        while a > 0 and 2 * a > best:
            b = largest(min(a, room - a))
            if b == a and len(waiting[a]) < 2:
                b = largest(min(a - 1, room - a))
            if b > 0 and a + b > best:
                found, best = (a, b), a + b
                if best == room:
                    break
            a = largest(a - 1)
        return found

    bins = 0
    while mask:
        held, room = [], capacity
        while (n := largest(room)) > 0:
            held.append(take(n))
            room -= n
        if room and mask and held:
            smallest = held[-1]
            if pair := tighter(room + int(lengths[smallest]), int(lengths[smallest])):
                held.pop()
                room += int(lengths[smallest]) - sum(pair)
                held += [take(n) for n in pair]
                back(smallest)
        at = 0
        for i in held:
            sequence[i], offset[i] = bins, at
            at += int(lengths[i])
        bins += 1
    return sequence, offset


def pack(docs: DataFrame, length: int = 2048, closing_id: int = 0, vocabulary: str | None = None, special: tuple[tuple[str, int], ...] | None = None, group_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Strings of ``special`` tokens (those of the tokenizer file) in a text get those tokens' ids. ``group_rows``: about how many documents one packing group has; groups grow in number with the input.
    """
    rows = pieces(docs, length, closing_id, vocabulary or default_vocabulary(), added_tokens() if special is None else special, id_col, text_col)
    groups = max(1, docs.count() // group_rows)
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(groups)))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset = best_two_fit(part["length"].to_numpy(), length)
        part["sequence_id"], part["offset"] = part["grp"].to_numpy(np.int64) * (1 << 36) + sequence, offset
        return part.drop(columns="grp")

    return dealt.groupBy("grp").applyInPandas(fill, PIECES + ", sequence_id long, offset long")
