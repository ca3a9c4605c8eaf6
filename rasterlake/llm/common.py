"""Shared helpers of the corpus operators: inputs, written stages and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.stages import kept as written

#: White space as the contracts define it; every other character belongs to a word.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Workers serve one stage after the other. With these settings they give arrays of 4 MB or more and Arrow's buffers back to the system as they are freed,
#: so that a stage doesn't stand on top of what the one before has used; a session's own settings stay.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_workers(spark: SparkSession) -> None:
    """Python workers that start from now on have ``WORKER_MEMORY``."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` of any documents table, so that other columns can't clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Buckets of ids, each with 64 flags: what is sent to all tasks to leave rows out before a shuffle has this many rows at most, however many ids there are.
ID_BUCKETS = 1 << 20


def _flag(column) -> tuple:
    return F.pmod(F.xxhash64(column), F.lit(ID_BUCKETS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(column), F.lit(64)))


def flagged(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose id has its flag set among ``ids`` (left_semi), or hasn't (left_anti): all that are among them and, by chance, some others."""
    bucket, flag = _flag(F.col(ids.columns[0]).cast("long"))
    flags = ids.select(bucket.alias("__bucket"), flag.alias("__flag")).groupBy("__bucket").agg(F.bit_or("__flag").alias("__flags"))
    bucket, flag = _flag(rows[column].cast("long"))
    return rows.join(F.broadcast(flags), (bucket == F.col("__bucket")) & (F.col("__flags").bitwiseAND(flag) != 0), how)


def among(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``column`` is (left_semi) or isn't (left_anti) in the first column of ``ids``.

    One plan at every size: flags of bounded number keep most rows out of the exact sort-merge join, and fewer of them the more ids there are.
    """
    exact = ids.select(F.col(ids.columns[0]).alias("__among")).hint("merge")
    maybe = flagged(rows, column, ids, "left_semi")
    decided = maybe.join(exact, maybe[column] == exact["__among"], how)
    return decided if how == "left_semi" else flagged(rows, column, ids, "left_anti").union(decided)


def in_rows(requests: DataFrame, most: int = 256) -> DataFrame:
    """(doc_id, asked): all requests of a document in as few rows as ``most`` requests a row allow, written; the other columns of ``requests`` are the fields of one."""
    fields = [c for c in requests.columns if c != "doc_id"]
    requests = written(requests, "requests")
    parts = requests.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    dealt = requests.join(parts, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64(*fields), F.col("parts")).alias("part")).agg(F.collect_list(F.struct(*fields)).alias("asked"))
    return written(dealt.drop("part"), "asked")


def requested(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``texts`` with what is asked of them (a written table, as it's read twice); most texts that nothing is asked of don't reach the shuffle of the join."""
    return flagged(texts, "doc_id", asked, "left_semi").join(asked.hint("merge"), "doc_id")


def batched(batches: Iterator[pa.RecordBatch], limit: int, ids_at: int = 0, texts_at: int = 1) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of at least ``limit`` bytes at a time, from those columns."""
    ids, held, size = [], [], 0
    for batch in batches:
        for start in range(0, len(batch), 512):  # rows become Python objects some at a time
            part = batch.slice(start, 512)
            for doc, text in zip(part.column(ids_at).to_pylist(), part.column(texts_at), strict=True):
                ids.append(doc)
                held.append(text.as_py().encode())
                size += len(held[-1])
                if size >= limit:
                    yield ids, held
                    ids, held, size = [], [], 0
    if ids:
        yield ids, held


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, component), component = smallest node.

    Alternates large-star and small-star steps on distributed edges; each round is written to the
    shared folder, and only two aggregate numbers reach the driver. Nodes without an edge don't appear.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small_low.select("u", F.col("m").alias("v")).union(small).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        last = state
    raise RuntimeError("components did not settle")
