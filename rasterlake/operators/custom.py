"""Operators that relational steps can't express: adaptive tables, codecs and learning.

Spark partitions and shuffles the work by image (or by image and method); a task holds one image's histogram, which is 512 rows at most, or its side information.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions import codecs
from rasterlake.plans import steps
from rasterlake.stages import kept


def adaptive_tables(counts: dict[int, int], alpha: float = 0.1, distance_one: bool = False) -> dict[int, list[int]]:
    """Greedy tables {peak: [peak, zero, ...]}: each peak, most frequent first, takes absent patterns within mean + alpha * sigma
    (population sigma over those still free), by distance and pattern, as many as make its states a power of two."""
    free = np.array([p for p in range(512) if counts.get(p, 0) == 0], np.int64)
    tables: dict[int, list[int]] = {}
    for peak in sorted((p for p, n in counts.items() if n >= 2 and p not in (0, 511)), key=lambda p: (-counts[p], p)):
        if not len(free):
            break
        distance = np.bitwise_count(free ^ peak).astype(float)
        near = free[distance == 1] if distance_one else free[distance <= distance.mean() + alpha * distance.std()]
        near = near[np.lexsort((near, np.bitwise_count(near ^ peak)))]
        states = 1 << int(math.log2(len(near) + 1))
        states = min(states, 2) if distance_one else states
        if states < 2:
            continue
        taken = near[: states - 1]
        tables[peak] = [peak, *taken.tolist()]
        free = np.setdiff1d(free, taken, assume_unique=True)
    return tables


def adaptive_mapping(hist: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(image_id, peak, symbol, pattern, n) for ``hist`` (image_id, pat, n)."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(part["pat"].tolist(), part["n"].tolist(), strict=True))
        rows = [(part["image_id"].iloc[0], p, k, z, counts[p]) for p, zs in adaptive_tables(counts, alpha).items() for k, z in enumerate(zs)]
        return pd.DataFrame(rows, columns=["image_id", "peak", "symbol", "pattern", "n"])

    return hist.select("image_id", "pat", "n").groupBy("image_id").applyInPandas(fold, "image_id string, peak int, symbol int, pattern int, n long")


def q_adaptive_mapping(spark: SparkSession, sf_dir: str, fixture: str = "embeddings") -> DataFrame:
    return adaptive_mapping(steps.run(spark, "SELECT image_id, pat, n FROM hist", sf_dir, fixture))


def q_adaptive_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that the adaptive tables carry: log2(states) for each occurrence of a peak."""
    tables = q_adaptive_mapping(spark, sf_dir, "lineitem").groupBy("image_id", "peak", "n").agg(F.count(F.lit(1)).alias("states"))
    return tables.groupBy("image_id").agg(F.count(F.lit(1)).alias("tables"), F.sum(F.col("n") * F.log2("states").cast("long")).alias("capacity_bits"))


# Codecs


def q_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen distance-one tables through the wire and back: bits on the wire, and whether tables come back equal."""
    chosen = steps.run(spark, "SELECT c.image_id, c.peak, c.zero, b.gross FROM chosen c JOIN best b ON b.image_id = c.image_id", sf_dir)

    def code(part: pd.DataFrame) -> pd.DataFrame:
        peaks, zeros, payload = part["peak"].tolist(), part["zero"].tolist(), int(part["gross"].iloc[0])
        data = codecs.encode_tables(peaks, zeros, payload)
        back = codecs.decode_tables(data)
        same = dict(zip(back[0], back[1], strict=True)) == dict(zip(peaks, zeros, strict=True)) and back[2] == payload
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "tables": [len(peaks)], "wire_bits": [8 * len(data)], "same": [same]})

    return chosen.groupBy("image_id").applyInPandas(code, "image_id string, tables long, wire_bits long, same boolean")


def q_codec_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    def code(part: pd.DataFrame) -> pd.DataFrame:
        tables = {int(p): g.sort_values("symbol")["pattern"].tolist() for p, g in part.groupby("peak")}
        data = codecs.encode_multi(tables, (8, 8), 77, 0.1)
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "wire_bits": [8 * len(data)], "same": [codecs.decode_multi(data)[0] == tables]})

    return q_adaptive_mapping(spark, sf_dir).groupBy("image_id").applyInPandas(code, "image_id string, wire_bits long, same boolean")


def q_codec_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres of the selected pair: wire bits and equality after reading."""
    px = steps.run(spark, "SELECT p.image_id, p.r * 64 + p.c AS pos, p.v, s.first_level FROM pair_px p JOIN selected s ON s.image_id = p.image_id", sf_dir, "embeddings")

    def code(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        positions, originals, level = part["pos"].tolist(), part["v"].tolist(), int(part["first_level"].iloc[0])
        data = codecs.encode_centres(positions, originals, level, (64, 64))
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "wire_bits": [8 * len(data)], "same": [codecs.decode_centres(data) == (positions, originals, level, (64, 64))]})

    return px.groupBy("image_id").applyInPandas(code, "image_id string, wire_bits long, same boolean")


# Learning


def q_cost_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression of replacement costs by distance and frequency, fitted on most images and judged on the others: mean error and correlation, null where no image has rows to learn from."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = steps.run(spark, "SELECT r.image_id, r.peak, r.candidate, r.dist, p.n, r.target, bit_count(r.peak) AS ones FROM ranker_rows r JOIN peaks p ON p.image_id = r.image_id AND p.pat = r.peak", sf_dir, "embeddings")
    data = VectorAssembler(inputCols=["dist", "n", "ones"], outputCol="features").transform(kept(rows.withColumn("held", F.col("image_id").isin("8", "9")), "ranker-rows"))
    learned, judged = data.where(~F.col("held")), data.where("held")
    # Large rasters of noise have every pattern, so no candidates: without rows to learn from there is no model, and its measures are null.
    if learned.limit(1).count():
        judged = GBTRegressor(labelCol="target", maxIter=8, maxDepth=3, seed=7).fit(learned).transform(judged)
    else:
        judged = judged.withColumn("prediction", F.lit(None).cast("double"))
    return judged.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"), F.corr("prediction", "target").alias("pearson"))


def q_alpha_grid(spark: SparkSession, sf_dir: str, alphas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Capacity of adaptive tables for each alpha, all at once; the objective is (1 - capacity share) / 2 + mean distance of the tables / 18."""
    hist = steps.run(spark, "SELECT image_id, pat, n FROM hist", sf_dir, "lineitem")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        alpha = float(part["alpha"].iloc[0])
        counts = dict(zip(part["pat"].tolist(), part["n"].tolist(), strict=True))
        tables = adaptive_tables(counts, alpha)
        bits = sum(counts[p] * int(math.log2(len(z))) for p, z in tables.items())
        distance = [bin(p ^ z).count("1") for p, zs in tables.items() for z in zs[1:]]
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "alpha": [alpha], "capacity_bits": [bits], "distance": [float(np.mean(distance)) if distance else 0.0]})

    runs = hist.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).groupBy("image_id", "alpha").applyInPandas(one, "image_id string, alpha double, capacity_bits long, distance double")
    from pyspark.sql import Window

    share = F.col("capacity_bits") / F.greatest(F.max("capacity_bits").over(Window.partitionBy("image_id")), F.lit(1))
    return runs.withColumn("objective", F.round((1 - share) / 2 + F.col("distance") / 18, 9))


QUERIES = {
    "adaptive_mapping": q_adaptive_mapping, "adaptive_capacity": q_adaptive_capacity,
    "codec_roundtrip": q_codec_roundtrip, "codec_multi": q_codec_multi, "codec_centres": q_codec_centres, "cost_ranker": q_cost_ranker, "alpha_grid": q_alpha_grid,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(q) for name, q in QUERIES.items()}
