"""Stencils over whole rasters by bands of rows: a task holds the pixels of one band and two rows on each side of it, and returns what a step keeps of them.

Dense pixels never become rows of a table, so an image costs its set pixels in the shuffle and its area in array work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.plans import steps
from rasterlake.stages import kept

#: Pixels of a band, and rows that a band sees beyond its own on each side.
AREA, HALO = 1 << 18, 2


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in many tasks by ``keys``: few bytes can be long work, which Spark's own choice of partitions would put into one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def in_bands(ones: DataFrame, dim: DataFrame, made: Callable[[np.ndarray, int, int, int, dict], dict[str, np.ndarray]], schema: str, asked: DataFrame | None = None) -> DataFrame:
    """(image_id, band, and the columns of ``schema``) that ``made`` returns for each band.

    ``made`` gets the band's pixels with ``HALO`` rows and columns around them (0 outside of the image), its first row, the image's h and w and, of ``asked`` (image_id, band, ..), the other
    columns. With ``asked`` only its bands are looked at, else all.
    """
    high = F.greatest(F.lit(1), F.floor(AREA / F.col("w"))).cast("long")
    shape = dim.where("h > 0 AND w > 0").select("image_id", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), high.alias("high"))
    every = shape.withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("h") - 1) / F.col("high")))))
    extra = [c for c in asked.columns if c not in ("image_id", "band")] if asked is not None else []
    every = every.join(asked, ["image_id", "band"]) if asked is not None else every
    near = F.array_distinct(F.array(*(F.floor((F.col("r") + k) / F.col("high")) for k in (-HALO, 0, HALO))))
    near = ones.select("image_id", "r", "c").join(F.broadcast(shape.select("image_id", "high")), "image_id").select("image_id", "r", "c", F.explode(near).alias("band"))
    # Bands are looked at whether or not they have a pixel set.
    none = every.select("image_id", "band", F.lit(None).cast("int").alias("r"), F.lit(None).cast("int").alias("c"))
    rows = near.unionByName(none).join(F.broadcast(every), ["image_id", "band"])
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(part: pa.Table) -> pa.Table:
        h, w, high, band = (part[c][0].as_py() for c in ("h", "w", "high", "band"))
        top = band * high
        image = np.zeros((min(high, h - top) + 2 * HALO, w + 2 * HALO), np.uint8)
        set_ = part.filter(pa.compute.is_valid(part["r"]))
        r = set_["r"].to_numpy() - top + HALO
        use = (r >= 0) & (r < len(image))
        image[r[use], set_["c"].to_numpy()[use] + HALO] = 1
        out = made(image, top, h, w, {c: part[c][0].as_py() for c in extra})
        n = len(out[names[0]])
        return pa.table({"image_id": pa.array([part["image_id"][0].as_py()] * n, pa.string()), "band": pa.array(np.full(n, band), pa.int64()), **{c: pa.array(out[c]) for c in names}})

    return dealt(rows, "image_id", "band").groupBy("image_id", "band").applyInArrow(run, f"image_id string, band long, {schema}")


def levels(image: np.ndarray, top: int, h: int, w: int) -> np.ndarray:
    """The neighbourhood level of each pixel of a band; 0 at the image's edges, which have none."""
    own = image[HALO:-HALO, HALO:-HALO]
    at = lambda dr, dc: image[HALO + dr : len(image) - HALO + dr, HALO + dc : image.shape[1] - HALO + dc] != own
    edge = sum(at(*d).astype(np.int8) for d in ((-1, 0), (1, 0), (0, -1), (0, 1)))
    corner = sum(at(*d).astype(np.int8) for d in ((-1, -1), (-1, 1), (1, -1), (1, 1)))
    table = np.zeros((5, 5), np.int8)
    for nn, fn, lvl in steps.level_order():
        table[nn, fn] = lvl
    out, r = table[edge, corner], top + np.arange(len(own))
    out[(r < 1) | (r > h - 2)] = 0
    out[:, [0, -1]] = 0
    return out


def flip_costs(image: np.ndarray, top: int, h: int, w: int) -> np.ndarray:
    """What inverting each pixel of a band costs: the weight of its neighbours inside the image that it would differ from."""
    own = image[HALO:-HALO, HALO:-HALO]
    ink, room = np.zeros(own.shape), np.zeros(own.shape)
    r, c = top + np.arange(own.shape[0]), np.arange(own.shape[1])
    for dr, dc, weight in steps.kernel():
        ink += weight * image[HALO + dr : len(image) - HALO + dr, HALO + dc : image.shape[1] - HALO + dc]
        room += weight * np.outer((r + dr >= 0) & (r + dr < h), (c + dc >= 0) & (c + dc < w))
    return np.where(own == 1, ink, room - ink)


def level_sums(ones: DataFrame, dim: DataFrame) -> DataFrame:
    """(image_id, band, lvl, n, cost): pixels of each level and the sum of their flip costs."""

    def made(image: np.ndarray, top: int, h: int, w: int, _: dict) -> dict[str, np.ndarray]:
        lvl = levels(image, top, h, w)
        n, cost = np.bincount(lvl.ravel(), minlength=26)[:26], np.bincount(lvl.ravel(), flip_costs(image, top, h, w).ravel(), 26)[:26]
        has = np.flatnonzero(n[1:]) + 1
        return {"lvl": has.astype(np.int32), "n": n[has], "cost": cost[has]}

    return kept(in_bands(ones, dim, made, "lvl int, n long, cost double"), "level-sums")


def pair_scores(sums: DataFrame, dim: DataFrame) -> DataFrame:
    """The step ``scores`` from sums of levels: the profile is of these rasters themselves."""
    spark = sums.sparkSession
    counts = sums.groupBy("image_id", "lvl").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lvl").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    profile = spark.range(1, 26).select(F.col("id").cast("int").alias("lvl")).join(found, "lvl", "left").select("lvl", F.coalesce("n", F.lit(0)).alias("n"), (F.col("cost") / F.col("n")).alias("cost"))
    return kept(steps.run(spark, "SELECT image_id, first_level, capacity, score FROM scores", dim=dim, level_counts=kept(counts, "level-counts"), profile=kept(profile, "profile")), "scores")


def pair_centres(ones: DataFrame, dim: DataFrame, sums: DataFrame, best: DataFrame) -> DataFrame:
    """(image_id, r, c, i, original): in raster order the first ``bits`` pixels of each image's pair of levels; ``best`` is (image_id, bits, first_level). Bands behind these aren't looked at."""
    mine = sums.join(best, "image_id").where("lvl = first_level OR lvl = 26 - first_level").groupBy("image_id", "band", "bits", "first_level").agg(F.sum("n").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("image_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = kept(mine.withColumn("base", base).where("base < bits").select("image_id", "band", "first_level", "base", (F.col("bits") - F.col("base")).alias("most")), "asked-bands")

    def made(image: np.ndarray, top: int, h: int, w: int, asked: dict) -> dict[str, np.ndarray]:
        lvl = levels(image, top, h, w)
        at = np.flatnonzero((lvl == asked["first_level"]) | (lvl == 26 - asked["first_level"]))[: asked["most"]]
        return {"r": (top + at // w).astype(np.int32), "c": (at % w).astype(np.int32), "i": asked["base"] + np.arange(len(at)), "original": image[HALO:-HALO, HALO:-HALO].ravel()[at].astype(np.int32)}

    return in_bands(ones, dim, made, "r int, c int, i long, original int", asked).drop("band")
