"""Whole methods over rasters: tables, embedding, wire, extraction, restoration, measures, and detectors on covers and marked rasters."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions import codecs
from rasterlake.operators import agent, bands, context, marking
from rasterlake.operators.bands import dealt
from rasterlake.operators.custom import adaptive_mapping
from rasterlake.plans import steps
from rasterlake.stages import kept

METHODS = ("adaptive", "context", "distance_one", "pair", "single_peak")


def raster(spark: SparkSession, sf_dir: str, fixture: str = "embeddings") -> tuple[DataFrame, DataFrame]:
    ones = kept(steps.run(spark, "SELECT image_id, r, c FROM ones", sf_dir, fixture), "ones")
    return ones, kept(steps.run(spark, "SELECT image_id, h, w FROM dim", sf_dir, fixture, ones=ones), "dim")


def tables(method: str, ones: DataFrame, dim: DataFrame, payload: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Pattern tables (image_id, peak, symbol, pattern) of a method; of the distance-one tables the first that carry the payload."""
    spark = ones.sparkSession
    hist = kept(steps.run(spark, "SELECT image_id, pat, n FROM hist", ones=ones, dim=dim), "hist")
    if method == "adaptive":
        return kept(adaptive_mapping(hist, alpha).select("image_id", "peak", "symbol", "pattern"), "tables")
    if method == "single_peak":
        mapped = steps.run(spark, "SELECT image_id, peak, symbol, pattern FROM hn_map", hist=hist, dim=dim)
    else:
        ranked = steps.run(spark, "SELECT image_id, peak, zero AS pattern, gross - n AS before_n FROM ranked_h1", hist=hist, dim=dim)
        mapped = ranked.join(payload, "image_id").where("before_n < bits").select("image_id", "peak", F.lit(1).alias("symbol"), "pattern")
    return kept(mapped.unionByName(mapped.select("image_id", "peak", F.lit(0).alias("symbol"), F.col("peak").alias("pattern")).distinct()), "tables")


def wire_sizes(method: str, made: DataFrame, payload: DataFrame, dim: DataFrame) -> DataFrame:
    """(image_id, wire_bits): the side information of each image as bytes on the wire, read back and compared."""

    def size(part: pd.DataFrame) -> pd.DataFrame:
        first, states = part.iloc[0], {int(p): g.sort_values("symbol")["pattern"].tolist() for p, g in part.groupby("peak")}
        bits, shape = int(first["bits"]), (int(first["h"]), int(first["w"]))
        if method == "distance_one":
            data = codecs.encode_tables(list(states), [s[1] for s in states.values()], bits)
            peaks, zeros, n = codecs.decode_tables(data)
            same = dict(zip(peaks, zeros, strict=True)) == {p: s[1] for p, s in states.items()} and n == bits
        elif method == "single_peak":
            data = codecs.encode_single_peak(next(iter(states.values())), bits, shape)
            same = codecs.decode_single_peak(data) == (next(iter(states.values())), bits, shape)
        else:
            data = codecs.encode_multi(states, shape, bits, 0.1)
            same = codecs.decode_multi(data)[:3] == (states, shape, bits)
        if not same:
            raise ValueError("side information doesn't come back from the wire")
        return pd.DataFrame({"image_id": [first["image_id"]], "wire_bits": [8 * len(data)]})

    return made.join(payload, "image_id").join(dim, "image_id").groupBy("image_id").applyInPandas(size, "image_id string, wire_bits long")


def through_tables(method: str, ones: DataFrame, dim: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tables, checks, flips, message, raster put back); images over capacity are in ``checks`` with an error and in none of the others."""
    made = tables(method, ones, dim, payload)
    checks = kept(marking.over_capacity(ones, dim, made, payload), "checks")
    fits = checks.where("error IS NULL").select("image_id", "bits")
    flips = kept(marking.embed(ones, dim, made, payload), "flips")
    stego = kept(marking.toggled(ones.join(fits, "image_id", "left_semi"), flips), "stego")
    found = kept(marking.read(stego, dim, made, fits), "found")
    return made, checks, flips, marking.extracted(found), marking.restored(stego, found)


def pair_tables(ones: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels of pixels, scores of pairs); the profile is of these rasters themselves."""
    spark = ones.sparkSession
    level_px = kept(steps.run(spark, "SELECT image_id, r, c, v, lvl FROM level_px", ones=ones, dim=dim), "levels")
    return level_px, kept(steps.run(spark, "SELECT image_id, first_level, capacity, score FROM scores", ones=ones, dim=dim, level_px=level_px), "scores")


def pair_centres(ones: DataFrame, dim: DataFrame, payload: DataFrame) -> DataFrame:
    """(image_id, r, c, i, original): the centres that carry ``payload``, as of ``marking.pair_centres``, without a table of all pixels' levels."""
    sums = bands.level_sums(ones, dim)
    best = kept(marking.best_pairs(bands.pair_scores(sums, dim), payload), "best-pairs")
    return kept(bands.pair_centres(ones, dim, sums, best), "centres")


def through_pair(ones: DataFrame, dim: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(centres, flips, message, raster put back) of images of which a pair of levels carries the payload."""
    centres = pair_centres(ones, dim, payload)
    flips = kept(marking.overwrite(centres), "flips")
    stego = kept(marking.toggled(ones.join(centres.select("image_id").distinct(), "image_id", "left_semi"), flips), "stego")
    found = kept(marking.read_centres(stego, centres), "found")
    return centres, flips, found.select("image_id", "i", "bit"), marking.put_back(stego, found)


def centre_sizes(centres: DataFrame, dim: DataFrame) -> DataFrame:
    def size(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        shape = (int(part["h"].iloc[0]), int(part["w"].iloc[0]))
        positions, originals = (part["r"] * shape[1] + part["c"]).tolist(), part["original"].tolist()
        data = codecs.encode_centres(positions, originals, 1, shape)
        if codecs.decode_centres(data) != (positions, originals, 1, shape):
            raise ValueError("side information doesn't come back from the wire")
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "wire_bits": [8 * len(data)]})

    return centres.join(dim, "image_id").groupBy("image_id").applyInPandas(size, "image_id string, wire_bits long")


# The context-adaptive method


def _reciprocal_distortion(image: np.ndarray, stego: np.ndarray) -> float:
    """Weighted differences around the changed pixels, over the number of 8x8 blocks that aren't of one colour."""
    h, w = image.shape
    cost, changed = 0.0, image != stego
    # An edit in the first column inverts all rows below it, so changed pixels are counted by arrays, neighbour by neighbour.
    for dr, dc, weight in steps.kernel():
        at = slice(max(0, -dr), h - max(0, dr)), slice(max(0, -dc), w - max(0, dc))
        near = slice(max(0, dr), h + min(0, dr)), slice(max(0, dc), w + min(0, dc))
        cost += weight * int((changed[at] & (image[near] != stego[at])).sum())
    whole = image[: h - h % 8, : w - w % 8].reshape(h // 8, 8, w // 8, 8).sum((1, 3))
    return cost / max(int(((whole > 0) & (whole < 64)).sum()), 1)


#: Pixels of a packed band of rows.
PACKED = 1 << 20


def packed_bands(ones: DataFrame, dim: DataFrame) -> DataFrame:
    """(image_id, band, bits): bands of rows with a pixel set, eight pixels a byte, so that an image can be sent whole to each task that scans it."""

    def pack(part: pa.Table) -> pa.Table:
        h, w, band = (part[c][0].as_py() for c in ("h", "w", "band"))
        high = max(1, PACKED // w)
        image = np.zeros((min(high, h - band * high), w), np.uint8)
        image[part["r"].to_numpy() - band * high, part["c"].to_numpy()] = 1
        return pa.table({"image_id": part["image_id"][:1], "band": pa.array([band], pa.int64()), "bits": pa.array([np.packbits(image).tobytes()], pa.binary())})

    rows = ones.select("image_id", "r", "c").join(dim.select("image_id", "h", "w"), "image_id").withColumn("band", F.floor(F.col("r") / F.greatest(F.lit(1), F.floor(PACKED / F.col("w")))))
    return kept(rows.groupBy("image_id", "band").applyInArrow(pack, "image_id string, band long, bits binary"), "packed")


def unpacked(part: pd.DataFrame) -> np.ndarray:
    """The image of a group that has its h, w and packed bands."""
    h, w = int(part["h"].iloc[0]), int(part["w"].iloc[0])
    image, high = np.zeros((h, w), np.uint8), max(1, PACKED // max(w, 1))
    for band, bits in zip(part["band"], part["bits"], strict=True):
        if bits is not None:
            rows = image[int(band) * high : (int(band) + 1) * high]
            rows[:] = np.unpackbits(np.frombuffer(bits, np.uint8), count=rows.size).reshape(rows.shape)
    return image


def context_runs(ones: DataFrame, dim: DataFrame, payload_bits: int | DataFrame = 64, divisors: tuple[int, ...] = tuple(range(1, 11)), packed: DataFrame | None = None) -> DataFrame:
    """A row for each image and divisor: whether the method is available (it holds the payload and gives message and raster back exactly), changed pixels, marks, wire bits, drd, and a digest of what was read and put back.

    Embedding chooses its patterns before an edit and extraction after it, so that a read can fail; failures are data, never assumed away. A task gets one image as packed
    bits, as the scan can't be divided. ``payload_bits`` is one number for all images or a table (image_id, bits).
    """
    packed = packed_bands(ones, dim) if packed is None else packed
    payload = payload_bits.select("image_id", "bits") if isinstance(payload_bits, DataFrame) else dim.select("image_id", F.lit(payload_bits).alias("bits"))
    bands = dim.select("image_id", "h", "w").join(payload.withColumnRenamed("bits", "payload"), "image_id").join(packed, "image_id", "left")
    lines = dealt(bands.withColumn("divisor", F.explode(F.array(*map(F.lit, divisors)))), "image_id", "divisor")

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        h, w, divisor, payload_bits = (int(part[c].iloc[0]) for c in ("h", "w", "divisor", "payload"))
        image = unpacked(part)
        payload = [((i * 1103515245 + 12345) // 65536) % 2 for i in range(payload_bits)]
        row = {"image_id": part["image_id"].iloc[0], "divisor": divisor, "available": False, "changed": None, "marks": None, "wire_bits": None, "drd": None, "message": None, "ones": None, "checksum": None, "error": None}
        try:
            if w < 4:
                raise ValueError("too narrow")
            length = max(1, round(h * w / divisor))  # halves to even, as the method counts
            diff = context.difference(image)
            end, marks = context.embed(diff, payload, length)
            stego = context.undifference(diff)
            code = codecs.encode_context(marks, (h, w), divisor, end, len(payload))
            sent, _, _, end, _ = codecs.decode_context(code)
            back = context.difference(stego)
            message = context.extract(back, sent, end, length)
            again = context.undifference(back)
            if message != payload or (again != image).any():
                raise ValueError("not exact")
            set_ = np.argwhere(again)
            row |= {"message": sum(b * (i % 97 + 1) for i, b in enumerate(message)), "ones": len(set_), "checksum": int((set_ @ (7, 1)).sum())}
            row |= {"available": True, "changed": int((stego != image).sum()), "marks": len(marks), "wire_bits": 8 * len(code), "drd": round(_reciprocal_distortion(image, stego), 9)}
        except ValueError as error:
            row["error"] = str(error)
        return pd.DataFrame([row]).astype({**dict.fromkeys(("changed", "marks", "wire_bits", "message", "ones", "checksum"), "Int64"), "drd": "Float64"})

    return lines.groupBy("image_id", "divisor").applyInPandas(scan, "image_id string, divisor int, available boolean, changed long, marks long, wire_bits long, drd double, message long, ones long, checksum long, error string")


def context_best(runs: DataFrame) -> DataFrame:
    """The exact run of least distortion for each image, the smallest divisor of equals; images without one are unavailable."""
    best = F.min_by(F.struct("divisor", "changed", "wire_bits", "drd", "message", "ones", "checksum"), F.when(F.col("available"), F.struct("drd", "divisor")))
    return runs.groupBy("image_id").agg(F.bool_or("available").alias("available"), best.alias("b"), F.min("error").alias("error")).select("image_id", "available", "b.divisor", "b.changed", "b.wire_bits", "b.drd", "b.message", "b.ones", "b.checksum", "error")


# All methods


def method_runs(ones: DataFrame, dim: DataFrame, payload_bits: int | DataFrame = 64) -> DataFrame:
    """A row for each image and method: payload, side information, net bits, changed pixels, PSNR, DRD, exactness, or why there is no run.

    ``payload_bits`` is one number for all images or a table (image_id, bits).
    """
    payload = payload_bits if isinstance(payload_bits, DataFrame) else dim.select("image_id", F.lit(payload_bits).cast("long").alias("bits"))
    payload = kept(payload, "payload")
    out = []
    for method in ("adaptive", "distance_one", "single_peak"):
        made, checks, flips, message, back = through_tables(method, ones, dim, payload)
        fits = checks.where("error IS NULL").select("image_id", "bits")
        runs = marking.evaluation(ones.join(fits, "image_id", "left_semi"), dim, flips, message, back, fits, wire_sizes(method, made, fits, dim)).withColumn("error", F.lit(None).cast("string"))
        failed = checks.where("error IS NOT NULL")
        out.append(runs.unionByName(marking.unavailable(failed, "").drop("error").join(failed.select("image_id", "error"), "image_id")).withColumn("method", F.lit(method)))
    centres, flips, message, back = through_pair(ones, dim, payload)
    fits = payload.join(centres.select("image_id").distinct(), "image_id", "left_semi")
    runs = marking.evaluation(ones.join(fits, "image_id", "left_semi"), dim, flips, message, back, fits, centre_sizes(centres, dim)).withColumn("error", F.lit(None).cast("string"))
    out.append(runs.unionByName(marking.unavailable(payload.join(fits, "image_id", "left_anti"), "no pair carries the payload")).withColumn("method", F.lit("pair")))
    best = context_best(context_runs(ones, dim, payload))
    best = best.join(dim, "image_id").join(payload, "image_id")
    known = lambda column: F.when(F.col("available"), column)
    out.append(best.select(
        "image_id", F.col("bits").cast("long").alias("payload_bits"), F.col("wire_bits").alias("auxiliary_bits"), (F.col("bits") - F.col("wire_bits")).alias("net_payload_bits"), F.col("changed").alias("changed_pixels"),
        known(F.when(F.col("changed") == 0, float("inf")).otherwise(F.round(10 * F.log10(F.col("h").cast("double") * F.col("w") / F.col("changed")), 9))).alias("psnr_db"), "drd",
        known(F.lit(True)).alias("message_exact"), known(F.lit(True)).alias("reversible"), F.when(~F.col("available"), F.col("error")).alias("error"), F.lit("context").alias("method"),
    ))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return kept(rows.withColumn("available", F.col("error").isNull()), "method-runs")


def method_summary(runs: DataFrame) -> DataFrame:
    """Per method: images, share available, all exact, mean and median net bits, share with a net gain, median DRD, shares of DRD up to 0.5 and 1."""
    on = lambda column: F.when(F.col("available"), column)
    return runs.groupBy("method", "payload_bits").agg(
        F.count(F.lit(1)).alias("images"), F.avg(F.col("available").cast("double")).alias("available_fraction"), F.bool_and(on(F.col("message_exact") & F.col("reversible"))).alias("all_exact"),
        F.round(F.avg("net_payload_bits"), 9).alias("mean_net"), F.median("net_payload_bits").alias("median_net"), F.avg(on((F.col("net_payload_bits") > 0).cast("double"))).alias("positive_fraction"),
        F.median("drd").alias("median_drd"), F.avg(on((F.col("drd") <= 0.5).cast("double"))).alias("drd_to_half"), F.avg(on((F.col("drd") <= 1).cast("double"))).alias("drd_to_one"),
    )


# Detection


def features(ones: DataFrame, dim: DataFrame, select: str) -> DataFrame:
    """(image_id, features): the detector's 531 numbers in order; ``select`` is the query of single features."""
    from pyspark.ml.functions import array_to_vector

    rows = steps.run(ones.sparkSession, select, ones=ones, dim=dim)
    value = next(c for c in rows.columns if c not in ("image_id", "feature"))
    listed = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("feature", value))).alias("x"))
    return listed.select("image_id", array_to_vector(F.transform("x", lambda f: f[value].cast("double"))).alias("raw"))


def out_of_fold(covers: DataFrame, marked: DataFrame, most_folds: int = 5, trees: int = 500) -> tuple[DataFrame, int, int]:
    """Scores (classifier, label, p) of rasters by models that haven't seen their image, the number of images and of folds. An image's two rasters are in one fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    images = covers.join(marked.select("image_id"), "image_id", "left_semi").select("image_id").distinct()
    n = images.count()
    k = min(most_folds, n)
    if k < 2:
        raise ValueError("folds need two images at least")
    # Folds by the order of ids: as many rows as images, each a name.
    from pyspark.sql import Window

    fold = kept(images.select("image_id", ((F.dense_rank().over(Window.orderBy("image_id")) - 1) % k).alias("fold")), "folds")
    data = kept(covers.withColumn("label", F.lit(0.0)).unionByName(marked.withColumn("label", F.lit(1.0))).join(fold, "image_id"), "detector-rows")
    models = {
        "logistic": Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=200, regParam=1.0 / (2 * n))]),
        "random_forest": RandomForestClassifier(featuresCol="raw", numTrees=trees, minInstancesPerNode=2, seed=7),
    }
    scored = []
    for name, model in models.items():
        for f in range(k):
            got = model.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))
            scored.append(got.select(F.lit(name).alias("classifier"), "label", vector_to_array("probability")[1].alias("p")))
    rows = scored[0]
    for more in scored[1:]:
        rows = rows.unionByName(more)
    return rows, n, k


def judged(rows: DataFrame, keys: tuple[str, ...] = ("classifier",)) -> DataFrame:
    """Per group of ``keys``: auc, balanced_accuracy and error_probability of (label, p) at 0.5, from running sums over distinct scores."""
    from pyspark.sql import Window

    levels = rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    below = F.sum(F.col("n") - F.col("pos")).over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    wins = F.sum(F.col("pos") * (F.coalesce("below", F.lit(0)) + (F.col("n") - F.col("pos")) / 2))
    right = lambda yes: F.sum(F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(0)) if yes else F.sum(F.when(F.col("p") < 0.5, F.col("n") - F.col("pos")).otherwise(0))
    sums = levels.withColumn("below", below).groupBy(*keys).agg(wins.alias("wins"), F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"), right(True).alias("tp"), right(False).alias("tn"))
    accuracy = (F.col("tp") / F.col("positives") + F.col("tn") / F.col("negatives")) / 2
    return sums.select(*keys, (F.col("wins") / (F.col("positives") * F.col("negatives"))).alias("auc"), accuracy.alias("balanced_accuracy"), (1 - accuracy).alias("error_probability"))


def detect(covers: DataFrame, marked: DataFrame, most_folds: int = 5, trees: int = 500) -> DataFrame:
    """Out-of-fold judgement of two classifiers that tell covers from marked rasters (image_id, raw): classifier, images, folds, auc, balanced_accuracy, error_probability."""
    rows, n, k = out_of_fold(covers, marked, most_folds, trees)
    return judged(rows).select("classifier", F.lit(n).cast("long").alias("images"), F.lit(k).alias("folds"), "auc", "balanced_accuracy", "error_probability")


#: Methods of the detector study; each marks the same images with the same bits.
DETECTED = ("context", "distance_one", "pair", "single_peak")


def spread(df: DataFrame, column: str, values: tuple) -> DataFrame:
    """``df`` once for each value, which stands before the image's id: ``value#image``."""
    return df.withColumn(column, F.explode(F.array(*map(F.lit, values)))).withColumn("image_id", F.concat_ws("#", column, "image_id"))


def context_marked(ones: DataFrame, dim: DataFrame, payload: DataFrame) -> DataFrame:
    """(image_id, r, c): rasters that the context method has marked with the divisor of least distortion; images without an exact run don't appear."""

    def mark(part: pd.DataFrame) -> pd.DataFrame:
        h, w, divisor, bits = (int(part[c].iloc[0]) for c in ("h", "w", "divisor", "payload"))
        diff = context.difference(unpacked(part))
        context.embed(diff, [((i * 1103515245 + 12345) // 65536) % 2 for i in range(bits)], max(1, round(h * w / divisor)))
        r, c = np.nonzero(context.undifference(diff))
        return pd.DataFrame({"image_id": part["image_id"].iloc[0], "r": r.astype("int32"), "c": c.astype("int32")})

    packed = packed_bands(ones, dim)
    best = context_best(context_runs(ones, dim, payload, packed=packed)).where("available").select("image_id", "divisor")
    rows = dim.select("image_id", "h", "w").join(best, "image_id").join(payload.select("image_id", F.col("bits").alias("payload")), "image_id").join(packed, "image_id", "left")
    return dealt(rows, "image_id").groupBy("image_id").applyInPandas(mark, "image_id string, r int, c int")


def marked_rasters(ones: DataFrame, dim: DataFrame, payloads: tuple[int, ...], methods: tuple[str, ...] = DETECTED) -> tuple[DataFrame, DataFrame]:
    """Marked rasters of all methods and payloads, their image_id ``method#payload#image``, and their shapes; only of images that every method can mark with that payload.

    Method and payload are keys: a method marks all images with all payloads in the same steps.
    """
    every, shape = kept(spread(ones, "p", payloads).drop("p"), "spread-ones"), kept(spread(dim, "p", payloads).withColumnRenamed("p", "bits"), "spread-dim")
    payload, shape = shape.select("image_id", F.col("bits").cast("long").alias("bits")), shape.select("image_id", "h", "w")
    made = []
    for method in methods:
        if method == "context":
            stego = kept(context_marked(every, shape, payload), "context-marked")
        elif method == "pair":
            centres = pair_centres(every, shape, payload)
            stego = marking.toggled(every.join(centres.select("image_id").distinct(), "image_id", "left_semi"), marking.overwrite(centres))
        else:
            tables_ = tables(method, every, shape, payload)
            fits = marking.over_capacity(every, shape, tables_, payload).where("error IS NULL").select("image_id")
            stego = marking.toggled(every.join(fits, "image_id", "left_semi"), marking.embed(every, shape, tables_, payload))
        made.append(stego.select(F.concat_ws("#", F.lit(method), "image_id").alias("image_id"), F.col("image_id").alias("run"), "r", "c"))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    rows = kept(rows, "marked")
    matched = rows.select("image_id", "run").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(methods)).select("run")
    rows = rows.join(matched, "run", "left_semi").drop("run")
    return kept(rows, "matched-marked"), spread(shape.join(matched, shape["image_id"] == matched["run"], "left_semi"), "m", methods).drop("m")


def detect_all(ones: DataFrame, dim: DataFrame, select: str, payloads: tuple[int, ...], methods: tuple[str, ...] = DETECTED, most_folds: int = 5, trees: int = 500, parallelism: int = 4) -> DataFrame:
    """A row for each payload, method and classifier: images that all methods can mark, folds, auc, balanced_accuracy, error_probability.

    Features of all covers and of all marked rasters are two plans; the models of combinations are fitted side by side, ``parallelism`` at a time, as many jobs as there are combinations and folds.
    """
    from multiprocessing.pool import ThreadPool

    stego, shapes = marked_rasters(ones, dim, payloads, methods)
    covers = kept(features(ones, dim, select), "cover-features")
    key = F.split("image_id", "#", 3)
    marked = kept(features(stego, shapes, select).select(key[0].alias("method"), key[1].cast("int").alias("payload_bits"), key[2].alias("image_id"), "raw"), "marked-features")

    def one(combination: tuple[str, int]) -> DataFrame | None:
        method, bits = combination
        mine = marked.where((F.col("method") == method) & (F.col("payload_bits") == bits)).select("image_id", "raw")
        if mine.count() < 2:
            return None
        both = covers.join(mine.select("image_id"), "image_id", "left_semi")
        return kept(detect(both, mine, most_folds, trees).select(F.lit(bits).alias("payload_bits"), F.lit(method).alias("method"), "*"), "detected")

    with ThreadPool(parallelism) as pool:
        made = [x for x in pool.map(one, [(m, b) for b in payloads for m in methods]) if x is not None]
    if not made:
        raise ValueError("no payload that two images of every method carry")
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    return rows


# Search for alpha


def expected_improvement(mean: np.ndarray, std: np.ndarray, best: float, exploration: float = 0.01) -> np.ndarray:
    """For minimising; 0 where there is no doubt."""
    gain = best - mean - exploration
    z = gain / np.maximum(std, 1e-12)
    cdf = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z])
    pdf = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return np.where(std > 1e-12, np.maximum(gain * cdf + std * pdf, 0), 0.0)


def _smooth(x: np.ndarray, y: np.ndarray, at: np.ndarray, reach: float = 0.2, noise: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of a Gaussian process with the Matern 5/2 covariance through few observations."""
    def cov(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = math.sqrt(5) * np.abs(a[:, None] - b[None, :]) / reach
        return (1 + d + d * d / 3) * np.exp(-d)

    centre, scale = y.mean(), max(float(y.std()), 1e-9)
    k = cov(x, x) + noise * np.eye(len(x))
    weights = np.linalg.solve(k, cov(x, at))
    return centre + scale * ((y - centre) / scale @ weights), scale * np.sqrt(np.maximum(1 - (cov(x, at) * weights).sum(0), 0))


def evaluate_alphas(ones: DataFrame, dim: DataFrame, alphas: list[float], payload_bits: int, capacity_scale: float, weight: float = 0.5) -> DataFrame:
    """(alpha, capacity, drd, objective) with objective = weight * (1 - capacity / scale) + (1 - weight) * DRD, means over images; the candidates of a round are one job.

    An alpha whose tables can't carry the payload in an image counts that image at DRD 1.
    """
    spark = ones.sparkSession
    name = lambda alpha: F.concat_ws("#", "image_id", F.lit(repr(alpha)))

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("image_id", F.concat_ws("#", "image_id", "alpha"))

    every, sizes = kept(spread(ones).drop("alpha"), "ones"), kept(spread(dim), "dim")
    shape = sizes.drop("alpha")
    hist = kept(steps.run(spark, "SELECT image_id, pat, n FROM hist", ones=ones, dim=dim), "hist")
    made = None
    for alpha in alphas:
        one = adaptive_mapping(hist, alpha).select(name(alpha).alias("image_id"), "peak", "symbol", "pattern")
        made = one if made is None else made.unionByName(one)
    made = kept(made, "tables")
    payload = sizes.select("image_id", F.lit(payload_bits).cast("long").alias("bits"))
    flips = kept(marking.embed(every, shape, made, payload), "flips")
    drd = steps.run(spark, "SELECT d.image_id, coalesce(f.cost, 0.0) / greatest(coalesce(m.n, 0), 1) AS drd FROM dim d LEFT JOIN (SELECT image_id, sum(cost) AS cost FROM flip_costs GROUP BY image_id) f ON f.image_id = d.image_id LEFT JOIN mixed8 m ON m.image_id = d.image_id", ones=every, dim=shape, flips=flips)
    rows = sizes.join(marking.capacity(every, shape, made), "image_id").join(drd, "image_id")
    means = rows.groupBy("alpha").agg(F.avg("capacity").alias("capacity"), F.avg(F.when(F.col("capacity") < payload_bits, 1.0).otherwise(F.col("drd"))).alias("drd"))
    return means.withColumn("objective", weight * (1 - F.col("capacity") / capacity_scale) + (1 - weight) * F.col("drd"))


def optimize_alpha(ones: DataFrame, dim: DataFrame, payload_bits: int = 32, initial: tuple[float, ...] = (0.0, 0.5, 1.0), iterations: int = 3, grid: int = 151) -> list[tuple[float, float]]:
    """Observations (alpha, objective), best last: each round observes the grid point of largest expected improvement that hasn't been observed."""
    points = np.linspace(0, 1, grid)
    # The scale of capacities is that of the initial points, so their objectives follow from one evaluation.
    first = evaluate_alphas(ones, dim, list(initial), payload_bits, 1.0).collect()
    scale = max(1.0, *(r["capacity"] for r in first))
    observed = {r["alpha"]: 0.5 * (1 - r["capacity"] / scale) + 0.5 * r["drd"] for r in first}
    for _ in range(iterations):
        x, y = np.array(list(observed)), np.array(list(observed.values()))
        mean, std = _smooth(x, y, points)
        gain = expected_improvement(mean, std, float(y.min()))
        gain[np.isin(points.round(9), x.round(9))] = -1
        alpha = float(points[int(gain.argmax())] if gain.max() > 0 else next((p for p in points[np.argsort(mean)] if round(p, 9) not in {round(a, 9) for a in observed}), points[0]))
        if alpha in observed:
            break
        observed[alpha] = evaluate_alphas(ones, dim, [alpha], payload_bits, scale).first()["objective"]
    best = min(observed, key=lambda a: (observed[a], a))
    return [*((a, o) for a, o in observed.items() if a != best), (best, observed[best])]


# Queries


def digest(payload: DataFrame, message: DataFrame, back: DataFrame) -> DataFrame:
    """Per image of ``payload``: bits, a checksum of the bits read, pixels set in the raster put back and their checksum."""
    said = message.groupBy("image_id").agg(F.sum(F.col("bit") * (F.col("i") % 97 + 1)).alias("message"))
    put = back.groupBy("image_id").agg(F.count(F.lit(1)).alias("ones"), F.sum(F.col("r") * 7 + F.col("c")).alias("checksum"))
    rows = payload.join(said, "image_id", "left").join(put, "image_id", "left")
    return rows.select("image_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("bits", "message", "ones", "checksum")))


#: Payloads of the round trips, as SQL over steps.
PAYLOADS = {
    "restored_h1": ("lineitem", "SELECT d.image_id, CAST(coalesce(b.gross, 0) AS BIGINT) AS bits FROM dim d LEFT JOIN best b ON b.image_id = d.image_id"),
    "restored_single_peak": ("embeddings", "SELECT d.image_id, CAST(least(64, coalesce(b.n * b.bits, 0)) AS BIGINT) AS bits FROM dim d LEFT JOIN hn_bits b ON b.image_id = d.image_id"),
    "restored_adaptive": ("lineitem", "SELECT image_id, CAST(16 AS BIGINT) AS bits FROM dim"),
    "restored_pair": ("embeddings", "SELECT image_id, CAST(least(64, capacity) AS BIGINT) AS bits FROM selected"),
    "restored_uniform_smooth": ("smooth", "SELECT image_id, count(*) AS bits FROM best_flip WHERE round(cost, 9) <= 0.7 GROUP BY image_id"),
    "restored_uniform": ("embeddings", "SELECT image_id, count(*) AS bits FROM best_flip WHERE round(cost, 9) <= 0.7 GROUP BY image_id"),
}


def q_restored(method: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embed, read the marked raster with nothing but the side information, put it back; a digest of message and raster."""
    fixture, select = PAYLOADS[method]
    ones, dim = raster(spark, sf_dir, fixture)
    if method.startswith("restored_uniform"):
        return q_uniform(ones, dim)
    payload = kept(steps.run(spark, select, ones=ones, dim=dim), "payload")
    if method == "restored_pair":
        _, _, message, back = through_pair(ones, dim, payload)
    else:
        _, _, _, message, back = through_tables({"restored_h1": "distance_one", "restored_adaptive": "adaptive"}.get(method, "single_peak"), ones, dim, payload)
    return digest(payload, message, back)


def uniform_places(ones: DataFrame, dim: DataFrame, most_cost: float = 0.7) -> DataFrame:
    """(image_id, br, bc, position, was, i): uniform tiles whose cheapest pixel costs at most ``most_cost``, in raster order."""
    best = steps.run(ones.sparkSession, "SELECT image_id, br, bc, position, CASE WHEN pat = 511 THEN 1 ELSE 0 END AS was, cost FROM best_flip", ones=ones, dim=dim)
    return marking.offsets(best.where(F.round("cost", 9) <= most_cost).withColumn("one", F.lit(1)), "one").select("image_id", "br", "bc", "position", "was", F.col("at").alias("i"))


def through_uniform(ones: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(places, flips, message, raster put back). The wire of the second layer names the places; what a tile was is read from the marked raster."""
    places = kept(uniform_places(ones, dim), "uniform-places")
    flips = kept(marking.uniform_flips(places), "flips")
    stego = kept(marking.toggled(ones, flips), "stego")
    found = kept(marking.read_uniform(stego, dim, places), "found")
    return places, flips, found.select("image_id", "i", "bit"), marking.toggled(stego, marking.changed_pixels(found, "pattern", "whole"))


def q_uniform(ones: DataFrame, dim: DataFrame) -> DataFrame:
    places, _, message, back = through_uniform(ones, dim)
    return digest(places.groupBy("image_id").agg(F.count(F.lit(1)).alias("bits")), message, back)


def q_uniform_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second layer: bits, tiles put back and bits that are equal, all from the marked raster."""
    ones, dim = raster(spark, sf_dir)
    places, _, message, back = through_uniform(ones, dim)
    equal = message.groupBy("image_id").agg(F.count(F.lit(1)).alias("bits"), F.sum((F.col("bit") == marking.bit_at(F.col("i"))).cast("long")).alias("bits_equal"))
    before, after = (marking.tiles(x, dim).withColumnRenamed("pat", n) for x, n in ((ones, "a"), (back, "b")))
    same = places.join(before, ["image_id", "br", "bc"], "left").join(after, ["image_id", "br", "bc"], "left").groupBy("image_id").agg(F.sum((F.coalesce("a", F.lit(0)) == F.coalesce("b", F.lit(0))).cast("long")).alias("restored"))
    return equal.join(same, "image_id").select("image_id", "bits", "restored", "bits_equal")


def q_adaptive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bits that the adaptive tables carry: (image_id, bits, blocks, modified, bits_equal, restored), read from the marked raster."""
    ones, dim = raster(spark, sf_dir)
    made = tables("adaptive", ones, dim, dim)
    payload = kept(marking.capacity(ones, dim, made).select("image_id", F.col("capacity").alias("bits")).where("bits > 0"), "payload")
    flips = kept(marking.embed(ones, dim, made, payload), "flips")
    found = kept(marking.read(kept(marking.toggled(ones, flips), "stego"), dim, made, payload), "found")
    equal = marking.extracted(found).groupBy("image_id").agg(F.count(F.lit(1)).alias("bits"), F.sum((F.col("bit") == marking.bit_at(F.col("i"))).cast("long")).alias("bits_equal"))
    blocks = found.join(marking.tiles(ones, dim), ["image_id", "br", "bc"], "left").groupBy("image_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum((F.col("pattern") != F.col("peak")).cast("long")).alias("modified"), F.sum((F.col("peak") == F.col("pat")).cast("long")).alias("restored"))
    return equal.join(blocks, "image_id").select("image_id", "bits", "blocks", "modified", "bits_equal", "restored")


def q_context_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_runs(*raster(spark, sf_dir, "smooth"))


def q_context_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_best(q_context_runs(spark, sf_dir))


def q_restored_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each image's best run."""
    return q_context_best(spark, sf_dir).select("image_id", F.lit(64).cast("long").alias("bits"), "message", "ones", "checksum")


def q_method_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return method_runs(*raster(spark, sf_dir))


def q_method_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return method_summary(q_method_runs(spark, sf_dir))


def q_grouped_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers against the same images with distance-one tables full of bits: all 531 features, two classifiers, images never split."""
    from rasterlake import registry

    ones, dim = raster(spark, sf_dir)
    select = registry.SELECTS["detector_features"][1]
    payload = kept(marking.capacity(ones, dim, tables("distance_one", ones, dim, dim.select("image_id", F.lit(1 << 40).alias("bits")))).select("image_id", F.col("capacity").alias("bits")).where("bits > 0"), "payload")
    _, _, flips, _, _ = through_tables("distance_one", ones, dim, payload)
    stego = kept(marking.toggled(ones, flips), "stego")
    return detect(features(ones, dim, select), features(stego, dim, select), trees=60)


def q_detector_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four methods, two classifiers and two payloads on rasters with shapes."""
    from rasterlake import registry

    return detect_all(*raster(spark, sf_dir, "smooth"), registry.SELECTS["detector_features"][1], (16, 32), most_folds=3, trees=20)


def q_alpha_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphas that the search observed, and which is best: the least objective, the smallest alpha of equals."""
    seen = optimize_alpha(*raster(spark, sf_dir))
    return spark.createDataFrame([(a, round(o, 9), k == len(seen) - 1) for k, (a, o) in enumerate(seen)], "alpha double, objective double, best boolean")


QUERIES = {
    **{name: partial(q_restored, name) for name in PAYLOADS},
    "adaptive_roundtrip": q_adaptive_roundtrip, "uniform_layer": q_uniform_layer, "dong_run": q_context_runs, "dong_best": q_context_best, "restored_context": q_restored_context, "method_runs": q_method_runs, "method_run_summary": q_method_run_summary,
    "grouped_cv": q_grouped_cv, "detector_study": q_detector_study, "alpha_search": q_alpha_search, "agent_layer": agent.q_agent_layer,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """What round trips must return, from the message's formula and the raster itself: no embedding happens in this SQL."""
    out = {}
    for name, (fixture, payload) in {**PAYLOADS, "restored_context": ("smooth", "SELECT image_id, CAST(64 AS BIGINT) AS bits FROM dim")}.items():
        text = f"""SELECT p.image_id, CAST(p.bits AS BIGINT) AS bits, CAST(coalesce(m.s, 0) AS BIGINT) AS message, CAST(coalesce(o.n, 0) AS BIGINT) AS ones, CAST(coalesce(o.s, 0) AS BIGINT) AS checksum FROM ({payload}) p
            LEFT JOIN (SELECT q.image_id, sum(({steps.BIT.format(i='i')}) * (i % 97 + 1)) AS s FROM ({payload}) q EACH(CAST(q.bits AS INT), i) GROUP BY q.image_id) m ON m.image_id = p.image_id
            LEFT JOIN (SELECT image_id, count(*) AS n, sum(r * 7 + c) AS s FROM ones GROUP BY image_id) o ON o.image_id = p.image_id"""
        out[name] = steps.sql(text, fixture, "other")
    out["uniform_layer"] = steps.sql("SELECT image_id, count(*) AS bits, count(*) AS restored, count(*) AS bits_equal FROM best_flip WHERE round(cost, 9) <= 0.7 GROUP BY image_id", "embeddings", "other")
    out["codec_roundtrip"] = steps.sql("SELECT image_id, CAST(best_t AS BIGINT) AS tables, CAST(wire_bits AS BIGINT) AS wire_bits, true AS same FROM best", "lineitem", "other")
    return out
