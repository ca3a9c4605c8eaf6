"""The uniform-tile agent: which uniform tiles can carry a bit, and in which pixel, learned from the exact costs of training rasters."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.operators import marking
from rasterlake.plans import steps
from rasterlake.stages import kept


def tile_features(ones: DataFrame, dim: DataFrame) -> DataFrame:
    """(image_id, br, bc, pat, features, constant): 81 pixels around each uniform tile, its value, their density and changes along both axes."""
    spark = ones.sparkSession
    context = kept(steps.run(spark, "SELECT image_id, br, bc, pat, i, v FROM context", ones=ones, dim=dim), "context")
    listed = context.groupBy("image_id", "br", "bc", "pat").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).withColumn("x", F.transform("x", lambda p: p["v"].cast("double")))
    changes = lambda step, use: F.aggregate(F.sequence(F.lit(0), F.lit(80 - step)), F.lit(0.0), lambda acc, k: acc + F.when(use(k) & (F.get("x", k) != F.get("x", k + step)), 1.0).otherwise(0.0)) / 72
    density = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v) / 81
    measured = listed.select("image_id", "br", "bc", "pat", "x", density.alias("density"), changes(1, lambda k: k % 9 < 8).alias("across"), changes(9, lambda k: k >= 0).alias("down"))
    value = F.when(F.col("pat") == 511, 1.0).otherwise(0.0)
    return measured.select("image_id", "br", "bc", "pat", array_to_vector(F.concat("x", F.array(value, "density", "across", "down"))).alias("features"), F.col("density").isin(0.0, 1.0).alias("constant"))


def invariant(pattern: F.Column) -> F.Column:
    """A tile's majority value if its marks can't have changed it (at most one pixel differs), else null."""
    n = F.bit_count(pattern)
    return F.when(n <= 1, 0).when(n >= 8, 1)


def training_samples(ones: DataFrame, dim: DataFrame, safe_cost: float = 0.5, unsafe_ratio: int = 5) -> DataFrame:
    """(image_id, br, bc, features, safe, position): tiles whose cheapest pixel costs at most ``safe_cost``, ``unsafe_ratio`` times as many others of each image,
    and as many with a context of one colour, chosen by a hash of the tile (the sampling is the operator)."""
    best = kept(steps.run(ones.sparkSession, "SELECT image_id, br, bc, position, cost FROM best_flip", ones=ones, dim=dim), "best-flip")
    rows = tile_features(ones, dim).join(best, ["image_id", "br", "bc"]).withColumn("safe", (F.round("cost", 9) <= safe_cost).cast("int"))
    rows = kept(rows.withColumn("kind", F.when(F.col("constant"), 2).otherwise(1 - F.col("safe"))), "tiles")
    safe = rows.where("kind = 0").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    # Only a hash and the tile go through the ranking.
    order = Window.partitionBy("image_id", "kind").orderBy(F.xxhash64("br", "bc"), "br", "bc")
    ranked = rows.select("image_id", "br", "bc", "kind").withColumn("o", F.row_number().over(order)).join(safe, "image_id")
    kept_tiles = ranked.where(F.col("o") <= F.when(F.col("kind") == 0, F.col("n")).when(F.col("kind") == 1, F.col("n") * unsafe_ratio).otherwise(F.col("n"))).select("image_id", "br", "bc")
    return rows.join(kept_tiles, ["image_id", "br", "bc"]).select("image_id", "br", "bc", "features", F.when(F.col("kind") == 0, 1.0).otherwise(0.0).alias("safe"), F.col("position").cast("double").alias("position"))


def train(samples: DataFrame, trees: int = 120, depth: int = 14) -> tuple[RandomForestClassificationModel, RandomForestClassificationModel]:
    """Forests for safe tiles and, of safe ones, for the pixel."""
    forest = lambda label: RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=7)
    samples = kept(samples, "samples")
    safe = samples.where("safe = 1")
    if not safe.limit(1).count() or not samples.where("safe = 0").limit(1).count():
        raise ValueError("training needs safe and unsafe tiles")
    return forest("safe").fit(samples), forest("position").fit(safe)


def save(models: tuple[RandomForestClassificationModel, RandomForestClassificationModel], folder: str) -> None:
    for name, model in zip(("safe", "position"), models, strict=True):
        model.write().overwrite().save(f"{folder}/{name}")


def load(folder: str) -> tuple[RandomForestClassificationModel, RandomForestClassificationModel]:
    return tuple(RandomForestClassificationModel.load(f"{folder}/{name}") for name in ("safe", "position"))


def safe_tiles(ones: DataFrame, dim: DataFrame, models: tuple, threshold: float = 0.7) -> DataFrame:
    """(image_id, br, bc, position, was, i): uniform tiles that the agent calls safe with ``threshold`` or more, with the pixel it names, in raster order."""
    safe, position = models
    # Both are written: in one plan features would be made again for each model's columns, and models asked again for each use of the places.
    features = kept(tile_features(ones, dim).drop("constant"), "tile-features")
    scored = kept(safe.transform(features).where(vector_to_array("probability")[1] >= threshold).select("image_id", "br", "bc", "pat", "features"), "safe-tiles")
    named = position.transform(scored).select("image_id", "br", "bc", F.col("prediction").cast("int").alias("position"), F.when(F.col("pat") == 511, 1).otherwise(0).alias("was"), F.lit(1).alias("one"))
    return marking.offsets(named, "one").select("image_id", "br", "bc", "position", "was", F.col("at").alias("i"))


def judged(samples: DataFrame, folds: int = 3, trees: int = 120, depth: int = 14) -> DataFrame:
    """Out-of-fold precision, recall and share of right pixels, images never split."""
    images = samples.select("image_id").distinct().withColumn("fold", ((F.dense_rank().over(Window.orderBy("image_id")) - 1) % folds))
    rows = kept(samples.join(images, "image_id"), "fold-samples")
    out = None
    for fold in range(folds):
        held = rows.where(F.col("fold") == fold)
        if not held.limit(1).count():
            continue
        safe, position = train(rows.where(F.col("fold") != fold).drop("fold"), trees, depth)
        got = safe.transform(held).select("image_id", "br", "bc", "features", "safe", F.col("prediction").alias("said"), F.col("position").alias("pixel"))
        got = position.transform(got).select("safe", "said", (F.col("prediction") == F.col("pixel")).cast("double").alias("right"))
        out = got if out is None else out.unionByName(got)
    both = F.sum((F.col("safe") == 1).cast("double") * (F.col("said") == 1).cast("double"))
    return out.agg(F.count(F.lit(1)).alias("samples"), (both / F.sum((F.col("said") == 1).cast("double"))).alias("precision"), (both / F.sum("safe")).alias("recall"), F.avg(F.when(F.col("safe") == 1, F.col("right"))).alias("position_accuracy"))


def q_agent_layer(spark: SparkSession, sf_dir: str, trees: int = 20, depth: int = 8) -> DataFrame:
    """Trained on half of the images, the agent picks tiles in all of them; bits go in and come back: (image_id, bits, bits_equal, apart), ``apart`` pixels that differ after restoring."""
    from rasterlake.operators.study import raster

    ones, dim = raster(spark, sf_dir, "smooth")
    half = F.pmod(F.xxhash64("image_id"), F.lit(2)) == 0
    models = train(training_samples(ones.where(half), dim.where(half)), trees, depth)
    places = kept(safe_tiles(ones, dim, models), "agent-places")
    stego = kept(marking.toggled(ones, marking.uniform_flips(places)), "stego")
    found = kept(marking.read_uniform(stego, dim, places), "found")
    apart = marking.toggled(ones, marking.toggled(stego, marking.changed_pixels(found, "pattern", "whole"))).groupBy("image_id").agg(F.count(F.lit(1)).alias("apart"))
    bits = found.groupBy("image_id").agg(F.count(F.lit(1)).alias("bits"), F.sum((F.col("bit") == marking.bit_at(F.col("i"))).cast("long")).alias("bits_equal"))
    return dim.select("image_id").join(bits, "image_id", "left").join(apart, "image_id", "left").select("image_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bits", "bits_equal", "apart")))
