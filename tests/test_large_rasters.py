"""What rasters of larger tables ask for: every pattern in use, joins that don't grow with the square of an image."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import registry
from rasterlake.operators import bands, marking, study
from rasterlake.plans import steps
from rasterlake.registry import queries
from rasterlake.stages import kept
from tests.test_oracle import SF, duck, rows  # noqa: F401


def vectors(spark, folder, sizes: dict[int, int], width: int = 9, seed: int = 5) -> str:
    """``embeddings`` of random signs in ``folder``: so many vectors of each label."""
    draw, labels = random.Random(seed), [label for label, n in sizes.items() for _ in range(n)]
    rows = [(k, label, [draw.choice((-1.0, 1.0)) for _ in range(width)]) for k, label in enumerate(labels)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("sizes", [{0: 2, 8: 2}, {0: 2, 8: 60}])
def test_cost_ranker_without_rows_to_learn_from(spark, tmp_path, sizes):
    got = queries()["cost_ranker"](spark, vectors(spark, tmp_path, sizes)).collect()
    assert len(got) == 1 and (got[0].rows > 0) == (sizes[8] > 2) and got[0].mae is None and got[0].pearson is None


@pytest.mark.parametrize("name", ["bit_costs", "best_uniform_flip"])
def test_pixels_meet_their_tile_and_not_all_tiles_of_the_image(spark, duck, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"NestedLoopJoin.* = ", plan)
    assert rows(df.toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())


def test_rows_of_pixels_are_dealt_out(spark):
    """``dim`` has a row per image; what is made of it isn't left to the task that reads it."""
    df = steps.run(spark, "SELECT * FROM px", SF, "embeddings")
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_scans_of_packed_images_are_dealt_over_tasks(spark):
    """Ten scans of small packed images: Spark's own choice would be one task."""
    rng = np.random.default_rng(3)
    images = {"a": rng.integers(0, 2, (40, 30)), "b": rng.integers(0, 2, (7, 50)), "c": np.zeros((5, 9), int)}
    ones = spark.createDataFrame([(k, int(r), int(c)) for k, x in images.items() for r, c in np.argwhere(x)], "image_id string, r int, c int")
    dim = spark.createDataFrame([(k, *x.shape) for k, x in images.items()], "image_id string, h int, w int")
    packed = study.packed_bands(ones, dim)
    lines = study.dealt(dim.join(packed, "image_id", "left").withColumn("divisor", F.explode(F.sequence(F.lit(1), F.lit(10)))), "image_id", "divisor")
    assert lines.rdd.getNumPartitions() >= 16 and len({x for x in lines.select(F.spark_partition_id()).distinct().collect()}) > 8
    for k, part in dim.join(packed, "image_id", "left").toPandas().groupby("image_id"):
        assert (study.unpacked(part) == images[k]).all()
    both = study.context_runs(ones, dim, dim.select("image_id", F.when(F.col("image_id") == "a", 8).otherwise(4).alias("bits")), (1, 3)).orderBy("image_id", "divisor").collect()
    apart = [r for k in "abc" for r in study.context_runs(ones.where(F.col("image_id") == k), dim.where(F.col("image_id") == k), 8 if k == "a" else 4, (1, 3)).orderBy("divisor").collect()]
    assert both == apart and len(both) == 6


def test_bands_give_the_scores_and_centres_of_dense_pixels(spark, monkeypatch):
    """Bands of two rows and more, an image without a pixel and one of odd shape, against the steps over a row per pixel."""
    rng = np.random.default_rng(4)
    images = {"a": rng.integers(0, 2, (41, 30)), "b": (rng.random((23, 11)) < 0.2).astype(int), "c": np.zeros((9, 6), int)}
    ones = kept(spark.createDataFrame([(k, int(r), int(c)) for k, x in images.items() for r, c in np.argwhere(x)], "image_id string, r int, c int"), "ones")
    dim = kept(spark.createDataFrame([(k, *x.shape) for k, x in images.items()], "image_id string, h int, w int"), "dim")
    payload = spark.createDataFrame([("a", 60), ("b", 20), ("c", 5)], "image_id string, bits long")
    level_px, scores = study.pair_tables(ones, dim)
    want = sorted(marking.pair_centres(level_px, scores, payload).select("image_id", "r", "c", "i", "original").collect())
    monkeypatch.setattr(bands, "AREA", 60)
    sums = bands.level_sums(ones, dim)
    plain = lambda df: {(r.image_id, r.first_level): (r.capacity, None if r.score is None else round(r.score, 6)) for r in df.collect()}
    assert sums.select("image_id", "band").distinct().count() > 20 and plain(bands.pair_scores(sums, dim)) == plain(scores)
    assert sorted(study.pair_centres(ones, dim, payload).select("image_id", "r", "c", "i", "original").collect()) == want and len(want) == 85


def test_distortion_of_an_image_inverted_as_a_whole_is_counted_by_arrays():
    """Each pixel changes; one at a time that took about a minute for an image of 1 GB of tables."""
    image = np.random.default_rng(5).integers(0, 2, (4000, 64), dtype=np.uint8)
    small, began = image[:9, :10], time.process_time()
    want = sum(w * (small[r + a, c + b] != 1 - small[r, c]) for r in range(9) for c in range(10) for a, b, w in steps.kernel() if 0 <= r + a < 9 and 0 <= c + b < 10)
    assert abs(study._reciprocal_distortion(small, 1 - small) - want) < 1e-9
    study._reciprocal_distortion(image, 1 - image)
    assert time.process_time() - began < 3
