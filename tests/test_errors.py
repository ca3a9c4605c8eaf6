"""What raises an error where the definition says so."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterlake.operators import marking
from rasterlake.sources import samples


def test_a_pattern_that_stands_twice(spark):
    tables = spark.createDataFrame([("a", 7, 0, 7), ("a", 7, 1, 5), ("a", 9, 0, 9), ("a", 9, 1, 5), ("b", 7, 0, 7), ("b", 7, 1, 5)], "image_id string, peak int, symbol int, pattern int")
    assert sorted(map(tuple, marking.inverted(tables.where("image_id = 'b'")).collect())) == [("b", 5, 7, 1), ("b", 7, 7, 0)]
    with pytest.raises(PySparkException, match="pattern 5 of image a stands twice"):
        marking.inverted(tables).collect()


def test_patterns_out_of_range(spark):
    rows = spark.createDataFrame([(0b100000011,), (0,), (511,)], "p int")
    assert [r.x for r in rows.select(marking.pattern_pixels(F.col("p")).alias("x")).collect()] == [[1, 0, 0, 0, 0, 0, 0, 1, 1], [0] * 9, [1] * 9]
    for bad in (-1, 512):
        with pytest.raises(PySparkException, match="not a 3x3 pattern"):
            spark.createDataFrame([(bad,)], "p int").select(marking.pattern_pixels(F.col("p"))).collect()


def test_messages_that_are_too_short_and_other_shapes(spark):
    message = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("b", 0, 1)], "image_id string, i long, bit int")
    payload = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "image_id string, bits long")
    assert {r.image_id: r.message for r in marking.complete(message, payload).collect()} == {"a": [1, 0], "b": [1], "c": []}
    with pytest.raises(PySparkException, match="image b gave 1 bits of 4"):
        marking.complete(message, payload.withColumn("bits", F.when(F.col("image_id") == "b", 4).otherwise(F.col("bits")))).collect()
    dim = spark.createDataFrame([("a", 9, 6), ("b", 3, 3)], "image_id string, h int, w int")
    assert marking.same_shape(dim, dim.where("image_id = 'a'")).count() == 2
    with pytest.raises(PySparkException, match="image a has another shape"):
        marking.same_shape(dim, dim.withColumn("w", F.col("w") + 1)).where("image_id = 'a'").collect()


def test_splits_are_disjoint_and_sizes_are_checked(spark):
    rows = spark.createDataFrame([(k, f"r{k}") for k in range(50)], "id long, name string")
    one, other = ({(r.id, r.part) for r in samples.split(rows.repartition(n), "id", 12, 20, 7).collect()} for n in (1, 5))
    assert one == other and len({i for i, _ in one}) == 32 and sum(p == "train" for _, p in one) == 12
    assert {i for i, _ in one} != {r.id for r in samples.split(rows, "id", 12, 20, 8).collect()}
    assert {r.id for r in samples.sample(rows, "id", 12, 7).collect()} == {i for i, p in one if p == "train"} and samples.sample(rows, "id", 99, 7).count() == 50
    for sizes, why in (((40, 11), "50 there"), ((0, 5), "a row at least")):
        with pytest.raises(ValueError, match=why):
            samples.split(rows, "id", *sizes, 7)
    with pytest.raises(ValueError, match="stands twice"):
        samples.split(rows.union(rows.limit(1)), "id", 1, 1, 7)
