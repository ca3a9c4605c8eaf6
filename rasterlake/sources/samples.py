"""Reproducible samples: rows in the order of a seeded hash of their id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample(rows: DataFrame, column: str, size: int, seed: int) -> DataFrame:
    """``size`` rows, or all if there are fewer; the same ones at every number of partitions."""
    return rows.orderBy(F.xxhash64(column, F.lit(seed)), column).limit(size)


def split(rows: DataFrame, column: str, train_size: int, test_size: int, seed: int) -> DataFrame:
    """``rows`` of two disjoint samples with ``part``: train or test. An error if there aren't as many ids, or an id stands twice. Only the samples' ids are ranked."""
    if train_size < 1 or test_size < 1:
        raise ValueError("both parts need a row at least")
    ids = rows.agg(F.count(column).alias("n"), F.count_distinct(column).alias("ids")).first()
    if ids["n"] != ids["ids"]:
        raise ValueError("an id stands twice, so that parts couldn't be disjoint")
    if train_size + test_size > ids["n"]:
        raise ValueError(f"{train_size} and {test_size} rows asked for, {ids['n']} there")
    taken = sample(rows.where(F.col(column).isNotNull()).select(column), column, train_size + test_size, seed)
    place = F.row_number().over(Window.orderBy(F.xxhash64(column, F.lit(seed)), column))
    return rows.join(taken.withColumn("part", F.when(place <= train_size, "train").otherwise("test")), column)
