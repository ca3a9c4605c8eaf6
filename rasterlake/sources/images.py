"""Raster files: gray maps (PGM, P5 and P2) and what Spark's image reader decodes, as pixel rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = re.compile(rb"^(P[25])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)\s")


def parse_pgm(data: bytes) -> np.ndarray:
    """Gray values of a portable gray map, scaled to 0..255 where its maximum is another."""
    head = HEAD.match(data)
    if not head:
        raise ValueError("not a gray map")
    w, h, top = int(head[3]), int(head[5]), int(head[7])
    body = data[head.end() :]
    if head[1] == b"P2":
        gray = np.array(body.split()[: w * h], np.int64)
    else:
        gray = np.frombuffer(body, ">u2" if top > 255 else np.uint8, w * h).astype(np.int64)
    return (gray if top == 255 else gray * 255 // top).reshape(h, w).astype(np.int16)


def pgm_rows(spark: SparkSession, folder: str, pattern: str = "*.pgm") -> DataFrame:
    """(image_id, r, gray array): a row for each raster line, so that wide images stay small rows; image_id is the file's stem."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, data in zip(batch["image_id"], batch["content"], strict=True):
                gray = parse_pgm(bytes(data))
                yield pd.DataFrame({"image_id": image, "r": np.arange(len(gray), dtype=np.int32), "gray": list(gray)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select(stem.alias("image_id"), "content").mapInPandas(parse, "image_id string, r int, gray array<smallint>")


def decoded_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same of images that Spark decodes (PNG, JPEG, BMP, GIF); of coloured ones the luma of their blue, green and red bytes. Lines of one image go to Python at a time."""
    image = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    lines = image.select(F.regexp_extract("origin", r"([^/]+)\.[^./]+$", 1).alias("image_id"), "width", "nChannels", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda r: F.substring("data", r * F.col("width") * F.col("nChannels") + 1, F.col("width") * F.col("nChannels")))).alias("r", "line"))

    def luma(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gray = []
            for width, channels, line in zip(batch["width"], batch["nChannels"], batch["line"], strict=True):
                x = np.frombuffer(line, np.uint8).reshape(width, channels).astype(np.int64)
                gray.append((x[:, 0] if channels == 1 else (x[:, :3] @ np.array([114, 587, 299]) + 500) // 1000).astype(np.int16))
            yield pd.DataFrame({"image_id": batch["image_id"], "r": batch["r"], "gray": gray})

    return lines.mapInPandas(luma, "image_id string, r int, gray array<smallint>")


def raster(rows: DataFrame, threshold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ones, dim) of gray lines: value > 0, or value >= threshold where one is given (the two rules differ at the threshold)."""
    px = rows.select("image_id", "r", F.posexplode("gray").alias("c", "g"))
    ones = px.where(F.col("g") > 0 if threshold is None else F.col("g") >= threshold).select("image_id", "r", "c")
    dim = rows.groupBy("image_id").agg((F.max("r") + 1).alias("h"), F.max(F.size("gray")).alias("w"))
    return ones, dim


def listed(spark: SparkSession, folder: str, pattern: str = "*.pgm") -> DataFrame:
    """(path, number) of files whose stems are numbers, by number and not by text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.withColumn("number", F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).cast("long")).orderBy("number")
