"""Result facts: JSON reports in, CSV and JSON out, and rasters back to files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each image of multi-line JSON reports, with the report's payload, by payload."""
    reports = spark.read.option("multiLine", True).json(paths)
    return reports.select("payload_bits", F.explode("images").alias("row")).select("payload_bits", "row.*").orderBy("payload_bits")


def write_reports(rows: DataFrame, summaries: DataFrame, folder: str, images_per_report: int = 10_000) -> None:
    """Reports as ``read_reports`` takes them: payload_bits, the summaries of that payload and the rows of its images, ``images_per_report`` images in a file at most on average.

    ``rows`` has payload_bits and an image column, ``summaries`` payload_bits and a few rows for each.
    """
    sizes = rows.groupBy("payload_bits").agg(F.ceil(F.approx_count_distinct("image") / images_per_report).alias("parts"))
    dealt = rows.join(sizes, "payload_bits").withColumn("part", F.pmod(F.xxhash64("image"), F.col("parts")))
    images = dealt.groupBy("payload_bits", "part").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "payload_bits"))).alias("images"))
    nested = summaries.groupBy("payload_bits").agg(F.collect_list(F.struct(*(c for c in summaries.columns if c != "payload_bits"))).alias("summaries"))
    reports = images.join(nested, "payload_bits", "left").withColumn("payload", F.col("payload_bits")).select("payload", "part", "payload_bits", "summaries", "images")
    reports.write.partitionBy("payload", "part").json(folder)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_pgm(ones: DataFrame, dim: DataFrame, folder: str) -> DataFrame:
    """Write each raster as <image_id>.pgm (0 and 255) to ``folder``, any address that pyarrow opens; (image_id, bytes)."""

    def save(part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        h, w, name = int(part["h"].iloc[0]), int(part["w"].iloc[0]), part["image_id"].iloc[0]
        image = np.zeros((h, w), np.uint8)
        seen = part.dropna(subset=["r"])
        image[seen["r"].astype(int), seen["c"].astype(int)] = 255
        data = f"P5\n{w} {h}\n255\n".encode() + image.tobytes()
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}.pgm") as f:
            f.write(data)
        return pd.DataFrame({"image_id": [name], "bytes": [len(data)]})

    return dim.join(ones, "image_id", "left").groupBy("image_id").applyInPandas(save, "image_id string, bytes long")


def message_rows(spark: SparkSession, bits: int, images: DataFrame, seed: int) -> DataFrame:
    """(image_id, i, bit): NumPy's generator, seeded with ``seed`` and the image's number, run where its image is."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, number in zip(batch["image_id"], batch["number"], strict=True):
                yield pd.DataFrame({"image_id": image, "i": np.arange(bits), "bit": np.random.default_rng(seed + number).integers(0, 2, bits).astype(np.int8)})

    return images.select("image_id", "number").mapInPandas(draw, "image_id string, i long, bit byte")
