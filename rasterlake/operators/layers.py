"""Two layers of marks in one raster: bits in pattern tables first, then bits in uniform tiles of the marked raster, read back in reverse order.

The second layer's tiles are those of the raster that carries the first, since that is what its reader has once the second layer is off. Both layers' side
information is what extraction gets, besides the raster: the tables and the payload of the first, the places of the second.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions import codecs
from rasterlake.operators import marking, study
from rasterlake.plans import steps
from rasterlake.stages import kept


def first_places(places: DataFrame, share: float) -> DataFrame:
    """The first ``share`` of each image's places, in raster order."""
    most = places.groupBy("image_id").agg(F.floor(F.count(F.lit(1)) * share).alias("most"))
    return places.join(most, "image_id").where("i < most").drop("most")


def place_sizes(places: DataFrame, dim: DataFrame, threshold: float) -> DataFrame:
    """(image_id, wire_bits): the second layer's side information on the wire, read back and compared."""

    def size(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        shape, wide = (int(part["h"].iloc[0]), int(part["w"].iloc[0])), int(part["w"].iloc[0]) // 3
        spots = list(zip((part["br"] * wide + part["bc"]).tolist(), part["position"].tolist(), strict=True))
        data = codecs.encode_uniform(spots, shape, threshold)
        if codecs.decode_uniform(data)[:2] != (spots, shape):
            raise ValueError("side information doesn't come back from the wire")
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "wire_bits": [8 * len(data)]})

    return places.join(dim, "image_id").groupBy("image_id").applyInPandas(size, "image_id string, wire_bits long")


def two_layers(ones: DataFrame, dim: DataFrame, tables: DataFrame, places_of: Callable[[DataFrame, DataFrame], DataFrame], base_share: float = 0.75, share: float = 0.75) -> dict[str, DataFrame]:
    """Both layers in and out again; all stages by name.

    ``payload`` (image_id, bits) is ``base_share`` of what the tables carry; ``places`` are the first ``share`` of ``places_of(raster, dim)`` of the raster with the first layer. ``first`` and ``both``
    are the marked rasters, ``second_message`` and ``message`` what is read of each layer, ``back`` the raster put back.
    """
    payload = kept(marking.capacity(ones, dim, tables).select("image_id", F.floor(F.col("capacity") * base_share).cast("long").alias("bits")), "payload")
    base = kept(marking.embed(ones, dim, tables, payload), "base-flips")
    first = kept(marking.toggled(ones, base), "first-layer")
    every = kept(places_of(first, dim), "all-places")
    places = kept(first_places(every, share), "places")
    both = kept(marking.toggled(first, marking.uniform_flips(places)), "both-layers")
    # Out again, the last layer first.
    seen = kept(marking.read_uniform(both, dim, places), "second-found")
    off = kept(marking.toggled(both, marking.changed_pixels(seen, "pattern", "whole")), "second-off")
    found = kept(marking.read(off, dim, tables, payload), "first-found")
    return {"payload": payload, "base": base, "first": first, "every": every, "places": places, "both": both, "second_message": seen.select("image_id", "i", "bit"), "message": marking.extracted(found), "back": marking.restored(off, found)}


def rows(ones: DataFrame, dim: DataFrame, made: dict[str, DataFrame], base_wire: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A row per image: payloads of both layers and the most the second could have, side information, net bits with and without the second layer, its gain, DRD of one and of both layers, PSNR, exactness."""
    payload = made["payload"]
    # An image without tables has side information too: a head that says so.
    base_wire = dim.select("image_id").join(base_wire, "image_id", "left").select("image_id", F.coalesce("wire_bits", F.lit(steps.wire_bits(0))).alias("wire_bits"))
    second = made["places"].groupBy("image_id").agg(F.count(F.lit(1)).alias("uniform_bits"))
    most = made["every"].groupBy("image_id").agg(F.count(F.lit(1)).alias("uniform_most"))
    equal = made["second_message"].groupBy("image_id").agg(F.bool_and(F.col("bit") == marking.bit_at(F.col("i"))).alias("second_exact"))
    one = marking.evaluation(ones, dim, made["base"], made["message"], made["back"], payload, base_wire).select("image_id", F.col("payload_bits").alias("base_bits"), F.col("auxiliary_bits").alias("base_wire"), F.col("drd").alias("base_drd"), F.col("message_exact").alias("base_exact"))
    total = made["both"].select("image_id", "r", "c").unionByName(ones.select("image_id", "r", "c")).groupBy("image_id", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    flips = kept(total.where("n = 1").join(ones.withColumn("was", F.lit(1)), ["image_id", "r", "c"], "left").select("image_id", "r", "c", F.coalesce("was", F.lit(0)).alias("was")), "flips-of-both")
    all_ = marking.evaluation(ones, dim, flips, made["message"], made["back"], payload, base_wire).select("image_id", F.col("drd").alias("both_drd"), "psnr_db", "reversible")
    wire = place_sizes(made["places"], dim, threshold).withColumnRenamed("wire_bits", "uniform_wire")
    out = one.join(all_, "image_id")
    for part in (second, most, equal, wire):
        out = out.join(part, "image_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumns({c: zero(F.col(c)) for c in ("uniform_bits", "uniform_most", "uniform_wire")}).withColumn("second_exact", F.coalesce("second_exact", F.lit(True)))
    return out.withColumns({"gross_bits": F.col("base_bits") + F.col("uniform_bits"), "base_net": F.col("base_bits") - F.col("base_wire"), "uniform_net": F.col("uniform_bits") - F.col("uniform_wire"), "net_bits": F.col("base_bits") + F.col("uniform_bits") - F.col("base_wire") - F.col("uniform_wire"), "gain_percent": F.round(100 * F.col("uniform_bits") / F.greatest("base_bits", F.lit(1)), 9)})


def summary(made: DataFrame) -> DataFrame:
    """Over images: their number, means of payloads, side information, net bits, gain and DRD, the largest DRD, and whether all came back."""
    means = ("base_bits", "uniform_bits", "gross_bits", "base_wire", "uniform_wire", "net_bits", "uniform_net", "gain_percent", "base_drd", "both_drd")
    finite = F.avg(F.when(F.col("psnr_db") < float("inf"), F.col("psnr_db")))
    return made.agg(F.count(F.lit(1)).alias("images"), *(F.round(F.avg(c), 9).alias(f"mean_{c}") for c in means), F.round(finite, 9).alias("mean_psnr_db"), F.max("both_drd").alias("max_both_drd"), F.bool_and(F.col("reversible") & F.col("base_exact") & F.col("second_exact")).alias("all_exact"))


# Queries


def layered(spark: SparkSession, sf_dir: str, fixture: str = "smooth") -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    ones, dim = study.raster(spark, sf_dir, fixture)
    hist = kept(steps.run(spark, "SELECT image_id, pat, n FROM hist", ones=ones, dim=dim), "hist")
    tables = steps.run(spark, "SELECT image_id, peak, zero AS pattern FROM h1map", hist=hist, dim=dim)
    tables = kept(tables.select("image_id", "peak", F.posexplode(F.array("peak", "pattern")).alias("symbol", "pattern")), "tables")
    return ones, dim, tables, two_layers(ones, dim, tables, study.uniform_places)


def q_two_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back: bits and checksum of the first layer's message, whether the second layer had bits and all were right, the raster's pixels and checksum."""
    _, _, _, made = layered(spark, sf_dir)
    second = made["second_message"].groupBy("image_id").agg(F.bool_and(F.col("bit") == marking.bit_at(F.col("i"))).alias("second_exact"))
    back = study.digest(made["payload"], made["message"], made["back"])
    return back.join(second, "image_id", "left").select("image_id", "bits", "message", F.coalesce("second_exact", F.lit(False)).alias("second_exact"), "ones", "checksum")


def q_two_layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ones, dim, tables, made = layered(spark, sf_dir)
    return rows(ones, dim, made, study.wire_sizes("distance_one", tables, made["payload"], dim))


def q_two_layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(q_two_layer_rows(spark, sf_dir))


QUERIES = {"two_layers": q_two_layers, "two_layer_rows": q_two_layer_rows, "two_layer_summary": q_two_layer_summary}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Three quarters of the occurrences of peaks with tables carry the first message; what comes back is the raster itself. No embedding happens in this SQL."""
    payload = "SELECT d.image_id, CAST(floor(coalesce(m.n, 0) * 0.75) AS BIGINT) AS bits FROM dim d LEFT JOIN (SELECT image_id, sum(n) AS n FROM h1map GROUP BY image_id) m ON m.image_id = d.image_id"
    return {"two_layers": steps.sql(f"""SELECT p.image_id, p.bits, CAST(coalesce(m.s, 0) AS BIGINT) AS message, true AS second_exact, CAST(coalesce(o.n, 0) AS BIGINT) AS ones, CAST(coalesce(o.s, 0) AS BIGINT) AS checksum FROM ({payload}) p
        LEFT JOIN (SELECT q.image_id, sum(({steps.BIT.format(i='i')}) * (i % 97 + 1)) AS s FROM ({payload}) q EACH(CAST(q.bits AS INT), i) GROUP BY q.image_id) m ON m.image_id = p.image_id
        LEFT JOIN (SELECT image_id, count(*) AS n, sum(r * 7 + c) AS s FROM ones GROUP BY image_id) o ON o.image_id = p.image_id""", "smooth", "other")}
