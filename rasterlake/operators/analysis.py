"""Analysis of measured runs: cohorts, curves, paired tests, strata and areas, from runs of the methods on rasters.

Runs go to reports and come back from them. A run has image, method, payload_bits, available, net and drd. Tests compare ``own`` with each other method on the images for which
both are available, by signed ranks with Holm's correction within a payload. Strata are the verdicts of the gray rasters' thresholds; their denominator counts all images.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.operators import study
from rasterlake.plans import steps
from rasterlake.sources import reports
from rasterlake.stages import kept, shared_folder

OWN, OTHERS = "distance_one", ("context", "pair", "single_peak")
#: The steps name methods m0 to m3, of which m1 is the one that others are compared with.
LABELS = dict(zip((OTHERS[0], OWN, *OTHERS[1:]), ("m0", "m1", "m2", "m3"), strict=True))

SUITABLE = """SELECT image_id AS image, agreement >= 0.95 AND foreground BETWEEN 0.05 AND 0.95 AS suitable FROM (SELECT g.image_id, sum(CASE WHEN (g.g >= 128) = (g.g >= coalesce(o.threshold, g.g)) THEN g.n ELSE 0 END) / CAST(sum(g.n) AS DOUBLE) AS agreement,
    sum(CASE WHEN g.g >= 128 THEN g.n ELSE 0 END) / CAST(sum(g.n) AS DOUBLE) AS foreground FROM gray_hist g LEFT JOIN otsu o ON o.image_id = g.image_id GROUP BY g.image_id) q"""


def suitability(gray: DataFrame) -> DataFrame:
    """(image, suitable) of gray pixels (image_id, g): whether the threshold that parts the histogram best agrees with 128, and neither side is nearly empty. An image of one value isn't."""
    return steps.run(gray.sparkSession, SUITABLE, gray=gray)


def runs_of(ones: DataFrame, dim: DataFrame, payloads: tuple[int, ...]) -> DataFrame:
    """Runs of all methods with all payloads: image, method, payload_bits, available, net, drd, changed, error. Payload and method are keys, so all payloads are one study."""
    sizes = kept(study.spread(dim, "bits", payloads), "spread-dim")
    every = kept(study.spread(ones, "bits", payloads).drop("bits"), "spread-ones")
    rows = study.method_runs(every, sizes.drop("bits"), sizes.select("image_id", F.col("bits").cast("long").alias("bits")))
    return rows.select(
        F.substring_index("image_id", "#", -1).alias("image"), "method", F.col("payload_bits").cast("int").alias("payload_bits"), "available", F.col("net_payload_bits").alias("net"), "drd", F.col("changed_pixels").alias("changed"), "error",
    )


def through_reports(runs: DataFrame, folder: str) -> DataFrame:
    """The runs as they come back from reports in ``folder``."""
    summaries = runs.groupBy("payload_bits", "method").agg(F.count(F.lit(1)).alias("images"), F.avg(F.col("available").cast("double")).alias("available_fraction"), F.avg("net").alias("mean_net"))
    reports.write_reports(runs, summaries, folder)
    back = reports.read_reports(runs.sparkSession, folder)
    missing = [c for c in runs.columns if c not in back.columns]  # a column of nulls only isn't written
    return back.select(*(F.col(c).cast(runs.schema[c].dataType) if c not in missing else F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in runs.columns))


def analyze(runs: DataFrame, suitable: DataFrame) -> DataFrame:
    """Long rows (part, payload_bits, method, item, value): parts curve, test, stratum and area."""
    from rasterlake.registry import SELECTS

    spark = runs.sparkSession
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    name = F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (v, k)))
    own = kept(runs.where(F.col("method").isin(*LABELS)).select("image", label[F.col("method")].alias("method"), "payload_bits", "available", "net", "drd", "changed"), "runs")

    def long(part: str, df: DataFrame, method: str, values: dict[str, str], item=None) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("item"), F.col(c).cast("double").alias("value")) for k, c in values.items())))
        bits = F.col("payload_bits") if "payload_bits" in df.columns else F.lit(None).cast("int")
        rows = df.select(bits.alias("payload_bits"), name[F.col(method)].alias("method"), (item if item is not None else F.lit("")).alias("of"), pairs.alias("p"))
        return rows.select(F.lit(part).alias("part"), "payload_bits", "method", F.concat_ws(" ", F.when(F.col("of") != "", F.col("of")), "p.item").alias("item"), "p.value")

    curves = kept(steps.run(spark, SELECTS["matched_curves"][1], runs=own), "curves")
    out = long("curve", curves, "method", {"matched images": "n", "mean net": "mean_net", "median net": "median_net", "median drd": "median_drd"})
    deltas = kept(steps.run(spark, "SELECT * FROM deltas", runs=own), "deltas")
    tests = steps.run(spark, SELECTS["paired_deltas"][1], deltas=deltas).join(steps.run(spark, SELECTS["holm_adjust"][1], deltas=deltas), ["payload_bits", "competitor", "metric"])
    out = out.union(long("test", tests, "competitor", {"pairs": "n", "median": "median_delta", "wins": "wins", "ties": "ties", "p": "p", "adjusted p": "adjusted"}, F.col("metric")))
    # The denominator counts images, whether or not a method has a run for them.
    images = runs.select("image").distinct().join(suitable, "image").groupBy("suitable").agg(F.count(F.lit(1)).alias("denominator"))
    strata = own.where("available").join(suitable, "image").groupBy("payload_bits", "method", "suitable").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean_net"), F.median("drd").alias("median_drd")).join(images, "suitable")
    stratum = F.when(F.col("suitable"), "suitable").otherwise("unsuitable")
    out = out.union(long("stratum", strata, "method", {"images": "n", "of": "denominator", "mean net": "mean_net", "median drd": "median_drd"}, stratum))
    order = Window.partitionBy("method").orderBy("median_drd", "payload_bits")
    points = curves.withColumns({"x": F.lag("median_drd").over(order), "y": F.lag("mean_net").over(order)}).where("x IS NOT NULL")
    areas = points.groupBy("method").agg(F.sum((F.col("median_drd") - F.col("x")) * (F.col("mean_net") + F.col("y")) / 2).alias("area"))
    return out.union(long("area", areas, "method", {"area": "area"})).withColumn("value", F.round("value", 9))


# Queries


def measured(spark: SparkSession, sf_dir: str, payloads: tuple[int, ...] = (16, 32, 64)) -> tuple[DataFrame, DataFrame]:
    """Runs that came back from reports, and the verdicts on the gray rasters that the binary ones are thresholds of."""
    shade = kept(steps.run(spark, "SELECT image_id, r, c, q FROM shade", sf_dir, "smooth"), "shade")
    dim = kept(steps.run(spark, "SELECT image_id, h, w FROM dim", sf_dir, "smooth"), "dim")
    ones = kept(shade.where("q > 0").select("image_id", "r", "c"), "ones")
    gray = shade.select("image_id", F.least(F.greatest(F.floor(128 + (F.col("q") - 1) / 64), F.lit(0)), F.lit(255)).cast("int").alias("g"))
    runs = kept(through_reports(runs_of(ones, dim, payloads), f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"), "measured")
    return runs, suitability(gray)


def q_measured_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir)[0]


def q_measured_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(*measured(spark, sf_dir))


QUERIES = {"measured_runs": q_measured_runs, "measured_analysis": q_measured_analysis}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)
