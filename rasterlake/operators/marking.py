"""Embedding and extraction on rasters: a marked raster is made, and only it, the side information and the payload's length are read back.

Rasters are ``ones`` (image_id, r, c) and ``dim`` (image_id, h, w). Pattern tables (image_id, peak, symbol, pattern) say which 3x3 pattern stands for
which bits of a block that had ``peak`` (symbol 0: the peak itself); the distance-one, the single-peak and the adaptive method differ in their tables
only. ``payload`` (image_id, bits) is the number of bits; an image whose tables can't carry them is left unmarked by the caller (``over_capacity``).
Work is keyed by image and band of rows, so no task holds an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.plans import steps

BAND = 64


def bit_at(i: Column) -> Column:
    """The portable message: bit ``i`` of every image."""
    return (F.floor((i.cast("long") * 1103515245 + 12345) / 65536) % 2).cast("int")


def toggled(ones: DataFrame, flips: DataFrame) -> DataFrame:
    """``ones`` with the pixels of ``flips`` inverted: a pixel is set if it's named an odd number of times."""
    key = ["image_id", "r", "c"]
    return ones.select(key).unionByName(flips.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key)


def tiles(ones: DataFrame, dim: DataFrame, absent_of: DataFrame | None = None) -> DataFrame:
    """Blocks (image_id, br, bc, pat) with a pixel set, and all others of the images of ``absent_of``."""
    blocks = steps.run(ones.sparkSession, "SELECT image_id, br, bc, pat FROM blocks", ones=ones, dim=dim)
    if absent_of is None:
        return blocks
    rows = dim.join(absent_of.select("image_id").distinct(), "image_id", "left_semi").where("h >= 3 AND w >= 3").select("image_id", "w", F.explode(F.sequence(F.lit(0), F.floor(F.col("h") / 3).cast("int") - 1)).alias("br"))
    grid = rows.select("image_id", "br", F.explode(F.sequence(F.lit(0), F.floor(F.col("w") / 3).cast("int") - 1)).alias("bc"))
    return blocks.unionByName(grid.join(blocks, ["image_id", "br", "bc"], "left_anti").withColumn("pat", F.lit(0)))


def offsets(rows: DataFrame, size: str) -> DataFrame:
    """Places in raster order (``at``): a prefix sum over bands, then inside each band."""
    rows = rows.withColumn("band", F.floor(F.col("br") / BAND))
    bands = rows.groupBy("image_id", "band").agg(F.sum(size).alias("total"))
    bands = bands.withColumn("base", F.sum("total").over(Window.partitionBy("image_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))).drop("total")
    inside = F.sum(size).over(Window.partitionBy("image_id", "band").orderBy("br", "bc").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(bands, ["image_id", "band"]).withColumn("at", F.coalesce("base", F.lit(0)) + F.coalesce(inside, F.lit(0))).drop("band", "base")


def widths(tables: DataFrame) -> DataFrame:
    """Bits that a block of each peak takes."""
    return tables.groupBy("image_id", "peak").agg(F.log2(F.count(F.lit(1))).cast("int").alias("k"))


def capacity(ones: DataFrame, dim: DataFrame, tables: DataFrame) -> DataFrame:
    """(image_id, capacity) of every image."""
    carried = tiles(ones, dim).join(widths(tables).withColumnRenamed("peak", "pat"), ["image_id", "pat"]).groupBy("image_id").agg(F.sum("k").alias("capacity"))
    return dim.join(carried, "image_id", "left").select("image_id", F.coalesce("capacity", F.lit(0)).cast("long").alias("capacity"))


def over_capacity(ones: DataFrame, dim: DataFrame, tables: DataFrame, payload: DataFrame) -> DataFrame:
    """(image_id, bits, capacity, error): null where the payload fits."""
    rows = payload.join(capacity(ones, dim, tables), "image_id")
    return rows.withColumn("error", F.when(F.col("bits") > F.col("capacity"), F.concat(F.lit("payload has "), "bits", F.lit(" bits, tables carry "), "capacity")))


def changed_pixels(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Pixels in which two patterns of a block differ: (image_id, r, c, was), ``was`` by the first pattern."""
    each = rows.where(F.col(one) != F.col(other)).select("image_id", "br", "bc", one, other, F.explode(F.sequence(F.lit(0), F.lit(8))).alias("b"))
    bit = lambda name: F.getbit(F.col(name), 8 - F.col("b"))
    return each.where(bit(one) != bit(other)).select("image_id", (F.col("br") * 3 + F.floor(F.col("b") / 3)).cast("int").alias("r"), (F.col("bc") * 3 + F.col("b") % 3).cast("int").alias("c"), bit(one).cast("int").alias("was"))


def started(payload: DataFrame) -> DataFrame:
    """``payload`` with ``first``, the place in the portable message at which an image's bits begin: 0 unless given."""
    return payload if "first" in payload.columns else payload.withColumn("first", F.lit(0).cast("long"))


def embed(ones: DataFrame, dim: DataFrame, tables: DataFrame, payload: DataFrame) -> DataFrame:
    """Pixels that embedding inverts (image_id, r, c, was). Blocks in raster order take the next bits, the last one zeros behind the payload; images over capacity take none."""
    fits = over_capacity(ones, dim, tables, started(payload)).where("error IS NULL").select("image_id", "bits", "first")
    carriers = tiles(ones, dim).join(widths(tables).withColumnRenamed("peak", "pat"), ["image_id", "pat"]).join(fits, "image_id")
    placed = offsets(carriers, "k").where("at < bits")
    symbol = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(0), lambda acc, j: acc * 2 + F.when(F.col("at") + j < F.col("bits"), bit_at(F.col("first") + F.col("at") + j)).otherwise(0))
    chosen = placed.withColumn("symbol", symbol).withColumnRenamed("pat", "peak").join(tables.select("image_id", "peak", "symbol", "pattern"), ["image_id", "peak", "symbol"])
    return changed_pixels(chosen, "peak", "pattern")


def inverted(tables: DataFrame) -> DataFrame:
    """(image_id, pat, peak, symbol): what each pattern of an image stands for; an error if it stands for two things."""
    only = tables.groupBy("image_id", F.col("pattern").alias("pat")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("peak", "symbol")).alias("s"))
    sure = F.when(F.col("n") == 1, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("tables aren't injective: pattern "), "pat", F.lit(" of image "), "image_id", F.lit(" stands twice"))).cast("struct<peak:int,symbol:int>"))
    return only.withColumn("s", sure).select("image_id", "pat", "s.peak", "s.symbol")


def pattern_pixels(pattern: Column) -> Column:
    """The nine pixels of a pattern, in raster order, as an array; an error outside 0 .. 511."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda b: F.getbit(pattern, 8 - b).cast("int"))
    return F.when(pattern.between(0, 511), pixels).otherwise(F.raise_error(F.concat(F.lit("not a 3x3 pattern: "), pattern)).cast("array<int>"))


def complete(message: DataFrame, payload: DataFrame) -> DataFrame:
    """``message`` (image_id, i, bit) as one row per image of ``payload``: image_id and its bits in order; an error where bits are missing or too many. Up to some thousand bits an image."""
    said = message.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "bit"))).alias("m"))
    rows = payload.join(said, "image_id", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<i:bigint,bit:int>>")))
    short = F.raise_error(F.concat(F.lit("image "), "image_id", F.lit(" gave "), F.size("m"), F.lit(" bits of "), "bits"))
    return rows.select("image_id", F.when(F.size("m") == F.col("bits"), F.transform("m", lambda x: x["bit"])).otherwise(short.cast("array<int>")).alias("message"))


def same_shape(one: DataFrame, other: DataFrame) -> DataFrame:
    """``one`` (image_id, h, w), checked against the shapes that side information names: an error where they differ; images that ``other`` doesn't have stay as they are."""
    rows = one.join(other.select("image_id", F.col("h").alias("h2"), F.col("w").alias("w2")), "image_id", "left")
    wrong = F.raise_error(F.concat(F.lit("image "), "image_id", F.lit(" has another shape than its side information"))).cast("int")
    fits = F.col("h2").isNull() | ((F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2")))
    return rows.select("image_id", F.when(fits, F.col("h")).otherwise(wrong).alias("h"), "w")


def read(stego: DataFrame, dim: DataFrame, tables: DataFrame, payload: DataFrame) -> DataFrame:
    """Blocks of the marked raster that carry the payload: (image_id, br, bc, pattern, peak, symbol, k, at, bits). Reads no other pixels than ``stego``; tables in which a pattern stands twice are an error."""
    inverse = inverted(tables).join(widths(tables), ["image_id", "peak"])
    marked = tiles(stego, dim, tables.where("pattern = 0")).join(inverse, ["image_id", "pat"]).join(payload, "image_id")
    return offsets(marked, "k").where("at < bits").withColumnRenamed("pat", "pattern")


def extracted(found: DataFrame) -> DataFrame:
    """(image_id, i, bit) of blocks as ``read`` returns them."""
    each = found.select("image_id", "symbol", "k", "at", "bits", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).withColumn("i", F.col("at") + F.col("j")).where("i < bits")
    return each.select("image_id", "i", F.getbit(F.col("symbol"), F.col("k") - 1 - F.col("j")).cast("int").alias("bit"))


def restored(stego: DataFrame, found: DataFrame) -> DataFrame:
    """The raster before embedding."""
    return toggled(stego, changed_pixels(found, "pattern", "peak"))


# The opposite pair of neighbourhood levels: centres in raster order are overwritten, their values go to the side information


def best_pairs(scores: DataFrame, payload: DataFrame) -> DataFrame:
    """(image_id, bits, first_level): the best pair that has ``bits`` centres; images without such a pair don't appear."""
    able = scores.join(payload, "image_id").where("score IS NOT NULL AND capacity >= bits")
    return able.groupBy("image_id", "bits").agg(F.max_by("first_level", F.struct(F.round("score", 9), -F.col("first_level"))).alias("first_level"))


def pair_centres(level_px: DataFrame, scores: DataFrame, payload: DataFrame) -> DataFrame:
    """(image_id, r, c, i, original): the first ``bits`` centres of the best pair that has as many; images without such a pair don't appear."""
    best = best_pairs(scores, payload)
    mine = level_px.join(best, "image_id").where("lvl = first_level OR lvl = 26 - first_level").withColumn("one", F.lit(1)).withColumns({"br": F.col("r"), "bc": F.col("c")})
    return offsets(mine, "one").where("at < bits").select("image_id", "r", "c", F.col("at").alias("i"), F.col("v").alias("original"))


def overwrite(centres: DataFrame) -> DataFrame:
    """Pixels that change when the centres take their bits."""
    return centres.where(F.col("original") != bit_at(F.col("i"))).select("image_id", "r", "c", F.col("original").cast("int").alias("was"))


def read_centres(stego: DataFrame, centres: DataFrame) -> DataFrame:
    """(image_id, r, c, i, original, bit): what the marked raster has at the centres."""
    return centres.join(stego.withColumn("bit", F.lit(1)), ["image_id", "r", "c"], "left").withColumn("bit", F.coalesce("bit", F.lit(0)))


def put_back(stego: DataFrame, found: DataFrame) -> DataFrame:
    return toggled(stego, found.where("bit <> original"))


# Uniform tiles: the i-th takes its bit in one pixel; the majority of a tile says what it was


def uniform_flips(places: DataFrame) -> DataFrame:
    """Pixels that change for ``places`` (image_id, br, bc, position, was, i)."""
    spot = places.where(bit_at(F.col("i")) == 1)
    return spot.select("image_id", (F.col("br") * 3 + F.floor(F.col("position") / 3)).cast("int").alias("r"), (F.col("bc") * 3 + F.col("position") % 3).cast("int").alias("c"), "was")


def read_uniform(stego: DataFrame, dim: DataFrame, places: DataFrame) -> DataFrame:
    """(image_id, br, bc, i, pattern, whole, bit) of the tiles at ``places`` (image_id, br, bc, position, i) in the marked raster: ``whole`` is the tile that was there."""
    blocks = tiles(stego, dim).withColumnRenamed("pat", "pattern")
    found = places.select("image_id", "br", "bc", "position", "i").join(blocks, ["image_id", "br", "bc"], "left").withColumn("pattern", F.coalesce("pattern", F.lit(0)))
    whole = F.when(F.bit_count("pattern") >= 5, 511).otherwise(0)
    return found.withColumn("whole", whole).withColumn("bit", (F.getbit("pattern", 8 - F.col("position")) != F.getbit("whole", 8 - F.col("position"))).cast("int"))


# What a study asks of a run


def evaluation(ones: DataFrame, dim: DataFrame, flips: DataFrame, message: DataFrame, back: DataFrame, payload: DataFrame, wire_bits: DataFrame) -> DataFrame:
    """A row for each image of ``payload``: payload_bits, auxiliary_bits, net_payload_bits, changed_pixels, psnr_db, drd, message_exact, reversible.

    ``message`` (image_id, i, bit) was read and ``back`` (image_id, r, c) restored from the marked raster; ``wire_bits`` (image_id, wire_bits) is the side information's size.
    """
    spark = ones.sparkSession
    drd = steps.run(spark, "SELECT d.image_id, coalesce(f.cost, 0.0) / greatest(coalesce(m.n, 0), 1) AS drd FROM dim d LEFT JOIN (SELECT image_id, sum(cost) AS cost FROM flip_costs GROUP BY image_id) f ON f.image_id = d.image_id LEFT JOIN mixed8 m ON m.image_id = d.image_id", ones=ones, dim=dim, flips=flips)
    changed = flips.groupBy("image_id").agg(F.count(F.lit(1)).alias("changed"))
    said = message.join(started(payload).select("image_id", "first"), "image_id")
    equal = said.groupBy("image_id").agg(F.count(F.lit(1)).alias("read"), F.sum((F.col("bit") == bit_at(F.col("first") + F.col("i"))).cast("long")).alias("equal"))
    apart = toggled(ones, back).groupBy("image_id").agg(F.count(F.lit(1)).alias("apart"))
    rows = payload.join(dim, "image_id").join(wire_bits, "image_id").join(drd, "image_id")
    for part in (changed, equal, apart):
        rows = rows.join(part, "image_id", "left")
    n = F.coalesce("changed", F.lit(0))
    return rows.select(
        "image_id", F.col("bits").cast("long").alias("payload_bits"), F.col("wire_bits").cast("long").alias("auxiliary_bits"), (F.col("bits") - F.col("wire_bits")).cast("long").alias("net_payload_bits"), n.cast("long").alias("changed_pixels"),
        F.when(n == 0, float("inf")).otherwise(F.round(10 * F.log10(F.col("h").cast("double") * F.col("w") / n), 9)).alias("psnr_db"), F.round("drd", 9).alias("drd"),
        (F.coalesce("equal", F.lit(0)) == F.col("bits")).alias("message_exact"), (F.coalesce("apart", F.lit(0)) == 0).alias("reversible"),
    )


def unavailable(payload: DataFrame, reason: str) -> DataFrame:
    """Rows of images for which a method has no run, with the same columns as ``evaluation``."""
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return payload.select("image_id", F.col("bits").cast("long").alias("payload_bits"), *(empty("long", c) for c in ("auxiliary_bits", "net_payload_bits", "changed_pixels")), empty("double", "psnr_db"), empty("double", "drd"), empty("boolean", "message_exact"), empty("boolean", "reversible"), F.lit(reason).alias("error"))
