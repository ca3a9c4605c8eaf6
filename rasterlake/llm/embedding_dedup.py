"""Operator 4, embedding near-dedup: spherical k-means cells, exact links of cosine ``threshold`` or more.

Equal vectors of a label are first folded into one, with their number and smallest id. Each label's vectors of one length
are assigned to the nearest of its unit centroids (spherical k-means, fitted on a bounded
sample; of 2, 4, 8 and more cells the number is taken that asks for the fewest products on the sample). A link can cross from cell i to cell j only if
its vectors lie within ``reach`` = sqrt(2 - 2 threshold) of each other, so a vector of cell i is copied
to cell j when its distance to the plane between the two centroids, (x.ci - x.cj) / |ci - cj|, is at
most ``reach``: no link is lost, whatever the centroids are. Vectors without clusters, such as random ones of many
parts, lie near all planes: two cells are then made, and nearly all vectors are copied. Cells are split into blocks of rows;
products are taken between blocks of one cell in double precision, each pair once, in the home cell
of its larger id. A pair of blocks returns a row for each vector that has links in it: the links' number and one vector that it reaches.

Vectors that are null, zero, or with null or non-finite parts, and those without a label, link with nothing; vectors of different lengths
don't link. Repeated rows (the same id again) are one
vector for linking and give a result each. No rows give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import components, written


def _folded(vectors: DataFrame) -> DataFrame:
    """Valid vectors by label and value: v, its smallest id and the number of ids."""
    v = F.col("v")
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = vectors.where(F.col("v").isNotNull()).where(good)
    return valid.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("n"))


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means on unit rows."""
    start = np.random.default_rng(seed).permutation(len(sample))[:k]
    c = sample[np.sort(start)].copy()
    for _ in range(rounds):
        home = (sample @ c.T).argmax(1)
        for i in range(len(c)):
            if (part := sample[home == i]).size and (size := np.linalg.norm(total := part.sum(0))) > 0:
                c[i] = total / size
    return c


def copied(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit row, and the cells (rows x cells) that it goes to."""
    dots = x @ c.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[home]
    near = dots[np.arange(len(x)), home][:, None] - dots <= reach * apart + 1e-9
    near[np.arange(len(x)), home] = True
    return home, near


def best_cells(x: np.ndarray, total: int, cell_rows: int, reach: float) -> np.ndarray:
    """Centroids whose cells ask for the fewest products among the sampled rows."""
    best, least, k = x[:1], np.inf, 2
    while k <= max(2, min(total // cell_rows, len(x) // 8)) and k <= len(x):
        c = centroids(x, k)
        work = float((copied(x, c, reach)[1].sum(0).astype(float) ** 2).sum())
        if work < least:
            best, least = c, work
        k *= 2
    return best


def reached_in(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest place that each of ``size`` places reaches by links i - j."""
    low = np.arange(size)
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        low = low[low]
        if (low == before).all():
            return low


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 64, block_rows: int = 1000, sample_rows: int = 4000, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Fixed bounds: ``sample_rows`` vectors a label train its centroids, whose cells hold ``cell_rows`` home vectors or more;
    ``block_rows`` bounds what a task multiplies at once.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("int").alias("label"))
    distinct = written(_folded(rows).withColumn("width", F.size("v")), "vectors")
    group = ["label", "width"]
    sizes = distinct.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), float)
        x /= np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        c = best_cells(unit(part.sort_values("vec_id")["v"]), int(part["rows"].iloc[0]), cell_rows, reach)
        return pd.DataFrame({"label": part["label"].iloc[0], "width": part["width"].iloc[0], "cell": range(len(c)), "c": list(c)})

    hashed = distinct.join(sizes, group).withColumn("h", F.xxhash64("vec_id"))
    sampled = hashed.where(F.pmod("h", F.lit(1_000_000)) < 2_000_000.0 * sample_rows / F.col("rows"))
    sampled = sampled.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("h", "vec_id"))).where(F.col("r") <= sample_rows)
    learned = written(sampled.select(*group, "rows", "vec_id", "v").groupBy(group).applyInPandas(learn, "label int, width int, cell int, c array<double>"), "centroids")
    # A label's centroids go once to each chunk of its rows.
    chunks = sizes.withColumn("chunks", F.ceil(F.col("rows") / (8 * block_rows)).cast("int")).drop("rows")
    dealt = distinct.join(chunks, group).select(*group, F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "n", "v", F.lit(None).cast("int").alias("cell"))
    centres = learned.join(chunks, group).select(*group, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("n"), F.col("c").alias("v"), "cell")

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        centre = part["cell"].notna()
        part, c = part[~centre], np.array(part[centre].sort_values("cell")["v"].tolist(), float)
        x = unit(part["v"])
        home, near = copied(x, c, reach)
        at, cell = np.nonzero(near)
        return pd.DataFrame({"label": part["label"].iloc[0], "width": part["width"].iloc[0], "cell": cell.astype(np.int32), "at_home": cell == home[at], "vec_id": part["vec_id"].to_numpy(np.int64)[at], "n": part["n"].to_numpy(np.int64)[at], "x": [v.tobytes() for v in x[at]]})

    placed = written(dealt.union(centres).groupBy(*group, "chunk").applyInPandas(assign, "label int, width int, cell int, at_home boolean, vec_id long, n long, x binary"), "placed")
    # Each cell's rows are dealt to blocks by id; a block pair (p <= q) is one task's work, and a row goes to each pair of its block.
    cell = [*group, "cell"]
    blocks = placed.groupBy(cell).agg(F.count(F.lit(1)).alias("rows")).select(*cell, F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"))
    parted = placed.join(blocks, cell).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    paired = parted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*cell, F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), (F.col("b") <= F.col("o")).alias("first"), (F.col("b") >= F.col("o")).alias("second"), "at_home", "vec_id", "n", "x")

    def products(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        ids, n = part["vec_id"].to_numpy(), part["n"].to_numpy()
        home, first, second = (part[c].to_numpy(zero_copy_only=False) for c in ("at_home", "first", "second"))
        x = np.frombuffer(b"".join(part["x"].to_pylist()), "<f8").reshape(len(ids), -1)
        one, two = np.flatnonzero(first), np.flatnonzero(second)
        i, j = np.nonzero(x[one] @ x[two].T >= threshold)
        i, j = one[i], two[j]
        if len(one) == len(ids) == len(two):  # a block with itself: each pair comes twice
            use = i < j
            i, j = i[use], j[use]
        use = home[np.maximum(i, j)]
        i, j = i[use], j[use]
        others = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        low, at = reached_in(i, j, len(ids)), np.flatnonzero(others)
        return pa.table({"a": ids[at], "b": ids[low[at]], "others": others[at].astype(np.int64)})

    links = written(paired.groupBy(*cell, "p", "q").applyInArrow(products, "a long, b long, others long"), "links")
    degree = links.groupBy(F.col("a").alias("head")).agg(F.sum("others").alias("others"))
    reached = components(links.select("a", "b")).select(F.col("node").alias("head"), "component")
    heads = distinct.select("label", "v", F.col("vec_id").alias("head"), "n").join(degree, "head", "left").join(reached, "head", "left")
    found = rows.join(heads, ["label", "v"], "left")
    component = F.coalesce("component", "head", "vec_id")
    return found.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
