"""Learned placement: tensors of candidate patterns, a convolutional cost model trained over partitions, and tables that take candidates in order of cost.

A candidate (image_id, peak, candidate) is an absent pattern that may stand for a peak. Its tensor has three planes of 9x9: the peak and the candidate in
the middle of zeros, and the mean surroundings of the peak's occurrences. Its target is the mean distortion of the replacement.

The model is two 3x3 convolutions (16 and 32 planes), means over 3x3 cells, a hidden layer of 64 and a softplus, 23,649 weights in one vector. Training
is data-parallel with averaged weights: rows are dealt to shards by a hash of their key, each shard runs an epoch of mini-batch steps (smooth L1, AdamW) from the
common weights, and the shards' weights and moments, weighted by rows, are averaged in two levels before a few vectors reach the driver, which deals out the next epoch. Folds are a
key beside the shard, so the models of all folds are trained side by side in the same tasks. Results depend on
``shards``, ``seed`` and the rows, not on the cluster. Tensors are single precision; gradients have the tensors' precision, weights are doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.operators import marking
from rasterlake.plans import steps
from rasterlake.stages import kept

SIDE = 9
#: Weight arrays: two convolutions (planes out, planes in, 3, 3), a hidden layer and an output.
SHAPES = ((16, 3, 3, 3), (16,), (32, 16, 3, 3), (32,), (64, 288), (64,), (1, 64), (1,))
SIZES = [int(np.prod(s)) for s in SHAPES]
WEIGHTS = sum(SIZES)


# Tensors


def edges(spark, within: int, most: int | None = None, **relations: DataFrame) -> DataFrame:
    """(image_id, peak, candidate, dist): absent patterns within a distance of each peak, the first ``most`` by distance and pattern of peaks that have two or more; all of them without ``most``."""
    if most is not None:
        return steps.run(spark, "SELECT image_id, peak, zero AS candidate, dist FROM candidates", **relations)
    return steps.run(spark, f"SELECT p.image_id, p.pat AS peak, z.pat AS candidate, bit_count(XOR(p.pat, z.pat)) AS dist FROM peaks p JOIN zeros z ON z.image_id = p.image_id WHERE bit_count(XOR(p.pat, z.pat)) <= {within}", **relations)


def plane(pattern):
    """A 3x3 pattern in the middle of a 9x9 plane of zeros, as an array of 81 numbers."""
    middle = lambda i: (F.floor(i / SIDE).between(3, 5)) & ((i % SIDE).between(3, 5))
    bit = lambda i: F.getbit(pattern, (8 - 3 * (F.floor(i / SIDE) - 3) - (i % SIDE - 3)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.when(middle(i), bit(i)).otherwise(0).cast("float"))


def surroundings(spark, **relations: DataFrame) -> DataFrame:
    """(image_id, peak, context): the mean 9x9 surroundings of each peak's occurrences, as 81 numbers."""
    rows = steps.run(spark, "SELECT image_id, peak, i, mean FROM peak_context", **relations)
    return rows.groupBy("image_id", "peak").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"].cast("float")).alias("context"))


def tensors(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """``rows`` (image_id, peak, candidate, ...) with ``tensor``, 243 numbers."""
    return rows.join(contexts, ["image_id", "peak"]).withColumn("tensor", F.concat(plane(F.col("peak")), plane(F.col("candidate")), F.col("context"))).drop("context")


# The model


def unpacked(weights: np.ndarray) -> list[np.ndarray]:
    return [part.reshape(shape) for part, shape in zip(np.split(weights, np.cumsum(SIZES)[:-1]), SHAPES, strict=True)]


def first_weights(seed: int) -> np.ndarray:
    """Uniform within one over the root of the number of inputs, for weights and biases alike."""
    rng, out = np.random.default_rng(seed), []
    for k, shape in enumerate(SHAPES):
        inputs = np.prod(SHAPES[k - k % 2][1:])
        out.append(rng.uniform(-1, 1, int(np.prod(shape))) / np.sqrt(inputs))
    return np.concatenate(out)


def _windows(x: np.ndarray) -> np.ndarray:
    """The 3x3 surroundings of every pixel, zeros outside: (rows, 81, planes * 9)."""
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    w = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), (2, 3))
    return w.transpose(0, 2, 3, 1, 4, 5).reshape(len(x), SIDE * SIDE, -1)


def _unwindows(g: np.ndarray, planes: int) -> np.ndarray:
    """The adjoint of ``_windows``."""
    g = g.reshape(len(g), SIDE, SIDE, planes, 3, 3)
    out = np.zeros((len(g), planes, SIDE + 2, SIDE + 2), g.dtype)
    for i in range(3):
        for j in range(3):
            out[:, :, i : i + SIDE, j : j + SIDE] += g[:, :, :, :, i, j].transpose(0, 3, 1, 2)
    return out[:, :, 1:-1, 1:-1]


def forward(weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Costs of tensors (rows, 3, 9, 9), and what ``gradient`` needs."""
    k1, b1, k2, b2, h, c, o, d = unpacked(weights.astype(x.dtype))
    w1 = _windows(x)
    a1 = np.maximum(w1 @ k1.reshape(16, -1).T + b1, 0)
    w2 = _windows(a1.transpose(0, 2, 1).reshape(-1, 16, SIDE, SIDE))
    a2 = np.maximum(w2 @ k2.reshape(32, -1).T + b2, 0)
    cells = a2.reshape(-1, 3, 3, 3, 3, 32).mean((2, 4)).transpose(0, 3, 1, 2).reshape(len(x), 288)
    a3 = np.maximum(cells @ h.T + c, 0)
    z = (a3 @ o.T + d)[:, 0]
    return np.logaddexp(z.dtype.type(0), z), (w1, a1, w2, a2, cells, a3, z)


def gradient(weights: np.ndarray, x: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean smooth L1 loss over the rows and its gradient."""
    k1, _, k2, _, h, _, o, _ = unpacked(weights.astype(x.dtype))
    y, (w1, a1, w2, a2, cells, a3, z) = forward(weights, x)
    apart = y - target.astype(x.dtype)
    loss = np.where(np.abs(apart) < 1, apart**2 / 2, np.abs(apart) - 0.5).mean()
    gz = np.clip(apart, -1, 1) / len(x) / (1 + np.exp(-z))
    g3 = gz[:, None] * o * (a3 > 0)
    gc = (g3 @ h).reshape(-1, 32, 3, 3)
    g2 = np.repeat(np.repeat(gc, 3, 2), 3, 3).transpose(0, 2, 3, 1).reshape(-1, SIDE * SIDE, 32) / 9 * (a2 > 0)
    g1 = _unwindows(g2 @ k2.reshape(32, -1), 16).reshape(-1, 16, SIDE * SIDE).transpose(0, 2, 1) * (a1 > 0)
    parts = (np.tensordot(g1, w1, ((0, 1), (0, 1))), g1.sum((0, 1)), np.tensordot(g2, w2, ((0, 1), (0, 1))), g2.sum((0, 1)), g3.T @ cells, g3.sum(0), gz[None, :] @ a3, gz.sum(keepdims=True))
    return float(loss), np.concatenate([p.ravel() for p in parts]).astype(float)


def epoch(state: np.ndarray, step: int, x: np.ndarray, target: np.ndarray, batch: int, rate: float, rng: np.random.Generator, decay: float = 0.01) -> tuple[np.ndarray, int]:
    """Weights and both moments (3, WEIGHTS) after one pass in random order, by AdamW, and the number of steps."""
    w, m, v = state.copy()
    order = rng.permutation(len(x))
    for at in range(0, len(x), batch):
        use, step = order[at : at + batch], step + 1
        g = gradient(w, x[use], target[use])[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w *= 1 - rate * decay
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return np.stack([w, m, v]), step


def train(rows: DataFrame, folds: int = 1, epochs: int = 10, batch: int = 32, rate: float = 5e-3, shards: int = 4, shard_rows: int = 50_000, seed: int = 20260607) -> list[np.ndarray]:
    """The weights of each fold's model. ``rows``: (fold, image_id, peak, candidate, target, tensor); a row with fold k trains model k.

    The number of shards follows the rows beyond ``shards * shard_rows``, so a task holds a bounded number of them.
    """
    n = rows.count()
    shards = max(shards, -(-n // max(1, shard_rows)))
    dealt = kept(rows.select("fold", F.pmod(F.xxhash64("image_id", "peak", "candidate"), F.lit(shards)).cast("int").alias("shard"), "image_id", "peak", "candidate", F.col("target").cast("double").alias("target"), "tensor"), "training-rows")
    states = [np.stack([first_weights(seed + k), np.zeros(WEIGHTS), np.zeros(WEIGHTS)]) for k in range(folds)]
    taken = [0] * folds

    def added(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w.as_py()) for w in part["sums"])
        return pa.table({"fold": part["fold"].combine_chunks()[:1], "n": pa.array([sum(part["n"].to_pylist())], pa.int64()), "step": pa.array([max(part["step"].to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    def pass_over(number: int, now) -> Callable[[pa.Table], pa.Table]:
        def one(part: pa.Table) -> pa.Table:
            part = part.sort_by([("image_id", "ascending"), ("peak", "ascending"), ("candidate", "ascending")])
            fold, shard = part["fold"][0].as_py(), part["shard"][0].as_py()
            x = np.asarray(part["tensor"].combine_chunks().flatten(), np.float32).reshape(-1, 3, SIDE, SIDE)
            state, step = now.value[fold]
            made, step = epoch(state, step, x, part["target"].to_numpy(), batch, rate, np.random.default_rng([seed, number, fold, shard]))
            return pa.table({"fold": pa.array([fold], pa.int32()), "lot": pa.array([shard % 8], pa.int32()), "n": pa.array([len(x)], pa.int64()), "step": pa.array([step], pa.int64()), "sums": pa.array([(made * len(x)).tobytes()], pa.binary())})

        return one

    kinds = "n long, step long, sums binary"
    for number in range(epochs):
        now = dealt.sparkSession.sparkContext.broadcast(list(zip(states, taken, strict=True)))  # folds x 570 kB
        parts = dealt.groupBy("fold", "shard").applyInArrow(pass_over(number, now), f"fold int, lot int, {kinds}").groupBy("fold", "lot").applyInArrow(added, f"fold int, {kinds}").collect()
        for k in range(folds):
            if own := [p for p in parts if p["fold"] == k]:
                states[k] = (sum(np.frombuffer(p["sums"]) for p in own) / sum(p["n"] for p in own)).reshape(3, WEIGHTS)
                taken[k] = max(p["step"] for p in own)
        now.unpersist()
    return [s[0] for s in states]


def predicted(rows: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """``rows`` without ``tensor``, with ``cost``: the costs by the model of each row's fold, in Arrow batches."""
    others = [f for f in rows.schema.fields if f.name != "tensor"]
    stacked = rows.sparkSession.sparkContext.broadcast(np.stack(weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 1024) for k in range(0, len(whole), 1024)):
                x = np.asarray(batch.column("tensor").flatten(), np.float32).reshape(-1, 3, SIDE, SIDE)
                fold, cost = batch.column("fold").to_numpy(), np.empty(len(x))
                for k in np.unique(fold):
                    cost[fold == k] = forward(stacked.value[k], x[fold == k])[0]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(cost)], [*(f.name for f in others), "cost"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(score, f"{schema}, cost double")


def judged(scored: DataFrame) -> DataFrame:
    """Per fold: rows, mean absolute error, that of the targets' own mean, and correlation, of (fold, target, cost)."""
    middle = scored.groupBy("fold").agg(F.avg("target").alias("middle"))
    return scored.join(middle, "fold").groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("cost") - F.col("target"))).alias("mae"), F.avg(F.abs(F.col("middle") - F.col("target"))).alias("mean_mae"), F.corr("cost", "target").alias("pearson"),
    )


# Tables that take candidates in order of cost

#: Peaks in rank order each take the cheapest of their candidates that no earlier peak has, the smaller pattern of equals: a fold over 510 peaks at most.
CHEAPEST = """SELECT image_id, inline(aggregate(sort_array(collect_list(struct(rk, peak, n, zs))), named_struct('used', cast(array() AS array<int>), 'made', cast(array() AS array<struct<rk:int,peak:int,pattern:int,n:bigint>>)),
    (s, p) -> named_struct('used', concat(s.used, slice(filter(p.zs, z -> NOT array_contains(s.used, z)), 1, 1)), 'made', concat(s.made, transform(slice(filter(p.zs, z -> NOT array_contains(s.used, z)), 1, 1), z -> named_struct('rk', p.rk, 'peak', p.peak, 'pattern', z, 'n', p.n)))), s -> s.made))
    FROM (SELECT image_id, rk, peak, n, transform(sort_array(collect_list(struct(round(cost, 9) AS cost, candidate))), x -> x.candidate) AS zs FROM {scored} GROUP BY image_id, rk, peak, n) q GROUP BY image_id"""


def cheapest_tables(scored: DataFrame, hist: DataFrame, dim: DataFrame) -> DataFrame:
    """(image_id, rk, peak, pattern, n): distance-one tables by ``scored`` (image_id, peak, candidate, cost)."""
    spark = hist.sparkSession
    peaks = steps.run(spark, "SELECT image_id, pat AS peak, n, rk FROM peaks", hist=hist, dim=dim)
    return spark.sql(CHEAPEST, scored=peaks.join(scored.select("image_id", "peak", "candidate", "cost"), ["image_id", "peak"]))


def ordered_tables(counts: dict[int, int], costs: Callable[[int, np.ndarray], np.ndarray], alpha: float = 0.1) -> dict[int, list[int]]:
    """Adaptive tables whose candidates come in order of cost: those within mean + alpha * sigma of the distances of the patterns still free, cheapest first."""
    free = np.array([p for p in range(512) if not counts.get(p)], np.int64)
    made: dict[int, list[int]] = {}
    for peak in sorted((p for p, n in counts.items() if n >= 2 and 0 < p < 511), key=lambda p: (-counts[p], p)):
        if not len(free):
            break
        distance = np.bitwise_count(free ^ peak).astype(float)
        near = free[distance <= distance.mean() + alpha * distance.std()]
        near = near[np.lexsort((near, np.round(costs(peak, near), 9)))]
        taken = near[: (1 << (len(near) + 1).bit_length() - 1) - 1]
        if len(taken):
            made[peak] = [peak, *taken.tolist()]
            free = np.setdiff1d(free, taken, assume_unique=True)
    return made


def adaptive_by_model(hist: DataFrame, contexts: DataFrame, weights: np.ndarray, alpha: float = 0.1) -> DataFrame:
    """(image_id, peak, symbol, pattern, n): adaptive tables in the order of the model's costs. An image's histogram and its peaks' surroundings, 512 rows at most, are one task's."""
    rows = hist.withColumnRenamed("pat", "peak").join(contexts, ["image_id", "peak"], "left").select("image_id", "peak", "n", "context")
    shared = hist.sparkSession.sparkContext.broadcast(weights)

    def fold(part: pa.Table) -> pa.Table:
        counts = dict(zip(part["peak"].to_pylist(), part["n"].to_pylist(), strict=True))
        context = {p: np.array(c) for p, c in zip(part["peak"].to_pylist(), part["context"].to_pylist(), strict=True) if c is not None}
        made = ordered_tables(counts, lambda peak, near: forward(shared.value, tensor_array(peak, near, context[peak]))[0], alpha)
        out = [(p, k, z, counts[p]) for p, zs in made.items() for k, z in enumerate(zs)]
        names = ("peak", "symbol", "pattern", "n")
        return pa.table({"image_id": pa.array([part["image_id"][0].as_py()] * len(out), pa.string()), **{c: pa.array([x[k] for x in out], pa.int64() if c == "n" else pa.int32()) for k, c in enumerate(names)}})

    return rows.groupBy("image_id").applyInArrow(fold, "image_id string, peak int, symbol int, pattern int, n long")


def tensor_array(peak: int, candidates: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The tensors of one peak's candidates, (candidates, 3, 9, 9)."""
    out = np.zeros((len(candidates), 3, SIDE, SIDE))
    bits = lambda p: (np.asarray(p)[..., None] >> np.arange(8, -1, -1)) & 1
    out[:, 0, 3:6, 3:6], out[:, 1, 3:6, 3:6] = bits(peak).reshape(3, 3), bits(candidates).reshape(-1, 3, 3)
    out[:, 2] = context.reshape(SIDE, SIDE)
    return out


# Studies


def training_rows(ones: DataFrame, dim: DataFrame) -> DataFrame:
    """(image_id, peak, candidate, dist, target, tensor) of all images, written."""
    spark = ones.sparkSession
    targets = steps.run(spark, "SELECT image_id, peak, candidate, dist, target FROM ranker_rows", ones=ones, dim=dim)
    return kept(tensors(targets, surroundings(spark, ones=ones, dim=dim)), "tensors")


def held_out(rows: DataFrame, share: int = 5, **settings) -> DataFrame:
    """One model, trained on the images whose hash isn't 0 modulo ``share`` and judged on the others: training and held rows, mae, mean_mae, pearson."""
    marked = kept(rows.withColumn("held", F.pmod(F.xxhash64("image_id"), F.lit(share)) == 0).withColumn("fold", F.lit(0)), "split")
    weights = train(marked.where("NOT held"), **settings)
    return judged(predicted(marked.where("held").select("fold", "target", "tensor"), weights)).crossJoin(marked.where("NOT held").agg(F.count(F.lit(1)).alias("training_rows"))).drop("fold")


def left_out(rows: DataFrame, images: list[str], **settings) -> list[np.ndarray]:
    """A model for each of ``images``, trained on the rows of all others; the models of all folds at once."""
    folds = rows.sparkSession.createDataFrame([(k, i) for k, i in enumerate(images)], "fold int, out string")
    each = rows.join(F.broadcast(folds), F.col("image_id") != F.col("out")).drop("out")
    return train(each, len(images), **settings)


def leave_one_out(ones: DataFrame, dim: DataFrame, share: float = 0.75, most_images: int = 64, **settings) -> DataFrame:
    """Placement with each image's own left-out model against the distance order, at equal payload: a row per image.

    The payload is ``share`` of the smaller capacity of both. Up to ``most_images`` images: there are as many models, and each sees the rows of all other images.
    """
    spark = ones.sparkSession
    images = [r["image_id"] for r in dim.select("image_id").distinct().orderBy("image_id").limit(most_images + 1).collect()]
    if len(images) > most_images:
        raise ValueError(f"a model for each image: {most_images} images at most")
    if len(images) < 2:
        raise ValueError("leaving one image out needs two at least")
    rows = training_rows(ones, dim)
    weights = left_out(rows, images, **settings)
    hist = kept(steps.run(spark, "SELECT image_id, pat, n FROM hist", ones=ones, dim=dim), "hist")
    fold_of = F.create_map(*(F.lit(x) for k, i in enumerate(images) for x in (i, k)))
    ask = tensors(edges(spark, 1, hist=hist, dim=dim), surroundings(spark, ones=ones, dim=dim)).withColumn("fold", fold_of[F.col("image_id")])
    costs = predicted(ask.select("fold", "image_id", "peak", "candidate", "tensor"), weights)
    learned = cheapest_tables(costs, hist, dim).select("image_id", "rk", "peak", "pattern", "n")
    plain = steps.run(spark, "SELECT image_id, rk, peak, zero AS pattern, n FROM h1map", hist=hist, dim=dim)
    return compared(ones, dim, {"baseline": plain, "learned": learned}, share)


def compared(ones: DataFrame, dim: DataFrame, placements: dict[str, DataFrame], share: float) -> DataFrame:
    """Both placements embed one payload and are read back: image_id, payload_bits, their DRD, the reduction in percent, and whether the second one came back exactly."""
    made = {name: kept(df.select("image_id", "peak", F.posexplode(F.array("peak", "pattern")).alias("symbol", "pattern")), "tables") for name, df in placements.items()}
    rooms = [marking.capacity(ones, dim, t) for t in made.values()]
    payload = rooms[0].join(rooms[1].withColumnRenamed("capacity", "other"), "image_id").select("image_id", F.floor(F.least("capacity", "other") * share).cast("long").alias("bits"))
    payload = kept(payload, "payload")
    out = payload.withColumnRenamed("bits", "payload_bits")
    for name, t in made.items():
        flips = kept(marking.embed(ones, dim, t, payload), "flips")
        stego = kept(marking.toggled(ones, flips), "stego")
        found = kept(marking.read(stego, dim, t, payload), "found")
        runs = marking.evaluation(ones, dim, flips, marking.extracted(found), marking.restored(stego, found), payload, payload.select("image_id", F.lit(0).alias("wire_bits")))
        out = out.join(runs.select("image_id", F.col("drd").alias(f"{name}_drd"), (F.col("message_exact") & F.col("reversible")).alias(f"{name}_exact")), "image_id")
    first, second = (f"{name}_drd" for name in placements)
    cut = F.when(F.col(first) == 0, 0.0).otherwise(100 * (F.col(first) - F.col(second)) / F.col(first))
    return out.withColumn("reduction", F.round(cut, 9))


def macro(rows: DataFrame) -> DataFrame:
    """Over the folds of ``leave_one_out``: mean DRD of both, the reduction of the means, the mean of the reductions, and whether all came back."""
    a, b = F.avg("baseline_drd"), F.avg("learned_drd")
    return rows.agg(
        F.count(F.lit(1)).alias("folds"), a.alias("macro_baseline_drd"), b.alias("macro_learned_drd"), F.when(a == 0, 0.0).otherwise(100 * (a - b) / a).alias("macro_reduction"), F.avg("reduction").alias("mean_reduction"), F.bool_and(F.col("baseline_exact") & F.col("learned_exact")).alias("all_exact"),
    )


# Queries


def raster(spark, sf_dir: str, fixture: str = "embeddings") -> dict[str, DataFrame]:
    ones = kept(steps.run(spark, "SELECT image_id, r, c FROM ones", sf_dir, fixture), "ones")
    return {"ones": ones, "dim": kept(steps.run(spark, "SELECT image_id, h, w FROM dim", sf_dir, fixture, ones=ones), "dim")}


def q_candidate_tensors(spark, sf_dir: str) -> DataFrame:
    """Every tensor: the two planes of patterns as strings, and of the surroundings how often each pixel is set."""
    given = raster(spark, sf_dir)
    made = tensors(edges(spark, 2, 16, **given), surroundings(spark, **given))
    counts = steps.run(spark, "SELECT image_id, pat AS peak, n FROM peaks", **given)
    text = lambda lo, f: F.array_join(F.transform(F.slice("tensor", lo, 81), f), "" if lo < 163 else ",")
    whole = lambda x: x.cast("int").cast("string")
    return made.join(counts, ["image_id", "peak"]).select("image_id", "peak", "candidate", "dist", text(1, whole).alias("peak_plane"), text(82, whole).alias("candidate_plane"), text(163, lambda x: F.round(x * F.col("n")).cast("int").cast("string")).alias("context_counts"))


def q_cost_order(spark, sf_dir: str) -> DataFrame:
    """Distance-one tables that take candidates by their exact cost."""
    given = raster(spark, sf_dir)
    hist = kept(steps.run(spark, "SELECT image_id, pat, n FROM hist", **given), "hist")
    costs = steps.run(spark, "SELECT e.image_id, e.peak, e.zero AS candidate, b.cost FROM edges e JOIN bit_costs b ON b.image_id = e.image_id AND b.peak = e.peak AND b.bit = e.b", hist=hist, **given)
    return cheapest_tables(costs, hist, given["dim"]).select("image_id", "rk", "peak", "pattern", "n")


def q_cost_network(spark, sf_dir: str) -> DataFrame:
    """The convolutional model on images it hasn't seen."""
    return held_out(training_rows(**raster(spark, sf_dir)), 4)


def q_leave_one_out(spark, sf_dir: str) -> DataFrame:
    """Each image's candidates in the order of a model of the other images, against distance order at equal payload."""
    return leave_one_out(**raster(spark, sf_dir), epochs=5)


QUERIES = {"candidate_tensors": q_candidate_tensors, "cost_order": q_cost_order, "cost_network": q_cost_network, "leave_one_out": q_leave_one_out}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)
