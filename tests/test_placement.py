"""Learned placement: tensors, gradients, training over partitions, and tables in order of cost."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import placement
from rasterlake.operators.custom import adaptive_tables
from rasterlake.plans import steps


def patterns(m):
    h, w = m.shape
    out = {}
    for r in range(0, h - h % 3, 3):
        for c in range(0, w - w % 3, 3):
            out.setdefault(int("".join(map(str, m[r : r + 3, c : c + 3].ravel())), 2), []).append((r, c))
    return out


def flip_costs(m):
    h, w = m.shape
    return {(r, c): sum(k * (m[r + i, c + j] == m[r, c]) for i, j, k in steps.kernel() if 0 <= r + i < h and 0 <= c + j < w) for r in range(h) for c in range(w)}


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(6)
    out = {}
    for k in range(4):
        m = np.zeros((48, 39), int)
        for _ in range(14):
            r, c, a, b = rng.integers(0, 40), rng.integers(0, 33), rng.integers(3, 12), rng.integers(3, 12)
            m[r : r + a, c : c + b] ^= 1
        out[f"i{k}"] = m ^ (rng.random(m.shape) < 0.04)
    return out


@pytest.fixture(scope="module")
def raster(spark, images):
    ones = spark.createDataFrame([(k, int(r), int(c)) for k, m in images.items() for r, c in zip(*np.nonzero(m), strict=True)], "image_id string, r int, c int")
    return {"ones": ones, "dim": spark.createDataFrame([(k, *m.shape) for k, m in images.items()], "image_id string, h int, w int")}


def test_tensors_and_targets_are_those_of_the_pixels(spark, images, raster):
    rows = placement.training_rows(**raster).collect()
    assert len(rows) > 100
    for r in rows[:: max(1, len(rows) // 60)]:
        m = images[r.image_id]
        at, costs = patterns(m)[r.peak], flip_costs(m)
        padded = np.pad(m, 4, mode="edge")
        context = np.mean([padded[a + 1 : a + 10, b + 1 : b + 10] for a, b in at], 0)
        x = np.array(r.tensor).reshape(3, 9, 9)
        assert np.allclose(x, placement.tensor_array(r.peak, np.array([r.candidate]), context)[0], atol=1e-6)
        assert [int(v) for v in x[0, 3:6, 3:6].ravel()] == [int(b) for b in f"{r.peak:09b}"] and x[0].sum() == bin(r.peak).count("1")
        bits = [k for k in range(9) if (r.peak ^ r.candidate) >> (8 - k) & 1]
        assert np.isclose(r.target, np.mean([sum(costs[a + k // 3, b + k % 3] for k in bits) for a, b in at]))


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    w, x, t = placement.first_weights(3), rng.random((6, 3, 9, 9)), rng.random(6) * 3
    assert len(w) == placement.WEIGHTS == 23_649
    g = placement.gradient(w, x, t)[1]
    edge = np.cumsum([0, *placement.SIZES])
    for k in [*rng.integers(0, len(w), 60), *(int(a + (b - a) // 2) for a, b in zip(edge[:-1], edge[1:], strict=True))]:
        up, down = w.copy(), w.copy()
        up[k], down[k] = w[k] + 1e-5, w[k] - 1e-5
        assert abs((placement.gradient(up, x, t)[0] - placement.gradient(down, x, t)[0]) / 2e-5 - g[k]) < 1e-7
    assert (placement.forward(w, x)[0] > 0).all()


def test_training_is_the_average_of_its_shards(spark, raster):
    rows = placement.training_rows(**raster).withColumn("fold", F.lit(0))
    made = placement.train(rows, 1, epochs=2, shards=3, batch=16)[0]
    local = rows.select("image_id", "peak", "candidate", "target", "tensor", F.pmod(F.xxhash64("image_id", "peak", "candidate"), F.lit(3)).alias("shard")).collect()
    state, step = np.stack([placement.first_weights(20260607), *np.zeros((2, placement.WEIGHTS))]), 0
    for number in range(2):
        parts = []
        for shard in range(3):
            own = sorted((r for r in local if r.shard == shard), key=lambda r: (r.image_id, r.peak, r.candidate))
            x, t = np.array([r.tensor for r in own], np.float32).reshape(-1, 3, 9, 9), np.array([r.target for r in own])
            parts.append((len(own), *placement.epoch(state, step, x, t, 16, 5e-3, np.random.default_rng([20260607, number, 0, shard]))))
        state, step = sum(n * s for n, s, _ in parts) / sum(n for n, _, _ in parts), max(k for _, _, k in parts)
    assert np.allclose(made, state[0], atol=1e-4)


def test_the_model_is_better_than_the_mean_on_unseen_images(spark, raster):
    r = placement.held_out(placement.training_rows(**raster), 2, epochs=12, shards=1).first()
    assert r.rows > 50 and r.training_rows > 50 and r.mae < 0.6 * r.mean_mae and r.pearson > 0.8


def cheapest(counts, cost):
    free, made = {p for p in range(512) if not counts.get(p)}, {}
    for peak in sorted((p for p, n in counts.items() if n >= 2 and p not in (0, 511)), key=lambda p: (-counts[p], p)):
        near = sorted((round(cost(peak, 1 << b), 9), peak ^ (1 << b)) for b in range(9) if peak ^ (1 << b) in free)
        if near:
            made[peak] = near[0][1]
            free.discard(near[0][1])
    return made


def test_tables_in_order_of_cost_equal_a_plain_greedy_and_cost_no_more(spark, images, raster):
    hist = steps.run(spark, "SELECT image_id, pat, n FROM hist", **raster)
    costs = steps.run(spark, "SELECT e.image_id, e.peak, e.zero AS candidate, b.cost FROM edges e JOIN bit_costs b ON b.image_id = e.image_id AND b.peak = e.peak AND b.bit = e.b", **raster)
    got = placement.cheapest_tables(costs, hist, raster["dim"]).collect()
    plain = steps.run(spark, "SELECT image_id, peak, zero FROM h1map", **raster).collect()
    for name, m in images.items():
        at, flip = patterns(m), flip_costs(m)
        cost = lambda peak, mask: np.mean([flip[a + k // 3, b + k % 3] for k in [8 - mask.bit_length() + 1] for a, b in at[peak]])  # noqa: B023, E731
        want = cheapest({p: len(x) for p, x in at.items()}, cost)
        mine = {r.peak: r.pattern for r in got if r.image_id == name}
        assert mine == want and len(set(mine.values())) == len(mine)
        # Summed over the peaks that both orders give a table.
        other = {r.peak: r.zero for r in plain if r.image_id == name}
        both = mine.keys() & other.keys()
        assert sum(len(at[p]) * cost(p, p ^ mine[p]) for p in both) <= sum(len(at[p]) * cost(p, p ^ other[p]) for p in both) + 1e-9


def test_adaptive_tables_take_any_order():
    rng = np.random.default_rng(4)
    for _ in range(5):
        counts = {int(p): int(n) for p, n in zip(rng.choice(512, 120, False), rng.integers(1, 30, 120), strict=True)}
        by_distance = placement.ordered_tables(counts, lambda peak, near: np.bitwise_count(near ^ peak).astype(float))
        assert by_distance == adaptive_tables(counts)
        other = placement.ordered_tables(counts, lambda peak, near: -near.astype(float))
        used = [z for zs in other.values() for z in zs[1:]]
        assert len(set(used)) == len(used) and not set(used) & counts.keys() and all(zs[1:] == sorted(zs[1:], reverse=True) for zs in other.values())


def test_adaptive_tables_by_the_model(spark, raster):
    hist, contexts = steps.run(spark, "SELECT image_id, pat, n FROM hist", **raster), placement.surroundings(spark, **raster)
    weights = placement.first_weights(1)
    rows = placement.adaptive_by_model(hist, contexts, weights).collect()
    around = {(r.image_id, r.peak): np.array(r.context) for r in contexts.collect()}
    assert rows
    for name in {r.image_id for r in rows}:
        counts = {r.pat: r.n for r in hist.where(F.col("image_id") == name).collect()}
        want = placement.ordered_tables(counts, lambda p, near: placement.forward(weights, placement.tensor_array(p, near, around[name, p]))[0])  # noqa: B023
        assert {(r.peak, r.symbol): r.pattern for r in rows if r.image_id == name} == {(p, k): z for p, zs in want.items() for k, z in enumerate(zs)}


def test_left_out_models_do_not_see_their_image_and_placements_come_back(spark, raster, monkeypatch):
    seen = []
    original = placement.train
    monkeypatch.setattr(placement, "train", lambda rows, folds=1, **s: (seen.extend((r.fold, r.image_id) for r in rows.select("fold", "image_id").distinct().collect()), original(rows, folds, **s))[1])
    rows = placement.leave_one_out(**raster, epochs=1, shards=1)
    made = rows.collect()
    assert sorted(seen) == [(k, f"i{j}") for k in range(4) for j in range(4) if j != k]
    assert len(made) == 4 and all(r.baseline_exact and r.learned_exact and r.payload_bits > 0 for r in made)
    total = placement.macro(rows).first()
    assert total.folds == 4 and total.all_exact and np.isclose(total.macro_learned_drd, np.mean([r.learned_drd for r in made]))
    with pytest.raises(ValueError, match="1 images at most"):
        placement.leave_one_out(**raster, most_images=1)
