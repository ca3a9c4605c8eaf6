"""Detectors of several methods, and the analysis of runs, against plain versions."""

from __future__ import annotations

import itertools
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import registry
from rasterlake.operators import analysis, study


def test_auc_is_the_share_of_pairs_in_order(spark):
    rng = np.random.default_rng(4)
    rows = [(name, int(b), float(y), round(float(p), 1)) for name in ("a", "b") for b in (16, 32) for y, p in zip(rng.integers(0, 2, 40), rng.random(40), strict=True)]
    df = spark.createDataFrame(rows, "classifier string, payload_bits int, label double, p double")
    for r in study.judged(df, ("payload_bits", "classifier")).collect():
        own = [(y, p) for c, b, y, p in rows if (c, b) == (r.classifier, r.payload_bits)]
        pos, neg = [p for y, p in own if y == 1], [p for y, p in own if y == 0]
        assert np.isclose(r.auc, np.mean([(p > q) + (p == q) / 2 for p, q in itertools.product(pos, neg)]))
        assert np.isclose(r.balanced_accuracy, (np.mean([p >= 0.5 for p in pos]) + np.mean([p < 0.5 for p in neg])) / 2) and np.isclose(r.error_probability, 1 - r.balanced_accuracy)


@pytest.fixture(scope="module")
def shapes(spark):
    rng, ones, dim = np.random.default_rng(5), [], []
    for k in range(4):
        padded = np.pad(rng.normal(size=(54, 48)), 3)
        m = sum(padded[i : i + 54, j : j + 48] for i in range(7) for j in range(7)) > 0
        if k == 3:
            m[:] = False  # no method can mark it
        ones += [(f"i{k}", int(r), int(c)) for r, c in zip(*np.nonzero(m), strict=True)]
        dim.append((f"i{k}", 54, 48))
    return spark.createDataFrame(ones, "image_id string, r int, c int"), spark.createDataFrame(dim, "image_id string, h int, w int")


def test_all_methods_mark_the_same_images(spark, shapes):
    stego, sizes = study.marked_rasters(*shapes, (8, 16))
    made = {r.image_id for r in stego.select("image_id").distinct().collect()}
    assert made == {r.image_id for r in sizes.collect()}
    runs = {}
    for name in made:
        method, bits, image = name.split("#")
        runs.setdefault((method, int(bits)), set()).add(image)
    assert set(runs) == {(m, b) for m in study.DETECTED for b in (8, 16)} and len({frozenset(v) for (_, b), v in runs.items() if b == 8}) == 1 and all("i3" not in v for v in runs.values())
    # Each raster is what the method makes of the image alone.
    ones, dim = shapes
    payload = dim.select("image_id", F.lit(16).cast("long").alias("bits"))
    flips = study.through_tables("distance_one", ones, dim, payload)[2]
    for image in sorted(runs["distance_one", 16]):
        cells = lambda df, name: {(r.r, r.c) for r in df.where(F.col("image_id") == name).collect()}
        assert cells(stego, f"distance_one#16#{image}") == cells(ones, image) ^ cells(flips, image)


def test_a_row_for_each_payload_method_and_classifier(spark, shapes):
    rows = study.detect_all(*shapes, registry.SELECTS["detector_features"][1], (8,), methods=("distance_one", "pair"), most_folds=2, trees=3).collect()
    assert {(r.payload_bits, r.method, r.classifier) for r in rows} == {(8, m, c) for m in ("distance_one", "pair") for c in ("logistic", "random_forest")}
    assert all(r.images == 3 and r.folds == 2 and 0 <= r.auc <= 1 for r in rows)


def test_analysis_of_runs(spark, tmp_path):
    rng = np.random.default_rng(9)
    methods, images, rows = ("context", "distance_one", "pair", "single_peak"), [f"i{k}" for k in range(9)], []
    for bits, m, i in itertools.product((64, 128), methods, images):
        ok = bool(rng.random() < 0.85)
        rows.append((i, m, bits, ok, int(rng.integers(-9, 9)) if ok else None, round(float(rng.random()), 2) if ok else None, int(rng.integers(0, 5)) if ok else None, None if ok else "no room"))
    runs = spark.createDataFrame(rows, "image string, method string, payload_bits int, available boolean, net long, drd double, changed long, error string")
    back = analysis.through_reports(runs, f"file://{tmp_path}/reports")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, runs.collect()), key=str)
    suitable = {i: k % 3 > 0 for k, i in enumerate(images)}
    got = {(r.part, r.payload_bits, r.method, r.item): r.value for r in analysis.analyze(back, spark.createDataFrame(list(suitable.items()), "image string, suitable boolean")).collect()}
    seen = {(b, m, i): (net, drd) for i, m, b, ok, net, drd, _, _ in rows if ok}
    curves = {}
    for b, m in itertools.product((64, 128), methods):
        both = [i for i in images if all((b, x, i) in seen for x in methods)]
        net, drd = zip(*(seen[b, m, i] for i in both), strict=True)
        curves[m, b] = (statistics.median(drd), np.mean(net))
        assert got["curve", b, m, "matched images"] == len(both) and np.isclose(got["curve", b, m, "mean net"], np.mean(net)) and np.isclose(got["curve", b, m, "median drd"], statistics.median(drd))
        for label, flag in (("suitable", True), ("unsuitable", False)):
            mine = [seen[b, m, i] for i in images if suitable[i] is flag and (b, m, i) in seen]
            if mine:
                assert got["stratum", b, m, f"{label} images"] == len(mine) and got["stratum", b, m, f"{label} of"] == sum(v is flag for v in suitable.values())
                assert np.isclose(got["stratum", b, m, f"{label} mean net"], np.mean([n for n, _ in mine])) and np.isclose(got["stratum", b, m, f"{label} median drd"], statistics.median(d for _, d in mine))
    for m in methods:
        (x1, y1), (x2, y2) = sorted((curves[m, b][0], b, curves[m, b][1])[::2] for b in (64, 128))
        assert np.isclose(got["area", None, m, "area"], (x2 - x1) * (y1 + y2) / 2)
    for b in (64, 128):
        ps = []
        for m, k, metric in ((m, k, metric) for m in methods if m != "distance_one" for k, metric in ((0, "net"), (1, "drd"))):
            d = np.array([round(seen[b, "distance_one", i][k] - seen[b, m, i][k], 12) for i in images if (b, "distance_one", i) in seen and (b, m, i) in seen])
            assert got["test", b, m, f"{metric} pairs"] == len(d) and np.isclose(got["test", b, m, f"{metric} median"], np.median(d)) and got["test", b, m, f"{metric} wins"] == (d > 0).sum() and got["test", b, m, f"{metric} ties"] == (d == 0).sum()
            d = d[d != 0]
            rank = np.array([(np.abs(d) < abs(x)).sum() + ((np.abs(d) == abs(x)).sum() + 1) / 2 for x in d])
            low = min(rank[d > 0].sum(), rank[d < 0].sum())
            sums = [sum(itertools.compress(rank, s)) for s in itertools.product((0, 1), repeat=len(d))]
            p = min(1, 2 * np.mean([s <= low for s in sums])) if len(d) else 1.0
            assert np.isclose(got["test", b, m, f"{metric} p"], p)
            ps.append((p, got["test", b, m, f"{metric} adjusted p"]))
        most = 0.0
        for k, (p, adjusted) in enumerate(sorted(ps)):
            most = max(most, min(1, (len(ps) - k) * p))
            assert np.isclose(adjusted, most)


def test_verdicts_of_gray_rasters(spark):
    rows = [("good", g) for g in [*range(10, 60)] * 2 + [*range(180, 250)]] + [("dark", 5)] * 100 + [("off", g) for g in [100] * 50 + [120] * 50]
    got = {r.image: r.suitable for r in analysis.suitability(spark.createDataFrame(rows, "image_id string, g int")).collect()}
    assert got == {"good": True, "dark": False, "off": False}
