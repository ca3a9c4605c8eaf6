"""Two layers in one raster: both messages and the raster come back, and rows add up."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import layers, marking, study
from rasterlake.plans import steps


@pytest.fixture(scope="module")
def raster(spark):
    rng, ones, dim, images = np.random.default_rng(3), [], [], {}
    for k in range(3):
        noise = rng.normal(size=(66, 57))
        padded = np.pad(noise, 3)
        m = sum(padded[i : i + 66, j : j + 57] for i in range(7) for j in range(7)) > 0
        if k == 2:
            m[:] = False  # nothing can carry bits
            m[30:33, 30:33] = True
        images[f"i{k}"] = m.astype(int)
        ones += [(f"i{k}", int(r), int(c)) for r, c in zip(*np.nonzero(m), strict=True)]
        dim.append((f"i{k}", 66, 57))
    return images, spark.createDataFrame(ones, "image_id string, r int, c int"), spark.createDataFrame(dim, "image_id string, h int, w int")


def array(df, shape, name):
    m = np.zeros(shape, int)
    for r in df.where(F.col("image_id") == name).collect():
        m[r.r, r.c] = 1
    return m


def drd(a, b):
    h, w = a.shape
    cost = sum(k * (a[r + i, c + j] != b[r, c]) for r, c in zip(*np.nonzero(a != b), strict=True) for i, j, k in steps.kernel() if 0 <= r + i < h and 0 <= c + j < w)
    whole = a[: h - h % 8, : w - w % 8].reshape(h // 8, 8, w // 8, 8).sum((1, 3))
    return cost / max(int(((whole > 0) & (whole < 64)).sum()), 1)


def test_both_layers_come_back_in_reverse_order(spark, raster):
    images, ones, dim = raster
    tables = steps.run(spark, "SELECT image_id, peak, zero AS pattern FROM h1map", ones=ones, dim=dim)
    tables = tables.select("image_id", "peak", F.posexplode(F.array("peak", "pattern")).alias("symbol", "pattern"))
    made = layers.two_layers(ones, dim, tables, study.uniform_places)
    payload = {r.image_id: r.bits for r in made["payload"].collect()}
    every = made["every"].collect()
    for name, m in images.items():
        first, both, back = (array(made[k], m.shape, name) for k in ("first", "both", "back"))
        assert (back == m).all()
        own = [r for r in every if r.image_id == name]
        places = [r for r in made["places"].collect() if r.image_id == name]
        assert len(places) == int(0.75 * len(own)) and [r.i for r in sorted(places, key=lambda r: (r.br, r.bc))] == list(range(len(places)))
        # The second layer stands in tiles that are of one colour once the first layer is in.
        assert all(first[3 * r.br : 3 * r.br + 3, 3 * r.bc : 3 * r.bc + 3].sum() in (0, 9) for r in own)
        bits = {r.i: r.bit for r in made["second_message"].where(F.col("image_id") == name).collect()}
        assert bits == {i: ((i * 1103515245 + 12345) // 65536) % 2 for i in range(len(places))}
        assert (both != first).sum() == sum(bits.values())
        said = {r.i: r.bit for r in made["message"].where(F.col("image_id") == name).collect()}
        assert said == {i: ((i * 1103515245 + 12345) // 65536) % 2 for i in range(payload[name])}
    assert payload["i2"] == 0 and payload["i0"] > 20
    rows = {r.image_id: r for r in layers.rows(ones, dim, made, study.wire_sizes("distance_one", tables, made["payload"], dim)).collect()}
    for name in ("i0", "i1"):
        r, m = rows[name], images[name]
        assert r.reversible and r.base_exact and r.second_exact and r.uniform_bits == int(0.75 * r.uniform_most) > 0
        assert r.net_bits == r.base_bits + r.uniform_bits - r.base_wire - r.uniform_wire == r.base_net + r.uniform_net
        assert np.isclose(r.base_drd, drd(m, array(made["first"], m.shape, name))) and np.isclose(r.both_drd, drd(m, array(made["both"], m.shape, name)))
    total = layers.summary(layers.rows(ones, dim, made, made["payload"].select("image_id", F.lit(0).alias("wire_bits")))).first()
    assert total.images == 3 and total.all_exact and np.isclose(total.max_both_drd, max(r.both_drd for r in rows.values()), atol=1e-9)


def test_a_share_of_no_places_is_none(spark):
    places = spark.createDataFrame([("a", 0, 0, 1, 0, 0)], "image_id string, br int, bc int, position int, was int, i long")
    assert layers.first_places(places, 0.75).count() == 0 and layers.first_places(places.limit(0), 1.0).count() == 0
    assert marking.uniform_flips(places).count() in (0, 1)
