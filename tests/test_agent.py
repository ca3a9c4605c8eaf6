"""The uniform-tile agent on rasters with holes (safe) and open ground (unsafe)."""

from __future__ import annotations

import numpy as np
import pytest

from rasterlake.operators import agent, marking


@pytest.fixture(scope="module")
def rasters(spark):
    rng, ones, dim = np.random.default_rng(4), [], []
    for k in range(3):
        image = np.zeros((60, 60), np.uint8)
        image[:30] = 1
        for r, c in {(int(r), int(c)) for r, c in zip(rng.integers(1, 9, 25), rng.integers(1, 19, 25), strict=True)}:
            image[3 * r : 3 * r + 3, 3 * c : 3 * c + 3] = 0
        image[45, 10:50] = 1
        ones += [(f"i{k}", int(r), int(c)) for r, c in zip(*np.nonzero(image), strict=True)]
        dim.append((f"i{k}", 60, 60))
    return spark.createDataFrame(ones, "image_id string, r int, c int"), spark.createDataFrame(dim, "image_id string, h int, w int")


def test_features_have_85_numbers_and_count_changes(rasters):
    rows = agent.tile_features(*rasters).collect()
    for r in rows:
        x = r.features.toArray()
        m = x[:81].reshape(9, 9)
        assert len(x) == 85 and x[81] == (r.pat == 511) and np.isclose(x[82], m.mean()) and np.isclose(x[83], (m[:, 1:] != m[:, :-1]).sum() / 72) and np.isclose(x[84], (m[1:] != m[:-1]).sum() / 72)
        assert r.constant == (m.min() == m.max())


def test_agent_layer_comes_back_and_models_are_saved(rasters, tmp_path):
    samples = agent.training_samples(*rasters)
    kinds = {(r.image_id, r.safe): r["count"] for r in samples.groupBy("image_id", "safe").count().collect()}
    assert all(kinds[i, 1.0] >= 5 and kinds[i, 0.0] <= 6 * kinds[i, 1.0] for i in ("i0", "i1", "i2"))
    models = agent.train(samples, 10, 6)
    agent.save(models, f"file://{tmp_path}/agent")
    places = agent.safe_tiles(*rasters, agent.load(f"file://{tmp_path}/agent"), 0.5)
    ones, dim = rasters
    stego = marking.toggled(ones, marking.uniform_flips(places))
    found = marking.read_uniform(stego, dim, places)
    rows = found.collect()
    assert len(rows) >= 20 and all(r.bit == ((r.i * 1103515245 + 12345) // 65536) % 2 for r in rows)
    assert marking.toggled(ones, marking.toggled(stego, marking.changed_pixels(found, "pattern", "whole"))).count() == 0
    got = agent.judged(samples, 3, 10, 6).first()
    assert got.samples == samples.count() and got.recall > 0.5
