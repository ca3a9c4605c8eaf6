"""Custom queries read back what they embed, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from rasterlake import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", ["adaptive_roundtrip", "uniform_layer"])
def test_layers_come_back(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows and all(r.bits == r.bits_equal for r in rows)


@pytest.mark.parametrize("name", ["codec_roundtrip", "codec_multi", "codec_centres"])
def test_wires_come_back(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows and all(r.same for r in rows)


def test_written_steps_can_be_forgotten(spark):
    from rasterlake import stages

    stages.forget(spark)
    df = stages.kept(spark.range(3), "three")
    assert df.count() == 3 and stages.forget(spark) == 1 and stages.forget(spark) == 0
