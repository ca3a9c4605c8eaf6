"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from rasterlake import registry

SF = "/root/testdata/sf0.001"
CHECKED = ["px_binary", "blocks_events", "pattern_hist", "zero_set", "h1_mapping", "h1_capacity", "net_prefix", "embed_h1", "drd", "hn_mapping", "level_profile", "pair_select", "inverse_diff", "diff_pattern_hist", "method_summary", "wilcoxon_z", "holm_adjust", "tradeoff_area", "otsu_threshold", "detector_features", "context_features", "uniform_samples", "auc_rank"]


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if v is None or v != v else v if isinstance(v, str) else round(float(v), 7) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())


def test_no_cartesian_product_of_pixels(spark):
    plan = registry.queries()["pattern_hist"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "HashAggregate" in plan
