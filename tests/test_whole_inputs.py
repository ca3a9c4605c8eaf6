"""Every character and every line item counts."""

from __future__ import annotations

import collections
import datetime

from rasterlake.plans import steps
from rasterlake.registry import queries


def test_all_characters_of_a_text_are_pixels(spark, tmp_path):
    texts = [(1, "a" * 96 + "é漢" * 70 + "😀z", "en"), (2, "", "en"), (3, None, "de"), (4, "b " * 300, "de")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter((lang, min(ord(c), 255)) for _, t, lang in texts for c in t or "")
    assert {(r.image_id, r.g): r.n for r in steps.run(spark, "SELECT * FROM gray_hist", str(tmp_path)).collect()} == want
    got = {r.image_id: (r.pixels, r.foreground) for r in queries()["threshold_source"](spark, str(tmp_path)).collect()}
    assert got == {k: (sum(n for (i, _), n in want.items() if i == k), sum(n for (i, g), n in want.items() if i == k and g >= 110)) for k in ("en", "de")}
    assert {r.image_id for r in queries()["otsu_suitability"](spark, str(tmp_path)).collect()} == {"en", "de"}


def test_all_lines_of_an_order_are_runs(spark, tmp_path):
    day = datetime.date(1995, 1, 1)
    lines = [(1, 4, 1, n, 10.0, 900.0, 0.05, day) for n in range(1, 8) for _ in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.method: (r.available, r.net) for r in steps.run(spark, "SELECT * FROM runs", str(tmp_path)).collect()}
    assert got == {"m0": (False, -280), "m1": (True, -260), "m2": (True, -260), "m3": (True, -260)}
