"""Signed-rank tests against enumeration."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from rasterlake.plans import steps


def ranks(values):
    size = np.abs(values)
    return np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])


@pytest.fixture(scope="module")
def tests():
    rng = np.random.default_rng(2)
    made = {f"t{n}_{most}": rng.integers(-most, most + 1, n).astype(float) for n in (1, 2, 5, 9, 12) for most in (2, 4, 1000)}
    return made | {"zeros": np.zeros(4), "fifty": rng.normal(0.3, 1, 50), "many": rng.normal(0.1, 1, 51), "apart": np.arange(1.0, 11)}


def test_p_equals_enumeration(spark, tests):
    rows = [(64, name, f"i{k}", "net", float(d)) for name, ds in tests.items() for k, d in enumerate(ds)]
    deltas = spark.createDataFrame(rows, "payload_bits int, competitor string, image string, metric string, d double")
    got = {r.competitor: r.p for r in steps.run(spark, "SELECT * FROM p_values", deltas=deltas).collect()}
    for name, ds in tests.items():
        ds = ds[ds != 0]
        if not len(ds):
            assert got[name] == 1
        elif len(ds) <= 12:
            r = ranks(ds)
            low = min(r[ds > 0].sum(), r[ds < 0].sum())
            sums = [sum(x for x, sign in zip(r, signs, strict=True) if sign) for signs in itertools.product((0, 1), repeat=len(r))]
            assert math.isclose(got[name], min(1, 2 * sum(s <= low for s in sums) / len(sums)), rel_tol=1e-12), name
    assert math.isclose(got["apart"], 2 / 1024)
    # The normal tail stands in beyond fifty pairs, where both agree to a hundredth.
    for name in ("fifty", "many"):
        ds, r, n = tests[name], ranks(tests[name]), len(tests[name])
        z = (min(r[ds > 0].sum(), r[ds < 0].sum()) - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        assert abs(got[name] - math.erfc(abs(z) / math.sqrt(2))) < (1e-6 if n > 50 else 0.01)
