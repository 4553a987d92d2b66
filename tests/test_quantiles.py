"""Exact quantiles by ranges against numpy."""

import numpy as np
import pytest

from recoflow.operators import facets


@pytest.mark.parametrize("ranges", [2, 64])
def test_quantiles_equal_numpy(spark, ranges):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=500).tolist(), "b": [3.0] * 400 + [1.0, 2.0], None: rng.integers(0, 5, 301).astype(float).tolist(), "one": [7.5], "few": [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "top": 1.0}
    got = {r["g"]: r for r in facets.quantiles(df, "v", shares, "g", ranges=ranges).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose([got[g][n] for n in shares], np.quantile(vs, list(shares.values())))
    whole = facets.quantiles(df, "v", {"p25": 0.25}, ranges=ranges).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["p25"], np.quantile([v for vs in groups.values() for v in vs], 0.25))
    assert facets.quantiles(df.limit(0), "v", {"p25": 0.25}).collect() == []


def test_distribution_and_depths(spark):
    df = spark.createDataFrame([("x", i) for i in range(1, 101)] + [(None, 4)], "g string, n long")
    got = {r["g"]: tuple(r)[1:] for r in facets.distribution(df, "n", "g").collect()}
    assert got["x"] == pytest.approx((50.5, 50.5, 90.1, 99.01, 100)) and got[None] == (4.0, 4.0, 4.0, 4.0, 4)
    ranked = spark.createDataFrame([(q, i) for q, n in ((1, 30), (2, 10), (3, 20)) for i in range(n)], "query_id long, item_id long")
    assert tuple(facets.depth_summary(ranked).first()) == (3, 60, 20.0, pytest.approx(2 / 3))
    plan = facets.distribution(df, "n", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
