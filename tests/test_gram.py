"""Correlations of many columns against numpy."""

import numpy as np

from plumbline.operators.clean import select_features
from plumbline.operators.gram import gram_correlations
from plumbline.operators.profile import correlations


def test_a_thousand_columns(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 20))
    values = base @ r.normal(size=(20, 1000)) + r.normal(size=(300, 1000)) + 1e6
    values[r.random(values.shape) < 0.1] = np.nan
    values[:, 7] = 3.5
    names = [f"c{i}" for i in range(1000)]
    frame = spark.createDataFrame([(row.tolist(),) for row in values], "v array<double>").repartition(4)
    wide = frame.select(*[frame.v[i].alias(n) for i, n in enumerate(names)])
    found = {(x["column_a"], x["column_b"]): (x["correlation"], x["n_rows"]) for x in gram_correlations(wide, names).collect()}
    assert len(found) == 1000 * 999 // 2
    for i, j in [(0, 1), (3, 998), (500, 501), *map(sorted, r.integers(0, 1000, (200, 2)).tolist())]:
        if i == j or 7 in (i, j):
            continue
        both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
        got, n = found[names[i], names[j]]
        assert n == both.sum() and abs(got - np.corrcoef(values[both, i], values[both, j])[0, 1]) < 1e-8
    assert found["c7", "c8"][0] is None


def test_both_ways_agree(spark):
    r = np.random.default_rng(2)
    values = r.normal(size=(200, 26)).cumsum(axis=1)
    wide = spark.createDataFrame([tuple(float(x) for x in v) for v in values], ", ".join(f"x{i} double" for i in range(26)))
    some = [f"x{i}" for i in range(12)]
    plain = {(x["column_a"], x["column_b"]): x["correlation"] for x in correlations(wide, some).collect()}
    every = {(x["column_a"], x["column_b"]): x["correlation"] for x in correlations(wide).collect()}
    assert all(abs(every[k] - v) < 1e-9 for k, v in plain.items())
    assert select_features(wide, [f"x{i}" for i in range(25)], "x25", k=1) == ["x24"]


def test_empty(spark):
    empty = spark.createDataFrame([], ", ".join(f"x{i} double" for i in range(3)))
    assert all(r["correlation"] is None and r["n_rows"] == 0 for r in gram_correlations(empty, ["x0", "x1", "x2"]).collect())
