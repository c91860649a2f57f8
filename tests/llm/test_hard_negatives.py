"""Hard negatives against all pairs, the bounds of segments, and SQL."""

import math

import numpy as np
import pytest
from llm_cases import SMALL
from oracle import connect, differences
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as h
from plumbline.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, score long, rank int, anchor int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, scale=256, dims=None):
    kept = [(i, l, [math.floor(scale * x) for x in v]) for i, v, l in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    asked = {(i, l, tuple(v)) for i, l, v in kept if i % every == 0}
    out = []
    for i, l, v in asked:
        scored = [(sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in kept if j != i]
        best = sorted(((-s, j) for s, j, m in scored if m == l))[:5]
        for s, j in best:
            fits = sorted((-t, k) for t, k, m in scored if m != l and 50 * -s <= 100 * t <= 95 * -s)[:3]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2, 3) for i, v, l in rows], SCHEMA).repartition(7)


def crowd(seed, n=700, dims=24):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims)) * 0.15
    labels = r.integers(0, 6, n)
    vectors = centres[labels] + r.normal(size=(n, dims)) * 0.12
    vectors[n // 3 : n // 2] = vectors[n // 3]  # one vector that many rows share
    return [(int(i), [float(x) for x in v], int(m)) for i, (v, m) in enumerate(zip(vectors, labels))]


@pytest.mark.parametrize("bytes_, tile", [(32_000_000, 2_048), (2_000, 50)])
def test_all_pairs(spark, monkeypatch, bytes_, tile):
    monkeypatch.setattr(h, "ANCHOR_BYTES", bytes_)
    monkeypatch.setattr(h, "TILE", tile)
    monkeypatch.setattr(h, "TILE_ANCHORS", 5)
    rows = crowd(1)
    found = got(h.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, scale=256.0))
    assert found == brute(rows, 20) and len(found) > 100


def test_odd_rows(spark):
    rows = crowd(2, 200, 5)
    rows += [(40, None, 1), (60, [1.0] * 5, None), (None, [1.0] * 5, 1), (80, [1.0, None, 2.0, 1.0, 1.0], 2), (100, [math.nan] * 5, 2), (101, [math.inf] + [0.0] * 4, 3)]
    rows += [(301, [], 1), (302, [0.5], 2), (303, [0.2] * 9, 3), (400, [], 1), (401, [0.1] * 5, -4)] + [rows[20]] * 3 + [rows[33]] * 2
    found = h.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, scale=256.0)
    assert got(found) == brute(rows, 20)
    assert h.hard_negatives(frame(spark, []).where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [3e9, 1.0], 1), (1, [2e9, 5.0], 1), (2, [1.5e9, 7.0], 2), (3, [1e9, 1.0], 2), (4, [1e300, 1.0], 1), (5, [1.2e9, 0.0], 3)]
    found = got(h.hard_negatives(frame(spark, rows), F.col("vec_id") == 0))
    assert (0, 1, 1, 2, 6_000_000_000_000_000_005, 4_500_000_000_000_000_007) in found
    assert {r[4] for r in found if r[1] == 4} == {2**63 - 1} or not {r for r in found if r[1] == 4}


def test_bounds_hold_at_every_level():
    r = np.random.default_rng(3)
    a, b = (h.Vectors(np.arange(n), np.zeros(n, int), np.floor(r.normal(size=(n, 37)) * 90)) for n in (30, 40))
    exact = a.matrix @ b.matrix.T
    reaches = []
    for (m, d), (n, e) in zip(a.levels, b.levels):
        assert (np.abs(exact - m @ n.T) <= d @ e.T + 1e-6).all()
        reaches.append((d @ e.T).mean())
    assert reaches == sorted(reaches, reverse=True)


def test_query_equals_sql(spark):
    assert differences(queries.op11_hard_negatives(spark, SMALL), connect(SMALL), queries.SQL["op11_hard_negatives"]) == []
