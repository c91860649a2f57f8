"""Nearest-neighbour fill against all pairs."""

import math
import random

import pytest

from plumbline.operators import neighbours


def brute(rows, k):
    width = len(rows[0][1])
    means = []
    for c in range(width):
        have = [v[c] for _, v in rows if v[c] is not None]
        means.append(sum(have) / len(have) if have else None)
    out = {}
    for key, v in rows:
        filled = list(v)
        for c in range(width):
            if v[c] is None:
                near = []
                for other, w in rows:
                    both = [j for j in range(width) if v[j] is not None and w[j] is not None]
                    if w[c] is not None and both and other != key:
                        total = 0.0
                        for j in both:
                            total += (v[j] - w[j]) ** 2
                        near.append((total * width / len(both), other, w[c]))
                best = [x for _, _, x in sorted(near)[:k]]
                filled[c] = sum(best) / len(best) if best else means[c]
        out[key] = filled
    return out


def crowd(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        centre = r.choice([0, 10, 50])
        v = [centre + r.gauss(0, 1), centre * 2 + r.gauss(0, 3), r.gauss(0, 1), 7.0]
        rows.append((f"k{i}", [None if r.random() < 0.25 else x for x in v]))
    rows += [(f"same{i}", [1.0, 2.0, None if i % 3 == 0 else 0.5, 7.0]) for i in range(n // 3)]
    return rows


@pytest.mark.parametrize("pivots, cell, block", [(64, 4_096, 1_024), (5, 9, 4)])
def test_all_pairs(spark, monkeypatch, pivots, cell, block):
    for name, value in (("PIVOTS", pivots), ("CELL", cell), ("BLOCK", block)):
        monkeypatch.setattr(neighbours, name, value)
    rows = crowd(pivots, 240) + [("none", [None] * 4)]
    frame = spark.createDataFrame([(k, *v) for k, v in rows], "id string, a double, b double, c double, d double").repartition(6)
    got = {r["id"]: list(r)[1:] for r in neighbours.nearest_fill(frame, "id", ["a", "b", "c", "d"], 3).collect()}
    want = brute(rows, 3)
    assert set(got) == set(want)
    for key, v in want.items():
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got[key], v)), key


def test_odd_tables(spark):
    schema = "id string, a double, b double, other string"
    assert neighbours.nearest_fill(spark.createDataFrame([], schema), "id", ["a", "b"]).count() == 0
    rows = [("x", 1.0, None, "o"), ("y", float("nan"), None, "o")]
    got = {r["id"]: (r["a"], r["b"], r["other"]) for r in neighbours.nearest_fill(spark.createDataFrame(rows, schema), "id", ["a", "b"]).collect()}
    assert got == {"x": (1.0, None, "o"), "y": (1.0, None, "o")}


def test_work_follows_the_rows(spark, monkeypatch):
    """Rows alike ask once and lend a few times, and a row visits few of many cells."""
    stored = {}

    def noted(df, label):
        out = neighbours_materialise(df, label)
        stored.setdefault(label, []).append(out)
        return out

    neighbours_materialise = neighbours.materialise
    monkeypatch.setattr(neighbours, "materialise", noted)
    monkeypatch.setattr(neighbours, "CELL", 64)
    r = random.Random(11)
    rows = [(f"a{i}", float(i % 3), None, None) for i in range(900)]  # three kinds of rows that ask
    rows += [(f"b{i}", 5.0, 6.0, 7.0) for i in range(900)]  # one kind that lends
    rows += [(f"c{i}", r.random() * 1000, r.random() * 1000, None if i % 2 else r.random()) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "id string, a double, b double, c double")
    got = {x["id"]: x for x in neighbours.nearest_fill(frame, "id", ["a", "b", "c"], 3).collect()}
    assert len(got) == len(rows) and len({(got[f"a{i}"]["b"], got[f"a{i}"]["c"]) for i in range(900)}) <= 3
    assert stored["asks"][0].count() == 3 + 1_500 and stored["lend"][0].where("key LIKE 'b%'").count() <= 4
    assert stored["cells"][0].count() > 40
    last = stored["asking"][1].where("NOT isnan(v[1])")  # both have more than 1,500 rows to look at if all cells are
    assert last.count() < 10 * 1_500
