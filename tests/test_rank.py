"""Quantiles, tiers, ranks and joins on small frames, with limits set low to take the ways for large data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quantiles, rank, skew


def skewed(n=3000, seed=1, share=0.35):
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < share, 7.0, np.round(rng.lognormal(2, 2, n), 1))
    v[::50] = np.nan
    return pd.DataFrame({"id": [f"c{i}" for i in rng.permutation(n)], "v": v, "i": rng.integers(-50, 50, n)})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = skewed()
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("limit,accuracy", [(500_000, 10_000), (20, 50), (1, 100)])
def test_quantiles_equal_pandas(frame, limit, accuracy):
    pdf, df = frame
    qs = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]
    got = quantiles.exact_quantiles(df, {"v": qs, "i": qs}, exact_limit=limit, accuracy=accuracy)
    for c in ("v", "i"):
        assert got[c] == pytest.approx(pdf[c].quantile(qs).tolist())


def test_gathering_in_several_passes(frame, monkeypatch):
    pdf, df = frame
    monkeypatch.setattr(quantiles, "GATHER_LIMIT", 10)
    got = quantiles.exact_quantiles(df, {"v": [0.5], "i": [0.5]})
    assert got == {"v": [pdf.v.median()], "i": [pdf.i.median()]}


def test_quantiles_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([], "v double")
    assert quantiles.exact_quantiles(empty, {"v": [0.5]}) == {"v": [None]}
    nulls = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert quantiles.exact_quantiles(nulls, {"v": [0.25, 0.75]}) == {"v": [None, None]}
    same = spark.createDataFrame([(3.0,)] * 50, "v double")
    assert quantiles.exact_quantiles(same, {"v": [0.1, 0.9]}, exact_limit=5) == {"v": [3.0, 3.0]}


def test_sketch_only_quantiles_are_close(frame):
    pdf, df = frame
    got = quantiles.exact_quantiles(df, {"i": [0.5]}, exact=False)["i"][0]
    assert abs(got - pdf.i.median()) <= 1


@pytest.mark.parametrize("q", [3, 4])
@pytest.mark.parametrize("limit", [500_000, 10])
def test_tiers_equal_pandas(frame, q, limit):
    pdf, df = frame
    model = rank.fit_tiers(df, "v", q, tie="id", pandas_edges=True, exact_limit=limit)
    got = df.select("id", model.expression().alias("t")).toPandas().sort_values("id")
    ordered = pdf.sort_values("id")
    want = pd.qcut(ordered.v.rank(method="first"), q, labels=rank.TIER_LABELS[q]).astype(str)
    assert got.t.fillna("nan").tolist() == want.tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 13])
def test_tiers_of_few_rows(spark, n):
    df = spark.range(n).select(F.col("id").cast("double").alias("v"), F.col("id").cast("string").alias("k"))
    got = [r.t for r in df.select("v", rank.fit_tiers(df, "v", 4, tie="k").expression().alias("t")).orderBy("v").collect()]
    want = [max(1, math.ceil(i * 4 / (n - 1))) if n > 1 else 1 for i in range(n)]
    assert got == [rank.TIER_LABELS[4][b - 1] for b in want]


def test_pandas_edges_for_many_sizes():
    for q in (3, 4):
        for n in [*range(2, 200), 1501, 10_000]:
            codes = pd.qcut(pd.Series(np.arange(1.0, n + 1)), q, labels=False, duplicates="drop")
            want = [int((codes <= k - 1).sum()) - 1 for k in range(1, q)]
            assert rank._cut_ranks(n, q, True) == want


@pytest.mark.parametrize("ranges", [1024, 8])
def test_percent_rank_equals_pandas(frame, monkeypatch, ranges):
    pdf, df = frame
    monkeypatch.setattr(rank, "RANK_RANGES", ranges)
    got = rank.percent_rank_average(df, "v", "r").toPandas().sort_values("id")
    want = pdf.sort_values("id").v.rank(pct=True)
    assert np.allclose(got.r, want, equal_nan=True)


def test_running_totals_of_text_per_key(spark, monkeypatch):
    monkeypatch.setattr(rank, "RANK_BUCKETS", 5)
    rows = [(k, f"w{i:03d}", i + 1) for k in ("a", "b") for i in range(30)]
    out = rank.running_totals(spark.createDataFrame(rows, "k string, w string, n long"), "w", ["n"], keys=["k"])
    for row in out.collect():
        i = int(row.w[1:])
        assert row.n_before == sum(range(1, i + 1))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_balanced_join_equals_plain_join(spark, how):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 700).alias("k"), "id")
    right = spark.range(0, 700, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain, split = left.join(right, ["k"], how), skew.balanced_join(left, right, ["k"], how, small=False)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_hot_keys_are_few(spark):
    df = spark.range(10_000).select((F.col("id") % 5000).alias("k")).union(spark.range(5000).select(F.lit(7).cast("long").alias("k")))
    assert [r.k for r in skew.hot_keys(df, ["k"]).collect()] == [7]


@pytest.mark.parametrize("few", [1000, 2])
def test_ties_by_several_columns_and_null(spark, monkeypatch, few):
    monkeypatch.setattr(rank, "FEW_ROWS", few)
    rows = [(5.0, "b", 2), (5.0, None, 1), (5.0, "b", None), (5.0, "10", 3), (5.0, "1", 9), (5.0, "b", 1)]
    df = spark.createDataFrame(rows, "v double, k string, d int")
    model = rank.fit_tiers(df, "v", 3, tie=["k", "d"])
    got = [tuple(r) for r in df.withColumn("t", model.expression()).select("k", "d", "t").collect()]
    order = sorted(got, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    assert [r[2] for r in order] == ["low", "low", "medium", "medium", "high", "high"]


def test_percent_rank_of_hot_and_missing_values(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 == 1, None).otherwise((F.col("id") * 37 % 1000).cast("double")).alias("v"))
    got = rank.percent_rank_average(df, "v", "p").toPandas()
    want = got["v"].rank(pct=True)
    assert (got["p"] - want).abs().max() < 1e-12 and (got["p"].isna() == got["v"].isna()).all()


def test_rows_without_a_value_are_dealt_out(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 != 0, (F.col("id") * 37 % 1000).cast("double")).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = rank.percent_rank_average(df, "v", "r").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(r["count"] for r in rows) == 6000 and max(r["count"] for r in rows) < 2000


def test_more_ranges_for_more_rows(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") * 37 % 1000).cast("double").alias("v"))
    want = {r["id"]: r["r"] for r in rank.percent_rank_average(df, "v", "r").collect()}
    monkeypatch.setattr(rank, "RANK_RANGES", 4)
    monkeypatch.setattr(rank, "RANGE_ROWS", 50)
    assert {r["id"]: r["r"] for r in rank.percent_rank_average(df, "v", "r").collect()} == want


def test_rows_of_hot_values_take_no_window(spark):
    """Where every value is held by many rows, nothing is shuffled to rank them."""
    hot = spark.range(4000).select("id", F.when(F.col("id") % 7 != 0, (F.col("id") % 5).cast("double")).alias("v"))
    ranked = rank.percent_rank_average(hot, "v", "r")
    plan = ranked._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan
    got = ranked.toPandas()
    assert len(got) == 4000 and np.allclose(got.r, got.v.rank(pct=True), equal_nan=True)


def test_counts_of_many_pivots_stay_compiled(spark, monkeypatch):
    """No aggregation counts more columns than Spark compiles as a whole, and the quartiles are those of pandas."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({f"c{i}": rng.normal(size=3000) for i in range(9)})
    df, sizes = spark.createDataFrame(pdf), []
    agg = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *exprs: (sizes.append(len(exprs)), agg(self, *exprs))[1])
    qs = [0.25, 0.5, 0.75]
    got = quantiles.exact_quantiles(df, {c: qs for c in pdf.columns}, exact_limit=20)
    assert max(sizes) <= 100 and sum(sizes) > 100
    for c in pdf.columns:
        assert got[c] == pytest.approx(pdf[c].quantile(qs).tolist())


def test_percent_rank_uses_one_window_and_a_compiled_search(spark):
    df = spark.range(5000).select("id", (F.col("id") * 37 % 1000).cast("double").alias("v"))
    ranked = rank.percent_rank_average(df, "v", "r")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "lambda" not in plan
    got = ranked.toPandas()
    assert np.allclose(got.r, got.v.rank(pct=True))


def test_ranges_of_ends_zeros_and_infinities(spark):
    values = [-math.inf, -2.5, -0.0, 0.0, 1.0, 1.5, 2.0, math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for splits in ([], [0.0], [-2.5, 0.0, 1.0, 2.0], [-math.inf, 0.0], [1.0, math.inf], [-math.inf, 1.0, math.inf], [math.inf], [-math.inf]):
        for v, found in rank.with_range(df, "v", splits, "at").collect():
            assert found == (None if v is None else sum(s < v for s in splits)), (splits, v)


def test_percent_rank_of_infinities(spark):
    rows = [(i, v) for i, v in enumerate([-math.inf] * 40 + [math.inf] * 60 + [0.0, -0.0, 3.0, 3.0, None, math.nan])]
    got = rank.percent_rank_average(spark.createDataFrame(rows, "id long, v double"), "v", "r").toPandas()
    assert np.allclose(got.r, got.v.rank(pct=True), equal_nan=True)
