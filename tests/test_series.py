"""Rolling frames, growth and fills: the block-wise way equals one window and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import elapsed_days, pct_change, safe_ratio
from plumbline.operators import series
from plumbline.operators.features import price_features, revenue_features


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame({
        "id": range(n), "k": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 9, n)),
        "d": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 500, n), unit="D"),
        "v": np.round(rng.random(n) * 10),
    })
    pdf.loc[::7, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf).cache()


def build(w):
    return {"m": series.rolling_mean("v", w, 7), "s": series.rolling_std("v", w, 30), "g": series.growth("known", w, 7)}


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("block", [1_000_000, 70])
def test_rolling_equals_pandas(data, keys, block):
    pdf, df = data
    got = series.over_rows(df, keys, ["d", "id"], 30, build, fill={"known": series.number("v")}, block_rows=block)
    got = got.toPandas().sort_values("id").reset_index(drop=True)
    want = []
    for _, g in pdf.sort_values(["d", "id"]).groupby(keys) if keys else [(None, pdf.sort_values(["d", "id"]))]:
        known = g.v.ffill()
        want.append(pd.DataFrame({
            "id": g.id, "m": g.v.rolling(7, min_periods=1).mean(), "s": g.v.rolling(30, min_periods=1).std().fillna(0),
            "g": known.pct_change(7, fill_method=None).fillna(0),
        }))
    want = pd.concat(want).sort_values("id").reset_index(drop=True)
    for c in ("m", "s", "g"):
        assert np.allclose(got[c].astype(float), want[c], equal_nan=True, atol=1e-9), c


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_sessions_use_the_latest_login(spark, block):
    rows = [(1, i, ["login", "view", "logout"][i % 3], i * 100) for i in range(300)] + [(2, 900, "logout", 50), (2, 901, "login", 60), (2, 902, "logout", 90_060)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = series.session_durations(df, block_rows=block).collect()
    assert len(got) == 101
    assert {r.session_duration for r in got if r.user_id == 1} == {200.0}
    assert [r.session_duration for r in got if r.user_id == 2] == [90_000.0]  # whole days count
    assert series.session_durations(df, ttl_seconds=3600, block_rows=block).filter("user_id = 2").count() == 0


def test_division_by_zero(spark):
    rows = [(0.0, 5.0), (0.0, -5.0), (0.0, 0.0), (None, 1.0), (2.0, 3.0)]
    df = spark.createDataFrame(rows, "p double, c double")
    got = [tuple(r) for r in df.select(pct_change(F.col("c"), F.col("p")), safe_ratio("c", "p")).collect()]
    assert got == [(float("inf"), 0.0), (float("-inf"), 0.0), (0.0, None), (0.0, None), (0.5, 1.5)]


def test_elapsed_days_round_down(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 06:00:00' AS a, timestamp'2024-01-01 18:00:00' AS b")
    assert df.select(elapsed_days("a", "b"), elapsed_days("b", "a")).first()[:] == (0, -1)


def test_revenue_features_in_blocks(spark):
    df = spark.range(400).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") * 37 % 101).cast("double").alias("revenue"))
    key = lambda rows: sorted(map(str, rows))
    assert key(revenue_features(df).collect()) == key(revenue_features(df, block_rows=100).collect())


def test_price_features_with_one_hot_product(spark):
    df = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5)).alias("product_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (F.col("id") % 11 + 1).cast("double").alias("price"), (F.col("id") % 7 + 1).alias("quantity_sold"),
    )
    key = lambda rows: sorted(map(str, rows))
    assert key(price_features(df).select("product_id", "date", "price_change", "quantity_trend", "price_tier", "price_percentile").collect()) == key(
        price_features(df, block_rows=50).select("product_id", "date", "price_change", "quantity_trend", "price_tier", "price_percentile").collect())


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    out = series.keep_first(df, ["k"], ["id"])
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]
    assert "WindowGroupLimit" in out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("kind", ["decimal(20,3)", "string", "timestamp"])
def test_blocks_of_any_order_type(spark, kind):
    value = F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int")) if kind == "timestamp" else F.lpad(F.col("id").cast("string"), 5, "0").cast(kind)
    df = spark.range(200).select(value.alias("at"), (F.col("id") % 7).cast("double").alias("v"))
    ways = [series.over_rows(df, [], ["at"], 7, lambda w: {"m": series.rolling_mean("v", w, 7)}, block_rows=n) for n in (1_000, 20)]
    one, many = ({r["at"]: r["m"] for r in way.collect()} for way in ways)
    assert len(one) == 200 and one == pytest.approx(many)


def test_keys_are_counted_only_where_a_bound_leaves_it_open(spark, monkeypatch):
    rows = [(None, 1)] * 4 + [("a", 1)] * 3 + [("b", i) for i in range(5)]
    df, calls = spark.createDataFrame(rows, "k string, v int"), []
    longest = series.longest_key
    monkeypatch.setattr(series, "longest_key", lambda *args: (calls.append(1), longest(*args))[1])
    out = series.over_rows(df, ["k"], ["v"], 1, lambda w: {"n": F.count("*").over(w.rowsBetween(-1, 0))})
    assert out.count() == 12 and not calls
    monkeypatch.setattr(series, "KEY_GROUPS", 1)  # all keys share a group
    assert series.short_keys(df, ["k"], 5) and not series.short_keys(df, ["k"], 4) and len(calls) == 2
    assert series.short_keys(df, [], 12) and not series.short_keys(df, [], 11)
    assert series.short_keys(df.filter("false"), ["k"], 0)
