"""Stored states of periods against the whole table: exact figures equal, sketches within their bounds."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import period_profile as P
from plumbline.session import scratch_path

SCHEMA = "at timestamp, amount double, kind string, key long, nothing double"


def frame(spark, n=40_000, seed=1):
    r = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (start + dt.timedelta(hours=int(h)), 1e9 + float(x) if x > -1.5 else (math.nan if x > -2 else None), f"k{int(z)}", int(k), None)
        for h, x, z, k in zip(r.integers(0, 24 * 60, n), r.normal(size=n), np.minimum(r.zipf(1.5, n), 10**9), r.integers(0, 20_000, n))
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def df(spark):
    return frame(spark).cache()


def whole(df):
    amount = F.when(~F.isnan("amount"), F.col("amount"))
    return df.agg(F.count("*"), F.count(amount), F.min(amount), F.max(amount), F.avg(amount - 1e9) + 1e9, F.stddev_samp(amount - 1e9)).first()


def test_merged_states_equal_the_whole_table(spark, df):
    path = scratch_path(spark, "states")
    P.store_states(df, path, "at")
    got = {r["column"]: r for r in P.merged_profile(P.stored(spark, path)).collect()}
    n, values, lo, hi, mean, std = whole(df)
    a = got["amount"]
    assert (a.n_rows, a.non_null_count, a.null_count, a.min, a.max) == (n, values, n - values, lo, hi)
    assert abs(a["mean"] - mean) < 1e-6 and abs(a["std"] - std) < 1e-6
    keys = df.select("key").distinct().count()
    assert abs(got["key"].unique_estimate - keys) < 0.04 * keys
    for share, estimate in zip((0.25, 0.5, 0.75), got["key"].quantile_estimates):
        assert abs(df.where(F.col("key") <= estimate).count() / n - share) < 0.02
    exact = {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()}
    assert [t["item"] for t in got["kind"].top_estimates] == sorted(exact, key=lambda v: -exact[v])[:5]
    assert all(abs(t["count"] - exact[t["item"]]) <= n / P.TRACKED for t in got["kind"].top_estimates)
    nothing = got["nothing"]
    assert (nothing.null_count, nothing.unique_estimate, nothing["min"], nothing["mean"], nothing.quantile_estimates, nothing.top_estimates) == (n, 0, None, None, None, None)


def test_refresh_reads_and_writes_its_periods_only(spark, df):
    path = scratch_path(spark, "states")
    stale = df.withColumn("amount", F.when(F.col("at") >= "2024-02-10", F.col("amount") * 2).otherwise(F.col("amount"))).where("at < '2024-02-20'")
    P.store_states(stale, path, "at")
    before = P.stored(spark, path).where("_period < '2024-02-10'").select("_period", "column", "mean").collect()
    for _ in range(2):  # doing it again changes nothing
        P.refresh_states(df, path, "at", "2024-02-10", "2024-04-01")
        a = P.merged_profile(P.stored(spark, path)).where("column = 'amount'").first()
        n, values, lo, hi, mean, std = whole(df)
        assert (a.n_rows, a.non_null_count, a.min, a.max) == (n, values, lo, hi) and abs(a["mean"] - mean) < 1e-6 and abs(a["std"] - std) < 1e-6
    after = P.stored(spark, path).where("_period < '2024-02-10'").select("_period", "column", "mean").collect()
    assert sorted(map(str, before)) == sorted(map(str, after))


def test_emptied_periods_and_rows_without_a_time(spark, df):
    path = scratch_path(spark, "states")
    odd = df.limit(50).select(F.lit(None).cast("timestamp").alias("at"), "amount", "kind", "key", "nothing")
    P.store_states(df.unionByName(odd), path, "at", unit="month")
    left = df.where("at < '2024-02-01'").unionByName(odd)
    P.refresh_states(left, path, "at", "2024-02-01", "2024-03-01", unit="month")
    states = P.stored(spark, path)
    assert {r[0]: r[1] for r in states.where("column = 'kind'").select("_period", "n_rows").collect()} == {
        None: 50, dt.date(2024, 1, 1): left.where("at is not null").count(), dt.date(2024, 2, 1): 0,
    }
    got = {r["column"]: r.n_rows for r in P.merged_profile(states).collect()}
    assert set(got.values()) == {left.count()}
    assert P.merged_profile(P.period_states(df.limit(0), "at")).count() == 0


def test_exact_counts(spark, df):
    counts = P.period_counts(df, "at", ["kind", "key"], "month")
    got = P.merged_counts(counts, 3).where("column = 'kind'").orderBy("position").collect()
    exact = {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()}
    want = sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [(r["value"], r["n_rows"]) for r in got] == want and {r["unique_count"] for r in got} == {len(exact)}
