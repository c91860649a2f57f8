"""Seasonal forecasts, pooled elasticities and upserts of touched folders."""

import datetime
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import forecast as P
from plumbline.sources import sinks

START = datetime.date(2024, 1, 1)


def test_exact_series_are_continued(spark):
    """A line with weekday effects is forecast without an error; odd series have defined results."""
    effect = [5.0, 0.0, -5.0, 1.0, -1.0, 3.0, -3.0]
    rows = [("line", START + datetime.timedelta(d), 10.0 + 2 * d + effect[d % 7]) for d in range(70)]
    rows += [("one", START, 4.0), ("gone", None, 1.0), ("gone", START, None), (None, START, 1.0), (None, START + datetime.timedelta(1), 3.0)]
    out = P.seasonal_forecast(spark.createDataFrame(rows, "s string, date date, y double"), "s", "date", "y", horizon=14).collect()
    by = {}
    for r in out:
        by.setdefault(r.s, []).append(r)
    assert set(by) == {"line", "one", None} and all(len(x) == 14 for x in by.values())
    slope, intercept = np.polyfit(np.arange(70), [y for s, _, y in rows[:70]], 1)
    for r in by["line"]:
        d = (r.date - START).days
        own = [10 + 2 * k + effect[k % 7] - intercept - slope * k for k in range(d % 7, 70, 7)]
        assert r.forecast == pytest.approx(intercept + slope * d + np.mean(own))
        assert abs(r.forecast - (10 + 2 * d + effect[d % 7])) < 1
    assert all(r.forecast == 4.0 and r.low is None and r.coverage is None for r in by["one"])
    assert P.seasonal_forecast(spark.createDataFrame([], "s string, date date, y double"), "s", "date", "y").count() == 0


def test_coverage_of_noisy_series(spark):
    """With independent noise about nineteen of twenty later days lie in the interval."""
    r = np.random.default_rng(4)
    rows = [(f"s{s}", START + datetime.timedelta(d), float(100 + 0.3 * d + 8 * (d % 7 > 4) + r.normal(0, 5))) for s in range(20) for d in range(196)]
    frame = spark.createDataFrame(rows, "s string, date date, y double")
    known = frame.where(F.col("date") < START + datetime.timedelta(168))
    out = P.seasonal_forecast(known, "s", "date", "y", horizon=28)
    both = out.join(frame, ["s", "date"])
    row = both.agg(F.count("*").alias("n"), F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("int")).alias("held"), F.avg("coverage").alias("told")).first()
    assert row.n == 20 * 28 and 0.9 <= row.held <= 0.99 and 0.9 <= row.told <= 0.99


def test_pooled_elasticity_equals_a_plain_computation(spark):
    r = np.random.default_rng(2)
    rows, slopes = [], {}
    for k in range(40):
        slope, n = r.normal(-1.5, 0.4), (2, 4, 30)[k % 3]
        p = np.exp(r.normal(1, 0.3, n))
        q = np.exp(3 + slope * np.log(p) + r.normal(0, 0.3, n))
        slopes[f"p{k}"] = (np.log(p), np.log(q))
        rows += [(f"p{k}", float(a), float(b)) for a, b in zip(p, q)]
    rows += [("same", 2.0, 3.0), ("same", 2.0, 5.0), ("none", None, 1.0), ("none", -1.0, 2.0), ("once", 2.0, 2.0)]
    got = {x.k: x for x in P.pooled_elasticity(spark.createDataFrame(rows, "k string, p double, q double"), key="k", price="p", quantity="q").collect()}
    sxx = {k: ((x - x.mean()) ** 2).sum() for k, (x, _) in slopes.items()}
    b = {k: ((x - x.mean()) * (y - y.mean())).sum() / sxx[k] for k, (x, y) in slopes.items()}
    sse = sum((((y - y.mean()) - b[k] * (x - x.mean())) ** 2).sum() for k, (x, y) in slopes.items() if len(x) > 2)
    s = sse / sum(len(x) - 2 for x, _ in slopes.values() if len(x) > 2)
    a = sum(sxx.values())
    mu = sum(sxx[k] * b[k] for k in b) / a
    t = max(0, (sum(sxx[k] * (b[k] - mu) ** 2 for k in b) - s * (len(b) - 1)) / (a - sum(v * v for v in sxx.values()) / a))
    for k in b:
        v = s / sxx[k]
        assert got[k].own_elasticity == pytest.approx(b[k]) and got[k].weight == pytest.approx(t / (t + v))
        assert got[k].elasticity_coefficient == pytest.approx((t * b[k] + v * mu) / (t + v))
    assert t > 0 and got["p0"].n_sales == 2
    for k in ("same", "none", "once"):
        assert got[k].own_elasticity is None and got[k].weight == 0 and got[k].elasticity_coefficient == pytest.approx(mu)


def test_pooling_brings_the_slopes_nearer_to_the_truth(spark):
    r = np.random.default_rng(7)
    truth, rows = {}, []
    for k in range(200):
        truth[k] = r.normal(-1.2, 0.3)
        p = np.exp(r.normal(1, 0.2, 3))
        rows += [(k, float(a), float(np.exp(2 + truth[k] * np.log(a) + r.normal(0, 0.3)))) for a in p]
    got = P.pooled_elasticity(spark.createDataFrame(rows, "k long, p double, q double"), key="k", price="p", quantity="q").collect()
    own = np.mean([(x.own_elasticity - truth[x.k]) ** 2 for x in got])
    assert np.mean([(x.elasticity_coefficient - truth[x.k]) ** 2 for x in got]) < 0.5 * own


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{sinks.BUCKET}=*/*.parquet")}


def test_only_touched_folders_are_read_and_written(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(1000).select("id", F.lit("old").alias("since"), (F.col("id") * 2).alias("v"))
    sinks.write_bucketed(base, path, ["id"], 32)
    before = files(path)
    updates = spark.createDataFrame([(7, "new", 1), (2000, "new", 2)], "id int, since string, v int")
    folders = sinks.upsert_touched(spark, path, updates, ["id"], keep=["since"], buckets=32)
    after = files(path)
    assert 1 <= len(folders) <= 2
    rewritten = {f for f in before if f not in after or after[f] != before[f]}
    assert rewritten == {f for f in before if int(f.split(f"{sinks.BUCKET}=")[1].split("/")[0]) in folders}
    rows = {r.id: (r.since, r.v) for r in spark.read.parquet(path).collect()}
    want = {i: ("old", 2 * i) for i in range(1000)} | {7: ("old", 1), 2000: ("new", 2)}
    assert rows == want
    plan = spark.read.parquet(path).where(F.col(sinks.BUCKET).isin(folders))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text
    # Merging the same rows again changes nothing, nor does an empty table.
    sinks.upsert_touched(spark, path, updates, ["id"], keep=["since"], buckets=32)
    assert sinks.upsert_touched(spark, path, updates.limit(0), ["id"], buckets=32) == []
    assert {r.id: (r.since, r.v) for r in spark.read.parquet(path).collect()} == want
    with pytest.raises(ValueError, match="does not have"):
        sinks.upsert_touched(spark, path, updates.withColumn("extra", F.lit(1)), ["id"], buckets=32)
