"""Fit/transform steps against pandas on small frames, and their edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean as C
from plumbline.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({
        "id": [f"k{i}" for i in range(n)], "x": np.round(rng.lognormal(3, 1, n), 2), "y": rng.integers(0, 40, n).astype(float),
        "c": rng.choice(["a", "b", "c", "d"], n), "u": rng.choice(["yes", "no"], n), "flag": rng.integers(0, 2, n), "one": 5.0,
    })
    pdf.loc[::6, "x"] = np.nan
    pdf.loc[::9, "c"] = None
    pdf.loc[::3, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf).cache()


def back(df):
    return df.toPandas().assign(n=lambda d: d.id.str[1:].astype(int)).sort_values("n").reset_index(drop=True)


def test_auto_impute(data):
    pdf, df = data
    model = C.fit_impute(df, "auto", skip=["id"])
    got = back(model.transform(df))
    assert np.allclose(got.x, pdf.x.fillna(pdf.x.median()))
    assert np.allclose(got.y, pdf.y.fillna(pdf.y.median()))
    assert got.c.tolist() == pdf.c.fillna(pdf.c.mode()[0]).tolist()
    assert model.strategies == {"x": "median_fill", "y": "median_fill", "c": "mode_fill"}


def test_mostly_missing_column_is_dropped(data):
    _, df = data
    sparse = df.withColumn("s", F.when(F.col("id").endswith("7"), 1.0))
    assert "s" not in C.fit_impute(sparse, "auto").transform(sparse).columns


@pytest.mark.parametrize("strategy", ["mean", "median"])
def test_number_strategies_leave_text(data, strategy):
    pdf, df = data
    model = C.fit_impute(df, strategy)
    got = back(model.transform(df))
    assert np.allclose(got.x, pdf.x.fillna(getattr(pdf.x, strategy)()))
    assert got.c.isna().sum() == pdf.c.isna().sum() and model.strategies["c"] == "no_action"


def test_drop_and_mode(data):
    pdf, df = data
    clean = df.withColumn("x", F.nullif("x", F.lit(float("nan")))).withColumn("y", F.nullif("y", F.lit(float("nan"))))
    assert C.fit_impute(clean, "drop").transform(clean).count() == len(pdf.dropna())
    assert np.allclose(back(C.fit_impute(df, "mode").transform(df)).y, pdf.y.fillna(pdf.y.mode()[0]))


def test_timestamps_take_the_median_time(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00'), (timestamp'2024-01-03 00:00:00'), (NULL) AS t(ts)")
    assert str(C.fit_impute(df).transform(df).agg(F.max("ts"), F.min("ts"), F.count("ts")).first()[2]) == "3"


def test_group_median(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 10.0), ("a", None), ("b", 4.0), ("b", 6.0), ("b", None), ("c", None)]
    out = C.group_median_impute(spark.createDataFrame(rows, "g string, v double"), "v", ["g"])
    assert sorted((r.g, r.v) for r in out.collect()) == sorted([("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 10.0), ("b", 4.0), ("b", 5.0), ("b", 6.0), ("c", 4.0)])


def test_capping(data):
    pdf, df = data
    got = back(C.fit_cap(df, "iqr", skip=["id"]).transform(df))
    q1, q3 = pdf.x.quantile(0.25), pdf.x.quantile(0.75)
    assert np.allclose(got.x.astype(float), pdf.x.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)), equal_nan=True)
    got = back(C.fit_cap(df, "zscore").transform(df))
    assert np.allclose(got.x.astype(float), pdf.x.clip(pdf.x.mean() - 3 * pdf.x.std(), pdf.x.mean() + 3 * pdf.x.std()), equal_nan=True)
    assert "one" not in C.fit_cap(df, "iqr").bounds  # a constant is skipped
    assert C.fit_cap(df, "none").bounds == {}
    with pytest.raises(ValueError):
        C.fit_cap(df, "other")


def test_auto_encoding(data):
    pdf, df = data
    got = back(C.fit_encode(df, "auto", skip=["id"]).transform(df))
    want = pd.get_dummies(pdf.c, prefix="c", dummy_na=True)
    for column in want.columns:
        assert got[column].tolist() == want[column].tolist()
    assert got.u.tolist() == [["no", "yes"].index(v) for v in pdf.u]


def test_large_label_dictionary_equals_sorted_order(data, monkeypatch):
    pdf, df = data
    monkeypatch.setattr(C, "INLINE_CODES", 10)
    got = back(C.fit_encode(df, "label", columns=["id"]).transform(df.withColumn("keep", F.col("id"))).withColumnsRenamed({"id": "code", "keep": "id"}))
    ordered = sorted(pdf.id)
    assert got.code.tolist() == [ordered.index(v) for v in pdf.id]


def test_unseen_values(spark, data):
    _, df = data
    model = C.fit_encode(df, "onehot", columns=["c"], fill="unknown", dummy_missing=False)
    new = spark.createDataFrame([("z",), (None,), ("a",)], "c string")
    rows = [tuple(r) for r in model.transform(new).select("c_a", "c_b", "c_unknown").collect()]
    assert rows == [(False, False, False), (False, False, True), (True, False, False)]


def test_target_encoding(data):
    pdf, df = data
    out = C.fit_encode(df, "target", columns=["u"], target="flag", smoothing=10).transform(df).select("id", "u").toPandas()
    m = pdf.flag.mean()
    g = pdf.groupby("u").flag.agg(["sum", "count"])
    want = {u: (r["sum"] + 10 * m) / (r["count"] + 10) for u, r in g.iterrows()}
    merged = out.merge(pdf[["id", "u"]], on="id")
    assert np.allclose(merged.u_x, merged.u_y.map(want))


@pytest.mark.parametrize("method", ["robust", "standard", "minmax"])
def test_scaling(data, method):
    pdf, df = data
    model = C.fit_scale(df, method)
    got = back(model.transform(df))
    center, scale = {
        "robust": (pdf.x.median(), pdf.x.quantile(0.75) - pdf.x.quantile(0.25)), "standard": (pdf.x.mean(), pdf.x.std(ddof=0)),
        "minmax": (pdf.x.min(), pdf.x.max() - pdf.x.min()),
    }[method]
    assert np.allclose(got.x.astype(float), (pdf.x - center) / scale, equal_nan=True)
    assert got.flag.tolist() == pdf.flag.tolist() and model.binary == ["flag"]
    assert got.one.nunique() == 1  # a scale of 0 becomes 1
    assert C.fit_scale(df, "none").transform(df) is df


def test_narrowing(spark):
    df = spark.createDataFrame([(1, 300, -5, 254, 0.5, 0.1, None), (2, 70_000, 100, 3, 1.5, 0.2, 1.0)], "a long, b long, c long, d long, e double, f double, g double")
    assert C.fit_narrow(df).types == {"a": "smallint", "b": "bigint", "c": "tinyint", "d": "smallint", "e": "float"} or C.fit_narrow(df).types == {"a": "smallint", "c": "tinyint", "d": "smallint", "e": "float"}
    assert C.fit_narrow(df.filter("a > 5")).types == {}


def test_feature_selection(spark):
    rng = np.random.default_rng(42)
    target = rng.integers(0, 2, 200)
    pdf = pd.DataFrame({"noise": rng.random(200), "good": target + rng.random(200) * 0.1, "target": target})
    pdf["copy"] = pdf.good * 2
    df = spark.createDataFrame(pdf)
    assert C.select_features(df, ["noise", "good", "copy"], "target", k=2) in (["good", "noise"], ["copy", "noise"])


def test_save_and_load(spark, data, monkeypatch):
    _, df = data
    monkeypatch.setattr(C, "INLINE_CODES", 1)
    for model in (C.fit_impute(df), C.fit_cap(df), C.fit_scale(df), C.fit_narrow(df), C.fit_encode(df, columns=["c", "id"])):
        path = scratch_path(spark, "model")
        C.save_model(model, spark, path)
        again = C.load_model(spark, path)
        assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, model.transform(df).collect()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string, c long")
    for fit in (C.fit_impute, C.fit_cap, C.fit_encode, C.fit_scale, C.fit_narrow):
        assert fit(empty).transform(empty).count() == 0
