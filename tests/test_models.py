"""Metrics on small vectors, model training and storage."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import customer_segment, risk_category
from plumbline.operators import evaluate as E
from plumbline.operators import models as M
from plumbline.plans.preprocess import PreprocessConfig, load_preprocess, preprocess
from plumbline.plans.run import BlueprintError, run_blueprint, stage_table
from plumbline.session import scratch_path
from plumbline.sources.tables import as_of_column, churn_base, churn_dirty, price_base, revenue_base

# Ten predictions in two groups, with one tie of scores.
TRUE, PRED = [1, 1, 0, 0, 1, 0, 1, 0, 0, 1], [1, 0, 0, 1, 1, 0, 1, 0, 1, 1]
PROBA = [0.95, 0.45, 0.05, 0.55, 0.85, 0.3, 0.65, 0.3, 0.75, 0.55]


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(list(zip(TRUE, PRED, PROBA, "AAAAABBBBB")), "y int, p int, s double, g string")


def test_classification_metrics(predictions):
    row = E.classification_metrics(predictions, "y", "p", "s").first()
    assert (row.accuracy, row.precision, row.recall) == (0.7, pytest.approx(4 / 6), 0.8)
    assert row.f1_score == pytest.approx(8 / 11)
    wins = sum((a > b) + (a == b) / 2 for a, y in zip(PROBA, TRUE) if y for b, z in zip(PROBA, TRUE) if not z)
    assert row.auc_roc == pytest.approx(wins / 25)
    # Equal scores are called positive together.
    total = 0.0
    for level in set(PROBA):
        called = [y for p, y in zip(PROBA, TRUE) if p >= level]
        total += sum(y for p, y in zip(PROBA, TRUE) if p == level) * sum(called) / len(called)
    assert row.auc_pr == pytest.approx(total / 5)


def test_confusion_business_and_fairness(predictions):
    assert E.confusion(predictions, "y", "p").first()[:] == (3, 2, 1, 4)
    business = E.business_metrics(predictions, "y", "p").first()
    assert business.total_cost == 2 * E.COST_FALSE_POSITIVE + E.COST_FALSE_NEGATIVE
    assert business.potential_revenue_saved == 4 * E.REVENUE_PER_CUSTOMER
    fair = E.fairness(predictions, "y", "p", "g").first()
    rates = {g: [(y, p) for y, p, k in zip(TRUE, PRED, "AAAAABBBBB") if k == g] for g in "AB"}
    share = {g: sum(p for _, p in r) / 5 for g, r in rates.items()}
    assert fair.demographic_parity == pytest.approx(abs(share["A"] - share["B"]))


def test_importance(spark):
    rows = [("orders", 0.05), ("balance", 0.5), ("nation", 0.15), ("segment", 0.3)]
    top = E.importance_table(spark.createDataFrame(rows, "feature string, importance double"), "feature", "importance", 3).collect()
    assert [r.feature for r in top] == ["balance", "segment", "nation"] and top[-1].cumulative_importance == pytest.approx(0.95)


def test_risk_and_segments(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.7,), (0.9,)], "p double")
    assert [r[0] for r in df.select(risk_category("p")).collect()] == ["Low", "Medium", "High", "Critical"]
    rows = spark.createDataFrame([(0, 5000.0), (1, 1000.0), (5, 10.0), (2, 10.0)], "n long, s double")
    assert [r[0] for r in rows.select(customer_segment("n", "s")).collect()] == ["new", "vip", "loyal", "regular"]


def test_train_score_store(spark):
    data = spark.range(300).select(
        (F.col("id") % 40).cast("double").alias("tenure"), (F.col("id") * 7 % 100 + 20).cast("double").alias("charges"),
    ).withColumn("y", ((F.col("tenure") < 12) & (F.col("charges") > 60)).cast("double"))
    store = M.ModelStore(spark, scratch_path(spark, "store"))
    with pytest.raises(ValueError):
        store.load("churn")
    for algorithm, extra in (("gradient_boosting", {"maxIter": 5}), ("random_forest", {"numTrees": 5}), ("logistic_regression", {})):
        model = M.train_classifier(data, ["tenure", "charges"], "y", algorithm, **extra)
        scored = M.score(model, data)
        assert scored.filter("churn_probability NOT BETWEEN 0 AND 1 OR churn_prediction NOT IN (0, 1)").count() == 0
        version = store.save("churn", model, {"algorithm": algorithm})
        assert M.feature_importance(spark, model).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert version == 3 and store.versions("churn").count() == 3
    assert M.score(store.load("churn"), data).count() == 300
    assert type(store.load("churn", 2).stages[-1]).__name__ == "RandomForestClassificationModel"
    with pytest.raises(ValueError):
        store.load("churn", 9)
    with pytest.raises(ValueError):
        M.score(model, data.drop("charges"))


def test_forecast_of_a_line(spark):
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (100 + F.col("id")).cast("double").alias("revenue"))
    row = M.revenue_forecast(days).first()
    assert row.forecast_30d == pytest.approx(sum(100 + d for d in range(60, 90))) and row.trend_analysis == "growth_detected"


def test_elasticity_of_a_power_law(spark):
    rows = [("a", p, int(round(10_000 * p**-2))) for p in (1.0, 2.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "product_id string, price double, quantity_sold long").withColumn("cost", F.lit(2.0))
    row = M.price_response(df, cost="cost").first()
    assert row.elasticity_coefficient == pytest.approx(-2.0) and row.optimal_price == pytest.approx(4.0)


SMALL = "/root/testdata/sf0.001"


def test_run_stops_where_it_should(spark):
    df = churn_dirty(spark, SMALL).fillna({"feature_usage_count": 0})
    done = run_blueprint(df, "customer_churn", as_of_column(), key="customer_id")
    assert [r.status for r in stage_table(df, done).collect()] == ["completed"] * 4
    assert done.table.count() == df.count() and done.row_errors.count() > 0
    with pytest.raises(BlueprintError):
        run_blueprint(df.drop("total_value"), "customer_churn", as_of_column())
    with pytest.raises(BlueprintError):
        run_blueprint(df, "customer_churn", as_of_column(), min_quality_score=99.0)


@pytest.mark.parametrize("config", [
    PreprocessConfig(missing_value_strategy="mode", outlier_method="zscore", encoding_strategy="label", scaling_method="standard"),
    PreprocessConfig(missing_value_strategy="drop", outlier_method="none", encoding_strategy="onehot", scaling_method="minmax"),
    PreprocessConfig(scaling_method="none", encoding_strategy="none", exact=False),
])
def test_preprocess_settings(spark, config):
    df = churn_dirty(spark, SMALL).drop("feature_usage_count")
    out, fitted = preprocess(df, "customer_churn", as_of_column(), config)
    assert out.count() > 0 and fitted.report


def test_fitted_steps_apply_to_new_rows(spark):
    df = churn_base(spark, SMALL)
    out, fitted = preprocess(df, "customer_churn", as_of_column())
    again = fitted.transform(df)
    assert sorted(again.columns) == sorted(out.columns)
    assert sorted(map(str, again.select(out.columns).collect())) == sorted(map(str, out.collect()))


@pytest.mark.parametrize("blueprint, make", [("customer_churn", churn_base), ("revenue_projection", revenue_base), ("price_optimization", price_base)])
def test_saved_chain_equals_the_fitted_one(spark, tmp_path, blueprint, make):
    df = make(spark, SMALL)
    out, fitted = preprocess(df, blueprint, as_of_column())
    fitted.save(spark, str(tmp_path / blueprint))
    loaded = load_preprocess(spark, str(tmp_path / blueprint), as_of_column())
    assert loaded.report == fitted.report
    again = loaded.transform(df)
    assert sorted(again.columns) == sorted(out.columns)
    assert sorted(map(str, again.select(out.columns).collect())) == sorted(map(str, out.collect()))


def test_tiers_of_new_rows_are_those_of_the_fit(spark):
    df = price_base(spark, SMALL)
    _, fitted = preprocess(df, "price_optimization", as_of_column(), PreprocessConfig(outlier_method="none"))
    dear = df.withColumn("price", F.col("price") + 10 * df.agg(F.max("price")).first()[0]).limit(20)
    out = fitted.transform(dear)
    assert out.filter("price_tier_high").count() == 20
