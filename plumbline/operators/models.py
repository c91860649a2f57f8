"""Training and scoring with Spark ML, and closed-form revenue and price models."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import risk_category

# The boosted-tree settings and the forecast horizons in days.
TREES, DEPTH, RATE, SEED = 100, 5, 0.1, 42
HORIZONS = (30, 90)
Z_95 = 1.96
SEASONAL_SHARE = 0.05


def _classifier(algorithm: str, label: str, **params):
    common = {"labelCol": label, "featuresCol": "features"}
    if algorithm == "gradient_boosting":
        return GBTClassifier(**{**common, "maxIter": TREES, "maxDepth": DEPTH, "stepSize": RATE, "seed": SEED, **params})
    if algorithm == "random_forest":
        return RandomForestClassifier(**{**common, "numTrees": TREES, "maxDepth": DEPTH, "seed": SEED, **params})
    if algorithm == "logistic_regression":
        return LogisticRegression(**{**common, **params})
    raise ValueError(f"unknown algorithm: {algorithm}")


def _stages(features: Sequence[str], classifier) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, classifier])


def train_classifier(df: DataFrame, features: Sequence[str], label: str, algorithm: str = "gradient_boosting", **params) -> PipelineModel:
    data = df.select(*features, F.col(label).cast("double").alias(label))
    return _stages(features, _classifier(algorithm, label, **params)).fit(data)


def cross_validate(
    df: DataFrame, features: Sequence[str], label: str, algorithm: str = "gradient_boosting",
    grid: dict[str, Sequence] | None = None, folds: int = 3, parallelism: int = 2, **params,
) -> tuple[PipelineModel, DataFrame]:
    """The best model of a grid by ROC area over ``folds`` folds, and the mean score of each setting."""
    classifier = _classifier(algorithm, label, **params)
    builder = ParamGridBuilder()
    for name, values in (grid or {}).items():
        builder = builder.addGrid(classifier.getParam(name), list(values))
    settings = builder.build()
    validator = CrossValidator(
        estimator=_stages(features, classifier), estimatorParamMaps=settings,
        evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=SEED, parallelism=parallelism,
    )
    fitted = validator.fit(df.select(*features, F.col(label).cast("double").alias(label)))
    rows = [
        (json.dumps({p.name: v for p, v in setting.items()}, sort_keys=True), float(score))
        for setting, score in zip(settings, fitted.avgMetrics)
    ]
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, "setting string, auc_roc double")


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row per feature: tree importances, or coefficient sizes of a linear model as shares."""
    names = model.stages[0].getInputCols()
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = abs(last.coefficients.toArray())
        values = values / (values.sum() or 1.0)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add probability, prediction, risk category and confidence."""
    missing = [c for c in model.stages[0].getInputCols() if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    p = vector_to_array("probability")[1]
    scored = model.transform(df).withColumn("churn_probability", p)
    return scored.withColumns({
        "churn_prediction": F.col("prediction").cast("int"),
        "risk_category": risk_category("churn_probability"),
        "confidence": F.greatest(F.col("churn_probability"), 1 - F.col("churn_probability")),
    }).drop("features", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class ModelStore:
    """Models in versioned folders of a shared path, with a table of their metadata."""

    spark: SparkSession
    root: str

    def _index(self) -> str:
        return f"{self.root}/index"

    def _rows(self, name: str) -> DataFrame:
        schema = "name string, version int, metadata string, folder string"
        return self.spark.read.schema(schema).json(f"{self._index()}/*.json").filter(F.col("name") == name)

    def versions(self, name: str) -> DataFrame:
        return self._rows(name).drop("folder")

    def _latest(self, name: str) -> int:
        from pyspark.errors import AnalysisException

        try:
            return self.versions(name).agg(F.max("version")).first()[0] or 0
        except AnalysisException:  # nothing saved yet
            return 0

    def save(self, name: str, model: PipelineModel, metadata: dict | None = None) -> int:
        """Store a model under a number. Every model has a folder of its own, so two writers never overwrite each other;
        if they take the same number, the one whose folder sorts first is meant by it."""
        version, folder = self._latest(name) + 1, uuid.uuid4().hex
        model.write().save(f"{self.root}/models/{name}/{folder}")
        columns = "name string, version int, metadata string, folder string"
        row = self.spark.createDataFrame([(name, version, json.dumps(metadata or {}), folder)], columns)
        row.coalesce(1).write.mode("append").json(self._index())
        return version

    def load(self, name: str, version: int | None = None) -> PipelineModel:
        version = version or self._latest(name)
        if not version:
            raise ValueError(f"no saved model: {name}")
        row = self._rows(name).filter(F.col("version") == version).orderBy("folder").first()
        if row is None:
            raise ValueError(f"no version {version} of {name}")
        return PipelineModel.load(f"{self.root}/models/{name}/{row['folder']}")


def churn_outlook(df: DataFrame, probability: str, horizon_days: int = 30) -> DataFrame:
    """Risk class, expected days until churn and the measures to take, from a probability.

    The window is the horizon times the chance of staying; measures follow the risk class.
    """
    risk = F.lower(risk_category(probability))
    measures = (
        F.when(risk == "critical", "immediate_outreach,retention_offer")
        .when(risk == "high", "engagement_campaign,retention_offer")
        .when(risk == "medium", "engagement_campaign")
        .otherwise("none")
    )
    return df.withColumns({
        "risk_classification": risk,
        "estimated_churn_window": F.ceil(F.lit(horizon_days) * (1 - F.col(probability))).cast("bigint"),
        "intervention_protocols": measures,
    })


def revenue_forecast(daily: DataFrame, date: str = "date", revenue: str = "revenue") -> DataFrame:
    """One row: totals forecast by the linear trend, the 30-day interval, trend and weekly seasonality.

    Two aggregations over the daily series. Seasonality means that weekday means explain at least
    ``SEASONAL_SHARE`` of the variance.
    """
    day = F.unix_date(F.col(date).cast("date")).cast("double")
    data = daily.select(day.alias("x"), F.col(revenue).cast("double").alias("y"), F.weekday(F.col(date)).alias("dow"))
    fit = data.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.max("x").alias("last"), F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("variance"),
        F.regr_r2("y", "x").alias("r2"),
    )
    weekdays = data.groupBy("dow").agg(F.count("y").alias("n_dow"), F.avg("y").alias("mean_dow"))
    between = (
        weekdays.crossJoin(F.broadcast(fit.select("n", "mean")))
        .agg(F.sum(F.col("n_dow") * F.pow(F.col("mean_dow") - F.col("mean"), F.lit(2.0)) / F.col("n")).alias("between"))
    )
    out = fit.crossJoin(F.broadcast(between))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("variance") * (1 - F.col("r2"))))
    totals = {}
    for h in HORIZONS:
        # The sum of the trend line over days last+1 … last+h.
        totals[f"forecast_{h}d"] = h * F.col("intercept") + F.col("slope") * (h * F.col("last") + h * (h + 1) / 2.0)
    reach = Z_95 * deviation * (HORIZONS[0] ** 0.5)
    trend = F.when(F.col("slope") > 0, "growth_detected").when(F.col("slope") < 0, "decline_detected").otherwise("flat")
    return out.select(
        *[c.alias(name) for name, c in totals.items()],
        (totals["forecast_30d"] - reach).alias("confidence_low"),
        (totals["forecast_30d"] + reach).alias("confidence_high"),
        trend.alias("trend_analysis"),
        (F.try_divide(F.col("between"), F.col("variance")) >= SEASONAL_SHARE).alias("seasonality_flag"),
    )


def price_response(df: DataFrame, *, key: str = "product_id", price: str = "price", quantity: str = "quantity_sold", cost: str | None = None) -> DataFrame:
    """Elasticity per product from a log-log regression, and the price it recommends.

    With a unit cost and elasticity below -1 the optimum has a closed form; otherwise the observed price
    with the highest revenue is taken. Impacts compare with the mean price under constant elasticity.
    """
    p, q = F.col(price).cast("double"), F.col(quantity).cast("double")
    positive = (p > 0) & (q > 0)
    aggregates = [
        F.regr_slope(F.when(positive, F.ln(q)), F.when(positive, F.ln(p))).alias("elasticity_coefficient"),
        F.avg(p).alias("mean_price"),
        F.max(F.struct((p * q).alias("revenue"), p.alias("price")))["price"].alias("best_observed"),
    ]
    if cost:
        aggregates.append(F.avg(cost).alias("unit_cost"))
    fit = df.groupBy(key).agg(*aggregates)
    e = F.col("elasticity_coefficient")
    if cost:
        optimum = F.when(e < -1, F.col("unit_cost") * e / (e + 1)).otherwise(F.col("best_observed"))
    else:
        optimum = F.col("best_observed")
    ratio = F.col("optimal_price") / F.nullif(F.col("mean_price"), F.lit(0.0))
    return fit.withColumn("optimal_price", optimum).select(
        key,
        "optimal_price",
        "elasticity_coefficient",
        (100 * (F.pow(ratio, e + 1) - 1)).alias("revenue_impact"),
        (100 * (F.pow(ratio, e) - 1)).alias("volume_impact"),
    )


def composite_score(tables: Sequence[tuple[DataFrame, str, float]], key: str) -> DataFrame:
    """Weighted sum of score columns of several tables that are unique on ``key``; a missing score is 0."""
    out = None
    for i, (table, column, _) in enumerate(tables):
        part = table.select(key, F.col(column).cast("double").alias(f"_s{i}"))
        out = part if out is None else out.join(part, key, "full_outer")
    weights = sum(w for _, _, w in tables)
    total = sum((F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) * F.lit(float(w)) for i, (_, _, w) in enumerate(tables)), F.lit(0.0))
    return out.select(key, (total / F.lit(float(weights))).alias("composite_score"))

