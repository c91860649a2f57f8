"""Measures of scored tables, as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.rank import running_totals

# Costs of wrong predictions and the revenue of a customer.
COST_FALSE_POSITIVE, COST_FALSE_NEGATIVE, REVENUE_PER_CUSTOMER = 10.0, 100.0, 1000.0


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, actual: str, predicted: str, groups: list[str] | None = None) -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    return df.groupBy(*(groups or [])).agg(
        F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"), F.count_if(a & p).alias("tp"),
    )


def score_areas(df: DataFrame, actual: str, score: str) -> DataFrame:
    """One row: ROC area by mean ranks, and average precision over falling scores.

    Rows are counted per distinct score first, so scores shared by many rows do not gather them.
    """
    a = F.col(actual) == 1
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(a).alias("pos"), F.count_if(~a).alias("neg")
    )
    totals = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    placed = running_totals(counts, "score", ["pos", "neg"]).crossJoin(F.broadcast(totals))
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    hits = F.col("all_pos") - F.col("pos_before")  # positives at this score or above
    called = hits + F.col("all_neg") - F.col("neg_before")
    return placed.agg(
        F.sum(wins).alias("wins"),
        F.sum(F.col("pos").cast("double") * hits / called).alias("precision_sum"),
        F.max("all_pos").alias("all_pos"),
        F.max("all_neg").alias("all_neg"),
    ).select(
        F.try_divide(F.col("wins"), F.col("all_pos") * F.col("all_neg").cast("double")).alias("auc_roc"),
        F.try_divide(F.col("precision_sum"), F.col("all_pos").cast("double")).alias("auc_pr"),
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str, score: str) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    base = confusion(df, actual, predicted).select(
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )
    return base.crossJoin(F.broadcast(score_areas(df, actual, score)))  # one row each


def business_metrics(
    df: DataFrame, actual: str, predicted: str, cost_false_positive: float = COST_FALSE_POSITIVE,
    cost_false_negative: float = COST_FALSE_NEGATIVE, revenue_per_customer: float = REVENUE_PER_CUSTOMER,
) -> DataFrame:
    """Cost of wrong predictions, revenue of the positives found, and the gain over the cost."""
    cost = F.col("fp") * F.lit(cost_false_positive) + F.col("fn") * F.lit(cost_false_negative)
    saved = F.col("tp") * F.lit(revenue_per_customer)
    return confusion(df, actual, predicted).select(
        cost.alias("total_cost"), saved.alias("potential_revenue_saved"), F.try_divide(saved - cost, cost).alias("roi")
    )


def group_rates(df: DataFrame, actual: str, predicted: str, group: str) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, actual, predicted, [group]).select(
        group,
        _ratio(tp + fp, tp + fp + tn + fn).alias("selection_rate"),
        F.try_divide(tp.cast("double"), (tp + fn).cast("double")).alias("true_positive_rate"),
        F.try_divide(fp.cast("double"), (fp + tn).cast("double")).alias("false_positive_rate"),
        F.try_divide(tp.cast("double"), (tp + fp).cast("double")).alias("positive_predictive_value"),
    )


def fairness(df: DataFrame, actual: str, predicted: str, group: str) -> DataFrame:
    """Largest differences between groups: selection rate, error rates and predictive value."""
    def gap(c: str) -> Column:
        return F.max(c) - F.min(c)

    return group_rates(df, actual, predicted, group).agg(
        gap("selection_rate").alias("demographic_parity"),
        F.greatest(gap("true_positive_rate"), gap("false_positive_rate")).alias("equalized_odds"),
        gap("positive_predictive_value").alias("calibration"),
    )


def importance_table(importances: DataFrame, feature: str, importance: str, k: int | None = None) -> DataFrame:
    """Features by falling importance with the running share. One row per feature of a model."""
    order = W.orderBy(F.desc(importance), feature)
    total = F.sum(importance).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = importances.withColumns({"position": F.row_number().over(order), "cumulative_importance": total})
    return out if k is None else out.filter(F.col("position") <= k)
