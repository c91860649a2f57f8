"""Feature sets of the three blueprints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import calendar_parts, elapsed_days, pct_change, plan_value_score, recency_score, safe_ratio
from plumbline.operators.quantiles import EXACT_LIMIT
from plumbline.operators.rank import TierModel, fit_tiers, percent_rank_average
from plumbline.operators.series import BLOCK_ROWS, growth, number, over_rows, rolling_mean, rolling_std

# Frame lengths and lags in rows, days per month and of the recency scale.
MEAN_ROWS = (7, 30, 90)
STD_ROWS = (7, 30)
LAGS = (1, 7, 30)
TREND_ROWS = 7
MONTH_DAYS = 30


def _churn_columns(df: DataFrame, as_of: Column) -> dict[str, Column]:
    """The features of a row that need no other row, in order; later ones use earlier ones."""
    have = set(df.columns)
    out: dict[str, Column] = {}
    if "last_activity_date" in have:
        out["days_since_last_activity"] = elapsed_days(as_of, "last_activity_date")
    if "account_created_date" in have:
        tenure = elapsed_days(as_of, "account_created_date")
        out["account_tenure_days"] = tenure
        if "total_value" in have:
            out["daily_value_rate"] = safe_ratio("total_value", tenure + 1)
        if "support_tickets" in have:
            out["support_intensity"] = safe_ratio("support_tickets", tenure / F.lit(MONTH_DAYS) + 1)
        if "feature_usage_count" in have:
            out["feature_usage_rate"] = safe_ratio("feature_usage_count", tenure + 1)
    if "last_activity_date" in have:
        out["activity_recency_score"] = recency_score(out["days_since_last_activity"])
    return out


@dataclass
class ChurnFeatures:
    """Fitted value tiers and the largest engagement components; applying them is a projection."""

    tiers: TierModel | None = None
    maxima: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame, as_of: Column) -> DataFrame:
        out = df.withColumns(_churn_columns(df, as_of))
        extra: dict[str, Column] = {}
        if self.tiers is not None:
            extra["value_tier"] = self.tiers.expression()
        if "plan_type" in df.columns:
            extra["plan_value_score"] = plan_value_score("plan_type")
        parts = [F.col(c) / F.lit(m) for c, m in self.maxima.items()]
        if parts:
            given = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
            total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
            extra["engagement_score"] = F.try_divide(total, given)
        return out.withColumns(extra) if extra else out


def fit_churn_features(df: DataFrame, as_of: Column, *, key: str = "customer_id", exact_limit: int = EXACT_LIMIT) -> ChurnFeatures:
    """``engagement_score`` is the mean of the components over their maxima; a maximum not above 0 is left out."""
    model = ChurnFeatures()
    if "total_value" in df.columns:
        tie = key if key in df.columns else None
        model.tiers = fit_tiers(df, "total_value", 4, tie=tie, exact_limit=exact_limit)
    columns = _churn_columns(df, as_of)
    parts = [c for c in ("feature_usage_rate", "activity_recency_score") if c in columns]
    if parts:
        row = df.agg(*[F.max(columns[c]).alias(c) for c in parts]).first()
        model.maxima = {c: row[c] for c in parts if row[c] is not None and row[c] > 0}
    return model


def churn_features(df: DataFrame, as_of: Column, *, key: str = "customer_id") -> DataFrame:
    return fit_churn_features(df, as_of, key=key).transform(df, as_of)


def revenue_features(df: DataFrame, *, tie: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling means and deviations, growth rates and calendar parts of a revenue series.

    Frames count rows, not days. Growth looks through missing revenue to the last known value.
    """
    order = ["date", *(tie or [])]
    out = df.withColumns(calendar_parts("date"))
    def build(w):
        columns = {f"revenue_ma_{k}": rolling_mean("revenue", w, k) for k in MEAN_ROWS}
        columns |= {f"revenue_growth_{k}d": growth("_known", w, k) for k in LAGS}
        columns |= {f"revenue_volatility_{k}": rolling_std("revenue", w, k) for k in STD_ROWS}
        return columns

    known = {"_known": number("revenue")}
    return over_rows(out, [], order, max(*MEAN_ROWS, *LAGS), build, fill=known, block_rows=block_rows).drop("_known")


def fit_price_tiers(df: DataFrame, *, key: str = "product_id", tie: list[str] | None = None) -> TierModel:
    """Three tiers of price; ties are ordered by product, then by date."""
    order = [key, "date", *(tie or [])]
    return fit_tiers(df.select("price", *order), "price", 3, tie=order)


def price_features(
    df: DataFrame, *, key: str = "product_id", tie: list[str] | None = None, block_rows: int = BLOCK_ROWS, tiers: TierModel | None = None
) -> DataFrame:
    """Revenue, changes and trend per product, and the price's place among all prices. ``tiers`` may come from an earlier fit."""
    order = ["date", *(tie or [])]
    known = {"_price": number("price"), "_quantity": number("quantity_sold")}

    def build(w):
        return {
            "price_change": pct_change(F.col("_price"), F.lag("_price").over(w)),
            "quantity_change": pct_change(F.col("_quantity"), F.lag("_quantity").over(w)),
            "quantity_trend": rolling_mean("quantity_sold", w, TREND_ROWS),
        }

    series = over_rows(df, [key], order, TREND_ROWS, build, fill=known, block_rows=block_rows).drop("_price", "_quantity")
    tiers = tiers or fit_price_tiers(df, key=key, tie=tie)
    tiered = series.withColumns({
        "revenue": F.col("price") * F.col("quantity_sold"),
        "price_tier": tiers.expression(),
    })
    return percent_rank_average(tiered, "price", "price_percentile")
