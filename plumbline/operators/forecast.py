"""Forecasts of many daily series: trend and weekday effects in closed form, intervals from a backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z_95 = 1.96


def decompose(days: DataFrame, trained: Column) -> DataFrame:
    """Per series (column ``series``), from the rows where ``trained``: ``slope``, ``intercept`` and ``effects``, an array of the mean
    distance of each weekday (Monday first) from the trend.

    One aggregation: the mean distance from a line follows from the means of day and value. A weekday without rows has
    no effect, a series with one day has a level and no slope, and one without any has neither.
    """
    x, y = F.when(trained, F.col("x")), F.when(trained, F.col("y"))
    per_weekday = days.groupBy("series", "dow").agg(
        F.count(y).alias("n"), F.sum(F.when(y.isNotNull(), x)).alias("sx"), F.sum(y).alias("sy"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"),
    ).where("n > 0")
    # Moments of a series are those inside its weekdays and between them.
    rows = F.collect_list(F.struct("dow", "n", "sx", "sy", "sxx", "sxy"))
    series = per_weekday.groupBy("series").agg(rows.alias("w"), F.sum("n").alias("n"), (F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my"))

    def total(term) -> Column:
        return F.aggregate("w", F.lit(0.0), lambda a, w: a + term(w, w["sx"] / w["n"] - F.col("mx"), w["sy"] / w["n"] - F.col("my")))

    moments = series.withColumns({
        "sxx": total(lambda w, dx, dy: w["sxx"] + w["n"] * dx * dx), "sxy": total(lambda w, dx, dy: w["sxy"] + w["n"] * dx * dy),
    })
    slope = F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0))
    fitted = moments.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    effects = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.coalesce(F.aggregate(
        "w", F.lit(None).cast("double"),
        lambda a, w: F.when(w["dow"] == d, w["sy"] / w["n"] - F.col("intercept") - F.col("slope") * w["sx"] / w["n"]).otherwise(a),
    ), F.lit(0.0)))
    return fitted.select("series", "slope", "intercept", effects.alias("effects"))


def seasonal_forecast(daily: DataFrame, series: str, date: str, value: str, horizon: int = 28) -> DataFrame:
    """``horizon`` days after the last day of each series: ``series``, ``date``, ``forecast``, ``low``, ``high`` and ``coverage``.

    The forecast is the trend line plus the weekday's effect. For the interval the same model is fitted without the
    last ``horizon`` days and held against them: ``low`` and ``high`` are 1.96 times the root of the mean squared
    error there away. ``coverage`` is the share of the held-out days that the interval of the fit itself (from the residuals
    of the days it has seen) would have held, so 0.95 means that the model can be taken at its word.

    A series needs one row a day; rows without date or value are left out, days may be missing. Where no day lies
    before the held-out ones, the interval and the coverage are NULL.
    """
    days = daily.select(
        F.col(series).alias("series"), F.unix_date(F.col(date).cast("date")).cast("double").alias("x"), F.col(value).cast("double").alias("y"),
        F.weekday(F.col(date)).alias("dow"),
    ).where("x is not null and y is not null")
    def joined(left: DataFrame, fit: DataFrame, how: str = "left") -> DataFrame:
        fit = fit.withColumnRenamed("series", "_fitted")
        return left.join(fit, F.col("series").eqNullSafe(F.col("_fitted")), how).drop("_fitted")

    last = days.groupBy("series").agg(F.max("x").alias("last"))
    days = joined(days, last)
    held_out = F.col("x") > F.col("last") - horizon

    def predicted(slope: str, intercept: str, effects: str, x: Column, dow: Column) -> Column:
        return F.col(intercept) + F.col(slope) * x + F.get(effects, dow)

    tested = joined(days, decompose(days, ~held_out)).withColumn("error", F.col("y") - predicted("slope", "intercept", "effects", F.col("x"), F.col("dow")))
    errors = tested.groupBy("series").agg(
        F.sqrt(F.avg(F.when(held_out, F.col("error") ** 2))).alias("spread"),
        F.sqrt(F.avg(F.when(~held_out, F.col("error") ** 2))).alias("own"),
        F.collect_list(F.when(held_out, F.abs("error"))).alias("held"),
    ).select("series", "spread", F.try_divide(F.size(F.filter("held", lambda e: e <= Z_95 * F.col("own"))), F.size("held")).alias("coverage"))
    out = joined(joined(last, decompose(days, F.lit(True)), "inner"), errors)
    ahead = out.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("x", F.col("x") + F.col("last"))
    day = F.date_from_unix_date(F.col("x").cast("int"))
    forecast = ahead.withColumn("date", day).withColumn("forecast", predicted("slope", "intercept", "effects", F.col("x"), F.weekday("date")))
    reach = Z_95 * F.col("spread")
    return forecast.select(
        F.col("series").alias(series), "date", "forecast", (F.col("forecast") - reach).alias("low"), (F.col("forecast") + reach).alias("high"), "coverage",
    )


def pooled_elasticity(df: DataFrame, *, key: str = "product_id", price: str = "price", quantity: str = "quantity_sold") -> DataFrame:
    """Price elasticity of every product, drawn to the common one as far as its own observations are few.

    Two aggregations: log-log moments of each product, then sums over the products. With the pooled residual variance s, a product's own
    slope has the variance v = s / Sxx. Slopes vary about the common slope (their mean by precision) by t, estimated
    from their spread beyond what the v explain (method of moments). The pooled slope is (t * own + v * common) / (t + v).

    ``own_elasticity`` is NULL where prices do not vary, and such a product takes the common slope. ``weight`` is t / (t + v),
    the share of the own slope. Without any product of three sales s is unknown and taken as 0: own slopes are kept.
    Sales without a positive price and quantity don't count.
    """
    p, q = F.col(price).cast("double"), F.col(quantity).cast("double")
    sold = (p > 0) & (q > 0)
    x, y = F.when(sold, F.ln(p)), F.when(sold, F.ln(q))
    own = df.groupBy(key).agg(
        F.count(F.when(sold, 1)).alias("n_sales"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"),
    )
    varied = F.col("sxx") > 1e-9
    own = own.withColumn("own_elasticity", F.when(varied, F.try_divide("sxy", "sxx")))
    b, sxx = F.col("own_elasticity"), F.when(varied, F.col("sxx"))
    sums = own.agg(
        F.sum(sxx).alias("a"), F.sum(sxx * b).alias("ab"), F.sum(sxx * b * b).alias("abb"), F.sum(sxx * sxx).alias("aa"), F.count(b).alias("k"),
        F.sum(F.when(varied & (F.col("n_sales") > 2), F.greatest(F.lit(0.0), F.col("syy") - b * F.col("sxy")))).alias("sse"),
        F.sum(F.when(varied & (F.col("n_sales") > 2), F.col("n_sales") - 2)).alias("free"),
    )
    noise = F.coalesce(F.try_divide("sse", "free"), F.lit(0.0))
    common = F.try_divide("ab", "a")
    spread = F.try_divide(F.col("abb") - common * F.col("ab") - noise * (F.col("k") - 1), F.col("a") - F.try_divide("aa", "a"))
    pool = sums.select(noise.alias("s"), common.alias("common_elasticity"), F.greatest(F.lit(0.0), F.coalesce(spread, F.lit(0.0))).alias("t"))
    out = own.crossJoin(F.broadcast(pool))  # one row
    v = F.try_divide("s", "sxx")
    weight = F.when(b.isNull(), 0.0).when(F.col("s") == 0, 1.0).otherwise(F.col("t") / (F.col("t") + v))
    out = out.withColumn("weight", weight)
    pooled = F.when(b.isNull(), F.col("common_elasticity")).otherwise(F.col("weight") * b + (1 - F.col("weight")) * F.col("common_elasticity"))
    return out.select(key, "n_sales", "own_elasticity", "common_elasticity", "weight", pooled.alias("elasticity_coefficient"))
