"""Cleaning steps, ranks, series and the blueprint feature sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import datetime_parts, elapsed_days, pct_change, plan_value_score, recency_score
from plumbline.operators import clean as C
from plumbline.operators.features import churn_features, price_features, revenue_features
from plumbline.operators.neighbours import nearest_fill
from plumbline.operators.quality import Completeness, Domain, Range
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.rank import fit_tiers, percent_rank_average
from plumbline.operators.series import (
    fill_forward, growth, keep_first, over_rows, rolling_mean, rolling_std, session_durations,
)
from plumbline.plans.landing import process_landing
from plumbline.plans.preprocess import PreprocessConfig, load_preprocess, mixed_preprocess, preprocess, report_table
from plumbline.plans.run import run_blueprint
from plumbline.session import materialise, scratch_path
from plumbline.queries.registry import AS_OF_SQL, days_sql, query, ratio_sql, rounded
from plumbline.sources.tables import (
    CHURN_BASE_SQL, CHURN_DIRTY_SQL, PLANS_SQL, PRICE_BASE_SQL, REVENUE_BASE_SQL, as_of_column, churn_base, churn_dirty,
    price_base, revenue_base, table, user_events,
)

TIER4 = "['low', 'medium', 'high', 'premium']"
TIER3 = "['low', 'medium', 'high']"


def tier_sql(rn: str, n: str, q: int, labels: str, value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL WHEN {n} = 1 THEN 'low' ELSE ({labels})[greatest(1, CAST((({rn} - 1) * {q} + ({n} - 1) - 1) // ({n} - 1) AS INTEGER))] END"


def churn_features_sql(base: str, prefix: str = "") -> str:
    """CTEs that end in ``{prefix}feat`` with all columns and features."""
    p = prefix
    return f"""
{p}fb AS (SELECT *, {days_sql(AS_OF_SQL, 'last_activity_date')} AS days_since_last_activity, {days_sql(AS_OF_SQL, 'account_created_date')} AS account_tenure_days,
  row_number() OVER (ORDER BY total_value, customer_id) AS rn, count(total_value) OVER () AS n FROM {base}),
{p}fc AS (SELECT *, {ratio_sql('total_value', 'account_tenure_days + 1')} AS daily_value_rate,
  {ratio_sql('support_tickets', 'account_tenure_days / 30 + 1')} AS support_intensity,
  {ratio_sql('feature_usage_count', 'account_tenure_days + 1')} AS feature_usage_rate,
  exp(-CAST(days_since_last_activity AS DOUBLE) / 30) AS activity_recency_score FROM {p}fb),
{p}feat AS (SELECT * EXCLUDE (rn, n), {tier_sql('rn', 'n', 4, TIER4, 'total_value')} AS value_tier,
  CAST({PLANS_SQL} AS INTEGER) AS plan_value_score,
  (coalesce(feature_usage_rate / max(feature_usage_rate) OVER (), 0) + coalesce(activity_recency_score / max(activity_recency_score) OVER (), 0))
   / nullif((feature_usage_rate IS NOT NULL)::INT + (activity_recency_score IS NOT NULL)::INT, 0) AS engagement_score FROM {p}fc)"""


CHURN_RATIOS = ["daily_value_rate", "support_intensity", "feature_usage_rate", "activity_recency_score", "engagement_score"]
CHURN_OUT = ["customer_id", "days_since_last_activity", "account_tenure_days", "value_tier", "plan_value_score", *CHURN_RATIOS]


def rounds(columns, digits=6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query("churn_features", f"WITH b AS ({CHURN_BASE_SQL}), {churn_features_sql('b')} SELECT customer_id, days_since_last_activity, account_tenure_days, value_tier, plan_value_score, {rounds(CHURN_RATIOS)} FROM feat")
def churn_features_query(spark, sf):
    return rounded(churn_features(materialise(churn_base(spark, sf), "churn"), as_of_column()).select(*CHURN_OUT), CHURN_RATIOS)


MEANS = ["revenue_ma_7", "revenue_ma_30", "revenue_ma_90"]
GROWTHS = ["revenue_growth_1d", "revenue_growth_7d", "revenue_growth_30d"]
VOLATILITIES = ["revenue_volatility_7", "revenue_volatility_30"]
PARTS_SQL = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
  CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend"""


def growth_sql(column: str, lag: int, over: str) -> str:
    prev = f"lag({column}, {lag}) OVER ({over})"
    return f"CASE WHEN {prev} IS NULL OR {column} IS NULL THEN 0.0 WHEN {prev} = 0 AND {column} = 0 THEN 0.0 WHEN {prev} = 0 THEN CASE WHEN {column} > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END ELSE {column} / {prev} - 1 END"


REVENUE_FEATURES_SQL = f"""
SELECT date, {PARTS_SQL}, {", ".join(f"round(avg(revenue) OVER (ORDER BY date ROWS {k - 1} PRECEDING), 4) AS revenue_ma_{k}" for k in (7, 30, 90))},
  {", ".join(f"round({growth_sql('revenue', k, 'ORDER BY date')}, 6) AS revenue_growth_{k}d" for k in (1, 7, 30))},
  {", ".join(f"round(coalesce(stddev_samp(revenue) OVER (ORDER BY date ROWS {k - 1} PRECEDING), 0.0), 4) AS revenue_volatility_{k}" for k in (7, 30))}
FROM ({REVENUE_BASE_SQL})"""


@query("revenue_features", REVENUE_FEATURES_SQL)
def revenue_features_query(spark, sf):
    out = revenue_features(materialise(revenue_base(spark, sf), "revenue")).drop("revenue", "customer_count")
    return rounded(rounded(out, [*MEANS, *VOLATILITIES], 4), GROWTHS)


PRICE_FEATURES_SQL = f"""
WITH b AS ({PRICE_BASE_SQL}), s AS (SELECT *, price * quantity_sold AS revenue,
  {growth_sql('price', 1, 'PARTITION BY product_id ORDER BY date')} AS price_change,
  {growth_sql('CAST(quantity_sold AS DOUBLE)', 1, 'PARTITION BY product_id ORDER BY date')} AS quantity_change,
  avg(quantity_sold) OVER (PARTITION BY product_id ORDER BY date ROWS 6 PRECEDING) AS quantity_trend,
  (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0) / count(*) OVER () AS price_percentile,
  row_number() OVER (ORDER BY price, product_id, date) AS rn, count(*) OVER () AS n FROM b)
SELECT product_id, date, round(revenue, 8) AS revenue, round(price_change, 6) AS price_change, round(quantity_change, 6) AS quantity_change,
  round(quantity_trend, 6) AS quantity_trend, round(price_percentile, 6) AS price_percentile, {tier_sql('rn', 'n', 3, TIER3, 'price')} AS price_tier FROM s"""


@query("price_features", PRICE_FEATURES_SQL)
def price_features_query(spark, sf):
    out = price_features(materialise(price_base(spark, sf), "price")).drop("price", "quantity_sold")
    return rounded(rounded(out, ["revenue"], 8), ["price_change", "quantity_change", "quantity_trend", "price_percentile"])


# --- windows ------------------------------------------------------------------------------------

def daily_nulls(spark, sf):
    """The daily series with every 9th day missing and every 31st day at zero."""
    day = F.unix_date("date")
    revenue = F.when(day % 9 == 0, None).when(day % 31 == 0, 0.0).otherwise(F.col("revenue"))
    return revenue_base(spark, sf).select("date", revenue.alias("revenue"))


DAILY_NULLS_SQL = f"""SELECT date, CASE WHEN datediff('day', DATE '1970-01-01', date) % 9 = 0 THEN NULL
  WHEN datediff('day', DATE '1970-01-01', date) % 31 = 0 THEN 0.0 ELSE revenue END AS revenue FROM ({REVENUE_BASE_SQL})"""


@query("window_rolling_mean", f"SELECT date, round(avg(revenue) OVER (ORDER BY date ROWS 6 PRECEDING), 4) AS ma_7, round(avg(revenue) OVER (ORDER BY date ROWS 89 PRECEDING), 4) AS ma_90 FROM ({DAILY_NULLS_SQL})")
def _(spark, sf):
    out = over_rows(daily_nulls(spark, sf), [], ["date"], 90, lambda w: {"ma_7": rolling_mean("revenue", w, 7), "ma_90": rolling_mean("revenue", w, 90)})
    return rounded(out.drop("revenue"), ["ma_7", "ma_90"], 4)


@query("window_rolling_std", f"SELECT date, round(coalesce(stddev_samp(revenue) OVER (ORDER BY date ROWS 6 PRECEDING), 0.0), 3) AS sd_7, round(coalesce(stddev_samp(revenue) OVER (ORDER BY date ROWS 29 PRECEDING), 0.0), 3) AS sd_30 FROM ({DAILY_NULLS_SQL})")
def _(spark, sf):
    out = over_rows(daily_nulls(spark, sf), [], ["date"], 30, lambda w: {"sd_7": rolling_std("revenue", w, 7), "sd_30": rolling_std("revenue", w, 30)})
    return rounded(out.drop("revenue"), ["sd_7", "sd_30"], 3)


FILLED_SQL = f"SELECT date, last_value(revenue IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS revenue FROM ({DAILY_NULLS_SQL})"


@query("window_growth", f"SELECT date, round({growth_sql('revenue', 1, 'ORDER BY date')}, 6) AS growth_1, round({growth_sql('revenue', 7, 'ORDER BY date')}, 6) AS growth_7 FROM ({FILLED_SQL}) WHERE true")
def _(spark, sf):
    filled = fill_forward(daily_nulls(spark, sf), [], ["date"], {"known": F.col("revenue")})
    out = over_rows(filled, [], ["date"], 7, lambda w: {"growth_1": growth("known", w, 1), "growth_7": growth("known", w, 7)})
    return rounded(out.drop("revenue", "known"), ["growth_1", "growth_7"])


@query("window_product_change", f"SELECT product_id, date, round({growth_sql('price', 1, 'PARTITION BY product_id ORDER BY date')}, 6) AS price_change FROM ({PRICE_BASE_SQL})")
def _(spark, sf):
    out = over_rows(price_base(spark, sf), ["product_id"], ["date"], 1, lambda w: {"price_change": pct_change(F.col("price"), F.lag("price").over(w))})
    return rounded(out.select("product_id", "date", "price_change"), ["price_change"])


@query("window_product_trend", f"SELECT product_id, date, round(avg(quantity_sold) OVER (PARTITION BY product_id ORDER BY date ROWS 6 PRECEDING), 6) AS quantity_trend FROM ({PRICE_BASE_SQL})")
def _(spark, sf):
    out = over_rows(price_base(spark, sf), ["product_id"], ["date"], 7, lambda w: {"quantity_trend": rolling_mean("quantity_sold", w, 7)})
    return rounded(out.select("product_id", "date", "quantity_trend"), ["quantity_trend"])


@query("window_blocked_series", "SELECT o_orderkey, round(avg(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS 29 PRECEDING), 4) AS ma_30, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS last_urgent FROM orders")
def _(spark, sf):
    """The long-series way of rolling frames and fills, on every order in date order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    order = ["o_orderdate", "o_orderkey"]
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))
    filled = fill_forward(orders, [], order, {"last_urgent": urgent}, block_rows=2000)
    out = over_rows(filled, [], order, 30, lambda w: {"ma_30": rolling_mean("o_totalprice", w, 30)}, block_rows=2000)
    return rounded(out.select("o_orderkey", "ma_30", "last_urgent"), ["ma_30"], 4)


@query("rank_percentile", "SELECT l_orderkey, l_linenumber, l_partkey, round((rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0) / count(*) OVER (), 6) AS discount_rank FROM lineitem")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    return rounded(percent_rank_average(lines, "l_discount", "discount_rank").drop("l_discount"), ["discount_rank"])


@query("rank_tier4", f"WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {tier_sql('rn', 'n', 4, TIER4, 'o_totalprice')} AS tier FROM r")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", fit_tiers(orders, "o_totalprice", 4, tie="o_orderkey").expression().alias("tier"))


@query("rank_tier3_ties", f"WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM (SELECT event_id, floor(value / 10) AS value FROM events)) SELECT event_id, {tier_sql('rn', 'n', 3, TIER3, 'value')} AS tier FROM r")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.floor(F.col("value") / 10).alias("value"))
    return events.select("event_id", fit_tiers(events, "value", 3, tie="event_id", exact_limit=500).expression().alias("tier"))


@query("session_durations", """
WITH u AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' ELSE event_type END AS kind FROM events),
s AS (SELECT *, max(CASE WHEN kind = 'login' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_start FROM u WHERE kind IN ('login', 'logout'))
SELECT user_id, event_id, (epoch_us(ts) - epoch_us(session_start)) / 1000000 AS session_duration FROM s WHERE kind = 'logout' AND session_start IS NOT NULL""")
def _(spark, sf):
    return session_durations(user_events(table(spark, sf, "events"))).select("user_id", "event_id", "session_duration")


@query("keep_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def _(spark, sf):
    return keep_first(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# --- cleaning -------------------------------------------------------------------------------------

DIRTY = f"d AS ({CHURN_DIRTY_SQL})"
MODE_SQL = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def imputed_sql(source: str) -> str:
    """The auto strategy on the churn table: the mostly missing usage count goes."""
    mode = MODE_SQL.format(c="plan_type", t=source)
    return f"""SELECT customer_id,
  coalesce(last_activity_date, make_timestamp((SELECT CAST(trunc(quantile_cont(CAST(epoch_us(last_activity_date) AS DOUBLE), 0.5)) AS BIGINT) FROM {source}))) AS last_activity_date,
  coalesce(account_created_date, make_timestamp((SELECT CAST(trunc(quantile_cont(CAST(epoch_us(account_created_date) AS DOUBLE), 0.5)) AS BIGINT) FROM {source}))) AS account_created_date,
  coalesce(total_value, (SELECT quantile_cont(total_value, 0.5) FROM {source})) AS total_value,
  coalesce(CAST(support_tickets AS DOUBLE), (SELECT quantile_cont(support_tickets, 0.5) FROM {source})) AS support_tickets,
  coalesce(plan_type, {mode}) AS plan_type FROM {source}"""


@query("impute_auto", f"WITH {DIRTY} SELECT customer_id, last_activity_date, account_created_date, round(total_value, 4) AS total_value, support_tickets, plan_type FROM ({imputed_sql('d')})")
def _(spark, sf):
    df = materialise(churn_dirty(spark, sf), "churn")
    return rounded(C.fit_impute(df, "auto", skip=["customer_id"]).transform(df), ["total_value"], 4)


@query("impute_mean", f"WITH {DIRTY} SELECT customer_id, round(coalesce(total_value, (SELECT avg(total_value) FROM d)), 4) AS total_value, round(coalesce(support_tickets, (SELECT avg(support_tickets) FROM d)), 4) AS support_tickets, plan_type FROM d")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "total_value", "support_tickets", "plan_type")
    return rounded(C.fit_impute(df, "mean").transform(df), ["total_value", "support_tickets"], 4)


@query("impute_median", f"WITH {DIRTY} SELECT customer_id, round(coalesce(total_value, (SELECT quantile_cont(total_value, 0.5) FROM d)), 4) AS total_value, coalesce(CAST(support_tickets AS DOUBLE), (SELECT quantile_cont(support_tickets, 0.5) FROM d)) AS support_tickets, plan_type FROM d")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "total_value", "support_tickets", "plan_type")
    return rounded(C.fit_impute(df, "median").transform(df), ["total_value"], 4)


@query("impute_mode", f"WITH {DIRTY} SELECT customer_id, coalesce(CAST(support_tickets AS DOUBLE), {MODE_SQL.format(c='support_tickets', t='d')}) AS support_tickets, coalesce(plan_type, {MODE_SQL.format(c='plan_type', t='d')}) AS plan_type FROM d")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "support_tickets", "plan_type")
    return C.fit_impute(df, "mode").transform(df)


@query("impute_drop", f"WITH {DIRTY} SELECT customer_id, support_tickets, plan_type FROM d WHERE total_value IS NOT NULL AND support_tickets IS NOT NULL AND plan_type IS NOT NULL")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "total_value", "support_tickets", "plan_type")
    return C.fit_impute(df, "drop").transform(df).drop("total_value")


@query("impute_group_median", f"""
WITH {DIRTY}, g AS (SELECT plan_type, quantile_cont(total_value, 0.5) AS m FROM d WHERE total_value IS NOT NULL GROUP BY 1)
SELECT customer_id, round(coalesce(d.total_value, g.m, (SELECT quantile_cont(total_value, 0.5) FROM d)), 4) AS total_value
FROM (SELECT * REPLACE (coalesce(plan_type, 'none') AS plan_type) FROM d) d LEFT JOIN (SELECT coalesce(plan_type, 'none') AS plan_type, m FROM g) g USING (plan_type)""")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "total_value", F.coalesce("plan_type", F.lit("none")).alias("plan_type"))
    return rounded(C.group_median_impute(df, "total_value", ["plan_type"]).select("customer_id", "total_value"), ["total_value"], 4)


def bounds_sql(c: str, source: str, k: float = 1.5) -> str:
    return f"(SELECT quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {source})"


@query("cap_iqr", f"WITH {DIRTY} SELECT customer_id, round(CASE WHEN total_value IS NOT NULL THEN greatest(a.lo, least(a.hi, total_value)) END, 4) AS total_value, CASE WHEN support_tickets IS NOT NULL THEN greatest(b.lo, least(b.hi, CAST(support_tickets AS DOUBLE))) END AS support_tickets FROM d, {bounds_sql('total_value', 'd')} a, {bounds_sql('support_tickets', 'd')} b")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "total_value", "support_tickets")
    return rounded(C.fit_cap(df, "iqr").transform(df), ["total_value"], 4)


@query("cap_zscore", f"WITH {DIRTY} SELECT customer_id, round(CASE WHEN total_value IS NOT NULL THEN greatest(m - 3 * s, least(m + 3 * s, total_value)) END, 4) AS total_value FROM d, (SELECT avg(total_value) AS m, stddev_samp(total_value) AS s FROM d)")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "total_value")
    return rounded(C.fit_cap(df, "zscore").transform(df), ["total_value"], 4)


@query("cap_report", f"WITH {DIRTY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < any_lo OR {c} > any_hi) AS outliers, round(min(any_lo), 4) AS lower_bound, round(min(any_hi), 4) AS upper_bound FROM d, (SELECT lo AS any_lo, hi AS any_hi FROM {bounds_sql(c, 'd')})"
    for c in ("total_value", "support_tickets")))
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "total_value", "support_tickets")
    return rounded(C.fit_cap(df, "iqr").report(df), ["lower_bound", "upper_bound"], 4)


@query("encode_label", "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT coalesce(p_name, 'missing') AS value FROM (SELECT CASE WHEN p_partkey % 10 <> 0 THEN p_name || ' ' || p_size END AS p_name FROM part))) SELECT p_partkey, code AS p_name FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_name || ' ' || p_size END AS p_name FROM part) JOIN v ON value = coalesce(p_name, 'missing')")
def _(spark, sf):
    name = F.when(F.col("p_partkey") % 10 != 0, F.concat_ws(" ", "p_name", "p_size"))
    df = table(spark, sf, "part").select("p_partkey", name.alias("p_name"))
    return C.fit_encode(df, "auto").transform(df)


@query("encode_label_binary", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 WHEN o_orderpriority < '3' THEN 0 ELSE 2 END AS INTEGER) AS urgency FROM orders")
def _(spark, sf):
    urgency = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderpriority") < "3", "high").otherwise("normal")
    df = table(spark, sf, "orders").select("o_orderkey", urgency.alias("urgency"))
    return C.fit_encode(df, "auto").transform(df)


@query("encode_one_hot", f"WITH {DIRTY} SELECT customer_id, " + ", ".join(
    f"coalesce(p = '{v}', false) AS plan_type_{v}" for v in ("basic", "enterprise", "free", "gold", "premium", "trial")) + ", p IS NULL AS plan_type_nan FROM (SELECT customer_id, lower(trim(plan_type)) AS p FROM d)")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", F.lower(F.trim("plan_type")).alias("plan_type"))
    return C.fit_encode(df, "auto", skip=["customer_id"]).transform(df)


@query("encode_one_hot_unseen", f"WITH {DIRTY} SELECT customer_id, " + ", ".join(
    f"coalesce(p, 'unknown') = '{v}' AS plan_type_{v}" for v in ("enterprise", "free", "premium", "trial", "basic")) + " FROM (SELECT customer_id, lower(trim(plan_type)) AS p FROM d)")
def _(spark, sf):
    seen = churn_base(spark, sf).select("plan_type")
    df = churn_dirty(spark, sf).select("customer_id", F.lower(F.trim("plan_type")).alias("plan_type"))
    return C.fit_encode(seen, "onehot", fill="unknown", dummy_missing=False).transform(df)


@query("encode_target", """
WITH g AS (SELECT p_brand AS v, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY 1), m AS (SELECT avg(p_retailprice) AS m FROM part)
SELECT p_partkey, round((s + 10 * m) / (n + 10), 6) AS p_brand FROM part JOIN g ON v = p_brand, m""")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    out = C.fit_encode(df, "target", target="p_retailprice").transform(df)
    return rounded(out.select("p_partkey", "p_brand"), ["p_brand"])


def robust_sql(c: str, source: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.5) AS m, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s FROM {source})"


@query("scale_robust", f"SELECT l_orderkey, l_partkey, l_linenumber, round((l_extendedprice - a.m) / a.s, 6) AS l_extendedprice, round((l_discount - b.m) / b.s, 6) AS l_discount, is_returned FROM (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS is_returned FROM lineitem), {robust_sql('l_extendedprice', 'lineitem')} a, {robust_sql('l_discount', 'lineitem')} b")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("is_returned"))
    out = C.fit_scale(df, "robust", skip=["l_orderkey", "l_partkey", "l_linenumber"]).transform(df)
    return rounded(out, ["l_extendedprice", "l_discount"])


@query("scale_standard", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(C.fit_scale(df, "standard", skip=["p_partkey"]).transform(df), ["p_size", "p_retailprice"])


@query("scale_minmax", "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE), 6) AS p_size FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size")
    return rounded(C.fit_scale(df, "minmax", skip=["p_partkey"]).transform(df), ["p_size"])


@query("clip_outliers", f"SELECT event_id, round(greatest(lo, least(hi, v)), 4) AS value FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN value * 100 ELSE value END AS v FROM events), {bounds_sql('value', 'events')}")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    model = C.fit_cap(events, "iqr", columns=["value"])
    wild = events.withColumn("value", F.when(F.col("event_id") % 50 == 0, F.col("value") * 100).otherwise(F.col("value")))
    return rounded(model.transform(wild), ["value"], 4)


NEAR = ["total_value", "support_tickets", "usage"]
_PAIR = " + ".join(f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 0 ELSE (a.{c} - b.{c}) * (a.{c} - b.{c}) END" for c in NEAR)
_COMMON = " + ".join(f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 0 ELSE 1 END" for c in NEAR)


def near_sql(c: str) -> str:
    return f"""n_{c} AS (SELECT customer_id, avg(value) AS value FROM (
      SELECT a.customer_id, b.{c} AS value, ({_PAIR}) * 3 / ({_COMMON}) AS d, b.customer_id AS other
      FROM d a JOIN d b ON a.customer_id <> b.customer_id AND a.{c} IS NULL AND b.{c} IS NOT NULL AND ({_COMMON}) > 0
      QUALIFY row_number() OVER (PARTITION BY a.customer_id ORDER BY d, b.customer_id) <= 5) GROUP BY 1)"""


@query("impute_nearest", f"""
WITH d AS (SELECT customer_id, total_value / 1000 AS total_value, CAST(support_tickets AS DOUBLE) AS support_tickets,
  CASE WHEN CAST(customer_id AS BIGINT) % 4 <> 0 THEN total_value / 700 + CAST(customer_id AS BIGINT) % 9 END AS usage FROM ({CHURN_DIRTY_SQL})),
{", ".join(near_sql(c) for c in NEAR)}
SELECT d.customer_id, {", ".join(f"round(coalesce(d.{c}, n_{c}.value, (SELECT avg({c}) FROM d)), 6) AS {c}" for c in NEAR)}
FROM d {" ".join(f"LEFT JOIN n_{c} ON n_{c}.customer_id = d.customer_id" for c in NEAR)}""")
def _(spark, sf):
    """Missing values from the five nearest customers."""
    key = F.col("customer_id").cast("bigint")
    base = churn_dirty(spark, sf).select(
        "customer_id", (F.col("total_value") / 1000).alias("total_value"), F.col("support_tickets").cast("double").alias("support_tickets"),
        F.when(key % 4 != 0, F.col("total_value") / 700 + key % 9).alias("usage"),
    )
    return rounded(nearest_fill(base, "customer_id", NEAR), NEAR)


@query("feature_selection", """
WITH c AS (SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS feature, unnest([abs(corr(l_discount, r)), abs(corr(l_extendedprice, r)), abs(corr(l_quantity, r)), abs(corr(l_tax, r))]) AS strength
  FROM (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) AS r FROM lineitem))
SELECT feature FROM c ORDER BY strength DESC, feature LIMIT 2""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("r", (F.col("l_returnflag") == "R").cast("double"))
    chosen = C.select_features(df, ["l_discount", "l_extendedprice", "l_quantity", "l_tax"], "r", k=2)
    return df.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(c) for c in chosen])).alias("feature"))


def narrow_sql(c: str, t: str, kind: str) -> str:
    if kind == "int":
        rule = f"CASE WHEN min({c}) >= 0 THEN CASE WHEN max({c}) < 255 THEN 'smallint' WHEN max({c}) < 65535 THEN 'int' ELSE 'bigint' END WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
    else:
        rule = f"CASE WHEN bool_and(CAST(CAST({c} AS FLOAT) AS DOUBLE) = {c}) THEN 'float' ELSE 'double' END"
    return f"SELECT '{c}' AS \"column\", {rule} AS type FROM {t}"


@query("narrow_types", " UNION ALL ".join(narrow_sql(c, "lineitem", k) for c, k in (("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_quantity", "float"), ("l_extendedprice", "float"))))
def _(spark, sf):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    df = table(spark, sf, "lineitem").select(*columns)
    narrow = C.fit_narrow(df).transform(df)
    kinds = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in narrow.schema.fields])
    return narrow.agg(F.count("*").alias("n")).select(F.inline(kinds))


@query("narrow_values", "SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return C.fit_narrow(df, skip=["l_orderkey", "l_partkey"]).transform(df)


@query("exact_quantiles", """
SELECT 'l_extendedprice' AS "column", round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem
UNION ALL SELECT 'l_discount', round(quantile_cont(l_discount, 0.05), 4), round(quantile_cont(l_discount, 0.5), 4), round(quantile_cont(l_discount, 0.95), 4) FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    found = exact_quantiles(df, {c: [0.05, 0.5, 0.95] for c in ("l_extendedprice", "l_discount")}, exact_limit=5000)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.round(F.lit(v), 4).alias(n) for n, v in zip(("p05", "p50", "p95"), vs)])
        for c, vs in found.items()
    ])
    return df.agg(F.count("*").alias("n")).select(F.inline(rows))


@query("column_modes", f"WITH {DIRTY} SELECT 'plan_type' AS \"column\", {MODE_SQL.format(c='plan_type', t='d')} AS mode FROM (SELECT count(*) FROM d) UNION ALL SELECT 'support_tickets', CAST(CAST({MODE_SQL.format(c='support_tickets', t='d')} AS BIGINT) AS VARCHAR) FROM (SELECT count(*) FROM d)")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("plan_type", "support_tickets")
    found = C.modes(df, ["plan_type", "support_tickets"])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(v if isinstance(v, str) else str(int(v))).alias("mode")) for c, v in found.items()])
    return df.agg(F.count("*").alias("n")).select(F.inline(rows))


@query("drop_empty_columns", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("o_comment"), F.lit(float("nan")).alias("o_weight"))
    return C.drop_empty_columns(df)


@query("unique_columns", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return C.unique_columns(orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("o_custkey")))


@query("columns_by_type", "SELECT 'numeric' AS kind, sum(l_quantity) + sum(l_linenumber) AS total FROM lineitem UNION ALL SELECT 'text', CAST(sum(length(l_returnflag)) + sum(length(l_linestatus)) AS DOUBLE) FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")
    number = sum((F.sum(c) for c in C.numeric_columns(df)), F.lit(0))
    text = sum((F.sum(F.char_length(c)) for c in C.string_columns(df)), F.lit(0))
    row = df.agg(number.cast("double").alias("a"), text.cast("double").alias("b"))
    return row.select(F.inline(F.array(F.struct(F.lit("numeric").alias("kind"), F.col("a").alias("total")), F.struct(F.lit("text").alias("kind"), F.col("b").alias("total")))))


# --- scalar functions -----------------------------------------------------------------------------

@query("scalar_dates", f"""
SELECT o_orderkey, {days_sql(AS_OF_SQL, 'o_orderdate')} AS age_days, round(exp(-CAST({days_sql(AS_OF_SQL, 'o_orderdate')} AS DOUBLE) / 30), 9) AS recency,
  CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek, CAST(hour(o_orderdate) AS INTEGER) AS o_orderdate_hour FROM orders""")
def _(spark, sf):
    age = elapsed_days(as_of_column(), "o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", age.alias("age_days"), F.round(recency_score(age), 9).alias("recency"),
        *[c.alias(n) for n, c in datetime_parts("o_orderdate").items()],
    )


@query("scalar_plan_score", f"WITH {DIRTY} SELECT customer_id, CAST({PLANS_SQL} AS INTEGER) AS plan_value_score FROM d")
def _(spark, sf):
    return churn_dirty(spark, sf).select("customer_id", plan_value_score("plan_type").alias("plan_value_score"))


# --- whole chains ---------------------------------------------------------------------------------

NUMERIC_FEATURES = ["total_value", "support_tickets", "days_since_last_activity", "account_tenure_days", "plan_value_score", *CHURN_RATIOS]
CHAIN_SQL = f"""
WITH {DIRTY}, im AS ({imputed_sql('d')}),
cp AS (SELECT im.* REPLACE (greatest(a.lo, least(a.hi, total_value)) AS total_value, greatest(b.lo, least(b.hi, support_tickets)) AS support_tickets)
  FROM im, {bounds_sql('total_value', 'im')} a, {bounds_sql('support_tickets', 'im')} b),
cq AS (SELECT *, CAST(NULL AS BIGINT) AS feature_usage_count FROM cp),
{churn_features_sql('cq').replace('coalesce(feature_usage_rate / max(feature_usage_rate) OVER (), 0)', '0')}
"""
CHAIN_NUMBERS = [c for c in NUMERIC_FEATURES if c != "feature_usage_rate"]


def scaled_sql(c: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.5) AS {c}_m, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS {c}_s FROM feat)"


PREPROCESS_CHURN_SQL = (CHAIN_SQL + "SELECT customer_id, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 5) AS {c}" for c in CHAIN_NUMBERS)
       + ", " + ", ".join(f"value_tier = '{v}' AS value_tier_{v}" for v in ("low", "medium", "high", "premium"))
       + ", false AS value_tier_nan FROM feat, " + ", ".join(scaled_sql(c) for c in CHAIN_NUMBERS))


@query("preprocess_churn", PREPROCESS_CHURN_SQL)
def _(spark, sf):
    out, _ = preprocess(materialise(churn_dirty(spark, sf), "churn"), "customer_churn", as_of_column(), PreprocessConfig(narrow=False))
    tiers = [c for c in out.columns if c.startswith("value_tier_")]
    return rounded(out.select("customer_id", *CHAIN_NUMBERS, *tiers), CHAIN_NUMBERS, 5)


@query("preprocess_saved", PREPROCESS_CHURN_SQL)
def _(spark, sf):
    """The chain is fitted, stored, loaded and applied by what was stored alone."""
    df, path = materialise(churn_dirty(spark, sf), "churn"), scratch_path(spark, "chain")
    preprocess(df, "customer_churn", as_of_column(), PreprocessConfig(narrow=False))[1].save(spark, path)
    out = load_preprocess(spark, path, as_of_column()).transform(df)
    tiers = [c for c in out.columns if c.startswith("value_tier_")]
    return rounded(out.select("customer_id", *CHAIN_NUMBERS, *tiers), CHAIN_NUMBERS, 5)


def scale_all_sql(columns: list[str], source: str = "feat", digits: int = 5) -> tuple[str, str]:
    """The select list and the FROM items that scale columns by median and quartile distance."""
    picks = ", ".join(f"round(({c} - {c}_m) / {c}_s, {digits}) AS {c}" for c in columns)
    fits = ", ".join(scaled_sql(c).replace("FROM feat", f"FROM {source}") for c in columns)
    return picks, fits


REVENUE_SCALED = ["revenue", "customer_count", "day_of_week", "day_of_month", "day_of_year", "month", "quarter", *MEANS, *GROWTHS, *VOLATILITIES]
REVENUE_PICKS, REVENUE_FITS = scale_all_sql(REVENUE_SCALED)
REVENUE_WINDOWS = (
    ", ".join(f"avg(revenue) OVER (ORDER BY date ROWS {k - 1} PRECEDING) AS revenue_ma_{k}" for k in (7, 30, 90)) + ", "
    + ", ".join(f"{growth_sql('revenue', k, 'ORDER BY date')} AS revenue_growth_{k}d" for k in (1, 7, 30)) + ", "
    + ", ".join(f"coalesce(stddev_samp(revenue) OVER (ORDER BY date ROWS {k - 1} PRECEDING), 0.0) AS revenue_volatility_{k}" for k in (7, 30))
)


@query("preprocess_revenue", f"""
WITH b AS ({REVENUE_BASE_SQL}), cp AS (SELECT date, greatest(x.lo, least(x.hi, revenue)) AS revenue, greatest(y.lo, least(y.hi, customer_count)) AS customer_count
  FROM b, {bounds_sql('revenue', 'b')} x, {bounds_sql('customer_count', 'b')} y),
feat AS (SELECT *, {PARTS_SQL}, {REVENUE_WINDOWS} FROM cp)
SELECT date, is_weekend, {REVENUE_PICKS} FROM feat, {REVENUE_FITS}""")
def _(spark, sf):
    out, _ = preprocess(materialise(revenue_base(spark, sf), "revenue"), "revenue_projection", as_of_column(), PreprocessConfig(narrow=False))
    return rounded(out, REVENUE_SCALED, 5)


PRICE_SCALED = ["price", "quantity_sold", "price_change", "quantity_change", "quantity_trend", "revenue", "price_percentile"]
PRICE_PICKS, PRICE_FITS = scale_all_sql(PRICE_SCALED, digits=11)


@query("preprocess_price", f"""
WITH b AS ({PRICE_BASE_SQL}), cp AS (SELECT product_id, date, greatest(x.lo, least(x.hi, price)) AS price, greatest(y.lo, least(y.hi, CAST(quantity_sold AS DOUBLE))) AS quantity_sold
  FROM b, {bounds_sql('price', 'b')} x, {bounds_sql('quantity_sold', 'b')} y),
s AS (SELECT *, price * quantity_sold AS revenue, {growth_sql('price', 1, 'PARTITION BY product_id ORDER BY date')} AS price_change,
  {growth_sql('quantity_sold', 1, 'PARTITION BY product_id ORDER BY date')} AS quantity_change,
  avg(quantity_sold) OVER (PARTITION BY product_id ORDER BY date ROWS 6 PRECEDING) AS quantity_trend,
  (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0) / count(*) OVER () AS price_percentile,
  row_number() OVER (ORDER BY price, product_id, date) AS rn, count(*) OVER () AS n FROM cp),
feat AS (SELECT *, {tier_sql('rn', 'n', 3, TIER3, 'price')} AS t FROM s)
SELECT product_id, date, {PRICE_PICKS}, t = 'low' AS price_tier_low, t = 'medium' AS price_tier_medium, t = 'high' AS price_tier_high, t IS NULL AS price_tier_nan FROM feat, {PRICE_FITS}""")
def _(spark, sf):
    out, _ = preprocess(materialise(price_base(spark, sf), "price"), "price_optimization", as_of_column(), PreprocessConfig(narrow=False))
    return rounded(out, PRICE_SCALED, 11)


@query("preprocess_report")
def _(spark, sf):
    df = materialise(churn_dirty(spark, sf), "churn")
    return report_table(df, preprocess(df, "customer_churn", as_of_column())[1])


@query("preprocess_mixed_columns", """
WITH s AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS z, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS t FROM part),
b AS (SELECT quantile_cont(z, 0.25) AS q1, quantile_cont(z, 0.75) AS q3 FROM s)
SELECT p_partkey, round(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), z)), 6) AS num_p_size,
  coalesce(t, 'unknown') = 'ECONOMY' AS p_type_ECONOMY, coalesce(t, 'unknown') = 'STANDARD' AS p_type_STANDARD, coalesce(t, 'unknown') = 'unknown' AS p_type_unknown FROM s, b""")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("p_type"))
    out = mixed_preprocess(df, skip=["p_partkey"])
    return rounded(out.select("p_partkey", "num_p_size", "p_type_ECONOMY", "p_type_STANDARD", "p_type_unknown"), ["num_p_size"])


@query("blueprint_run")
def _(spark, sf):
    """Stage by stage outcome of a full run; the seconds are left out so that runs compare."""
    df = materialise(churn_dirty(spark, sf).fillna({"feature_usage_count": 0}), "churn")
    result = run_blueprint(df, "customer_churn", as_of_column(), rules=[Completeness(), Range({"total_value": (0, None)}), Domain({"plan_type": ["basic"]})])
    return spark.createDataFrame([(s, status, detail) for s, status, _, detail in result.stages], "stage string, status string, detail string")


@query("landing_ledger", f"""
SELECT CASE WHEN CAST(customer_id AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS part, 'customer_churn' AS blueprint, 'completed' AS status, count(*) AS n_rows
FROM ({CHURN_BASE_SQL}) WHERE last_activity_date IS NOT NULL GROUP BY 1
UNION ALL SELECT 'broken', 'customer_churn', 'failed', NULL""")
def _(spark, sf):
    """Customers dropped as files of two folders, and files without the columns needed; outcomes by folder."""
    folder, work = scratch_path(spark, "landing"), scratch_path(spark, "landed")
    base = materialise(churn_base(spark, sf).where("last_activity_date is not null"), "customers")
    even = F.col("customer_id").cast("bigint") % 2 == 0
    halves = base.withColumn("part", F.when(even, "even").otherwise("odd")).hint("rebalance", "part")
    halves.write.partitionBy("part").option("header", True).csv(folder)
    base.select("customer_id").hint("rebalance").write.option("header", True).csv(f"{folder}/part=broken")
    ledger = process_landing(spark, folder, ["customer_churn"], as_of_column(), f"{work}/out", f"{work}/ledger", rules=[Completeness()])
    return ledger.groupBy(F.regexp_extract("file", "part=([^/]+)", 1).alias("part"), "blueprint", "status").agg(F.sum("n_rows").alias("n_rows"))
