"""Evaluation, modelling and streaming."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import evaluate as E
from plumbline.operators import forecast as P
from plumbline.operators import models as M
from plumbline.operators.features import churn_features
from plumbline.operators.rows import validate_rows
from plumbline.operators import clean as C
from plumbline.queries.features import churn_features_sql
from plumbline.queries.registry import query, rounded
from plumbline.session import materialise, scratch_path
from plumbline.sources.tables import (
    CHURN_BASE_SQL, PRICE_BASE_SQL, REVENUE_BASE_SQL, as_of_column, churn_base, order_events, price_base, revenue_base,
    table, user_events,
)
from plumbline.streaming import closing
from plumbline.streaming import jobs as S
from plumbline.streaming.versions import StepVersions, VersionedRun

# --- evaluation: line items scored by a fixed rule ----------------------------------------------

SCORED_SQL = "SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_quantity * (1 - l_discount) > 24 AS INTEGER) AS p, l_quantity / 50 AS score, l_linestatus AS g FROM lineitem"


def scored(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_quantity") * (1 - F.col("l_discount")) > 24).cast("int").alias("p"),
        (F.col("l_quantity") / 50).alias("score"),
        F.col("l_linestatus").alias("g"),
    )


COUNTS_SQL = "count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp"


@query("confusion_matrix", f"SELECT {COUNTS_SQL} FROM ({SCORED_SQL})")
def _(spark, sf):
    return E.confusion(scored(spark, sf), "y", "p")


@query("classification_metrics", f"""
WITH s AS ({SCORED_SQL}), c AS (SELECT {COUNTS_SQL} FROM s),
k AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY 1),
o AS (SELECT *, sum(pos) OVER (ORDER BY score) - pos AS pos_before, sum(neg) OVER (ORDER BY score) - neg AS neg_before, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM k)
SELECT round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
  round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1_score,
  (SELECT round(sum(CAST(pos AS DOUBLE) * (neg_before + neg / 2.0)) / (max(ap) * CAST(max(an) AS DOUBLE)), 6) FROM o) AS auc_roc,
  (SELECT round(sum(CAST(pos AS DOUBLE) * (ap - pos_before) / (ap - pos_before + an - neg_before)) / max(ap), 6) FROM o) AS auc_pr FROM c""")
def _(spark, sf):
    columns = ["accuracy", "precision", "recall", "f1_score", "auc_roc", "auc_pr"]
    return rounded(E.classification_metrics(scored(spark, sf), "y", "p", "score"), columns)


@query("business_metrics", f"SELECT fp * 10.0::DOUBLE + fn * 100.0::DOUBLE AS total_cost, tp * 1000.0::DOUBLE AS potential_revenue_saved, round((tp * 1000.0::DOUBLE - fp * 10.0::DOUBLE - fn * 100.0::DOUBLE) / (fp * 10.0::DOUBLE + fn * 100.0::DOUBLE), 6) AS roi FROM (SELECT {COUNTS_SQL} FROM ({SCORED_SQL}))")
def _(spark, sf):
    return rounded(E.business_metrics(scored(spark, sf), "y", "p"), ["roi"])


GROUP_SQL = f"SELECT g, (tp + fp) / CAST(tp + fp + tn + fn AS DOUBLE) AS selection_rate, tp / CAST(tp + fn AS DOUBLE) AS true_positive_rate, fp / CAST(fp + tn AS DOUBLE) AS false_positive_rate, tp / CAST(tp + fp AS DOUBLE) AS positive_predictive_value FROM (SELECT g, {COUNTS_SQL} FROM ({SCORED_SQL}) GROUP BY g)"
RATES = ["selection_rate", "true_positive_rate", "false_positive_rate", "positive_predictive_value"]


@query("group_rates", f"SELECT g, {', '.join(f'round({r}, 6) AS {r}' for r in RATES)} FROM ({GROUP_SQL})")
def _(spark, sf):
    return rounded(E.group_rates(scored(spark, sf), "y", "p", "g"), RATES)


@query("fairness", f"SELECT round(max(selection_rate) - min(selection_rate), 6) AS demographic_parity, round(greatest(max(true_positive_rate) - min(true_positive_rate), max(false_positive_rate) - min(false_positive_rate)), 6) AS equalized_odds, round(max(positive_predictive_value) - min(positive_predictive_value), 6) AS calibration FROM ({GROUP_SQL})")
def _(spark, sf):
    return rounded(E.fairness(scored(spark, sf), "y", "p", "g"), ["demographic_parity", "equalized_odds", "calibration"])


# --- closed-form models -----------------------------------------------------------------------------

@query("revenue_forecast", f"""
WITH b AS (SELECT CAST(datediff('day', DATE '1970-01-01', date) AS DOUBLE) AS x, revenue AS y, isodow(date) AS dow FROM ({REVENUE_BASE_SQL})),
f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, max(x) AS l, count(*) AS n, avg(y) AS m, var_pop(y) AS v, regr_r2(y, x) AS r2 FROM b),
w AS (SELECT sum(c * (a - m) * (a - m) / n) AS between_days FROM (SELECT dow, count(*) AS c, avg(y) AS a FROM b GROUP BY 1), f),
t AS (SELECT 30 * i + s * (30 * l + 465) AS f30, 90 * i + s * (90 * l + 4095) AS f90, 1.96 * sqrt(greatest(0, v * (1 - r2))) * sqrt(30) AS reach, s, between_days / v AS share FROM f, w)
SELECT round(f30, 2) AS forecast_30d, round(f90, 2) AS forecast_90d, round(f30 - reach, 2) AS confidence_low, round(f30 + reach, 2) AS confidence_high,
  CASE WHEN s > 0 THEN 'growth_detected' WHEN s < 0 THEN 'decline_detected' ELSE 'flat' END AS trend_analysis, share >= 0.05 AS seasonality_flag FROM t""")
def _(spark, sf):
    out = M.revenue_forecast(materialise(revenue_base(spark, sf), "revenue"))
    return rounded(out, ["forecast_30d", "forecast_90d", "confidence_low", "confidence_high"], 2)


PRICE_COLUMNS = ["optimal_price", "elasticity_coefficient", "revenue_impact", "volume_impact"]


def price_response_sql(optimum: str) -> str:
    return f"""
WITH b AS (SELECT b.*, p_retailprice AS cost FROM ({PRICE_BASE_SQL}) b JOIN part ON CAST(p_partkey AS VARCHAR) = product_id),
f AS (SELECT product_id, regr_slope(ln(quantity_sold), ln(price)) AS e, avg(price) AS mp, max({{'r': price * quantity_sold, 'p': price}}).p AS best, avg(cost) AS c FROM b GROUP BY 1),
o AS (SELECT product_id, e, {optimum} AS op, mp FROM f)
SELECT product_id, round(op, 8) AS optimal_price, round(e, 6) AS elasticity_coefficient, round(100 * (pow(op / mp, e + 1) - 1), 4) AS revenue_impact, round(100 * (pow(op / mp, e) - 1), 4) AS volume_impact FROM o"""


@query("price_response", price_response_sql("best"))
def _(spark, sf):
    out = M.price_response(price_base(spark, sf))
    return rounded(rounded(rounded(out, ["elasticity_coefficient"]), ["optimal_price"], 8), ["revenue_impact", "volume_impact"], 4)


@query("price_response_cost", price_response_sql("CASE WHEN e < -1 THEN c * e / (e + 1) ELSE best END"))
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("product_id"), "p_retailprice")
    priced = price_base(spark, sf).join(parts, "product_id")
    out = M.price_response(priced, cost="p_retailprice")
    return rounded(rounded(rounded(out, ["elasticity_coefficient"]), ["optimal_price"], 8), ["revenue_impact", "volume_impact"], 4)


DAILY_SQL = "SELECT o_orderpriority AS series, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, sum(o_totalprice) AS y, isodow(CAST(o_orderdate AS DATE)) AS dow FROM orders GROUP BY 1, 2, 4"


def fitted_sql(rows: str) -> str:
    """Trend and weekday effects of each series in ``rows``."""
    return f"""(WITH r AS ({rows}), l AS (SELECT series, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM r GROUP BY 1)
    SELECT l.series, s, i, dow, avg(y - i - s * x) AS e FROM r JOIN l USING (series) GROUP BY 1, 2, 3, 4)"""


@query("seasonal_forecast", f"""
WITH d AS ({DAILY_SQL}), z AS (SELECT series, max(x) AS last FROM d GROUP BY 1), a AS (SELECT d.*, last, x > last - 28 AS held FROM d JOIN z USING (series)),
t AS {fitted_sql("SELECT * FROM a WHERE NOT held")}, w AS {fitted_sql("SELECT * FROM a")},
k AS (SELECT a.*, y - i - s * x - e AS err FROM a JOIN t USING (series, dow)),
q AS (SELECT series, sqrt(avg(err * err) FILTER (WHERE held)) AS spread, sqrt(avg(err * err) FILTER (WHERE NOT held)) AS own FROM k GROUP BY 1),
c AS (SELECT series, count(*) FILTER (WHERE abs(err) <= 1.96 * own) / CAST(count(*) AS DOUBLE) AS coverage FROM k JOIN q USING (series) WHERE held GROUP BY 1),
f AS (SELECT series, DATE '1970-01-01' + CAST(last + h AS INTEGER) AS date, last + h AS x FROM z, range(1, 29) g(h)),
o AS (SELECT f.series, f.date, i + s * x + e AS y FROM f JOIN w ON w.series = f.series AND w.dow = isodow(f.date))
SELECT series AS o_orderpriority, date, round(y, 2) AS forecast, round(y - 1.96 * spread, 2) AS low, round(y + 1.96 * spread, 2) AS high, round(coverage, 6) AS coverage
FROM o JOIN q USING (series) JOIN c USING (series)""")
def _(spark, sf):
    """Revenue of every order priority for four weeks."""
    daily = table(spark, sf, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("revenue"))
    out = P.seasonal_forecast(materialise(daily, "daily"), "o_orderpriority", "date", "revenue")
    return rounded(rounded(out, ["forecast", "low", "high"], 2), ["coverage"])


@query("pooled_elasticity", f"""
WITH m AS (SELECT product_id, count(*) AS n_sales, regr_sxx(ln(quantity_sold), ln(price)) AS sxx, regr_sxy(ln(quantity_sold), ln(price)) AS sxy, regr_syy(ln(quantity_sold), ln(price)) AS syy
  FROM ({PRICE_BASE_SQL}) WHERE price > 0 AND quantity_sold > 0 GROUP BY 1),
o AS (SELECT *, CASE WHEN sxx > 1e-9 THEN sxy / sxx END AS b FROM m), v AS (SELECT * FROM o WHERE b IS NOT NULL),
p AS (SELECT sum(sxx * b) / sum(sxx) AS mu, (sum(greatest(0, syy - b * sxy)) FILTER (WHERE n_sales > 2)) / (sum(n_sales - 2) FILTER (WHERE n_sales > 2)) AS s FROM v),
t AS (SELECT mu, s, greatest(0, (SELECT (sum(sxx * (b - mu) * (b - mu)) - any_value(s) * (count(*) - 1)) / (sum(sxx) - sum(sxx * sxx) / sum(sxx)) FROM v, p)) AS t FROM p)
SELECT product_id, n_sales, round(b, 6) AS own_elasticity, round(mu, 6) AS common_elasticity, round(CASE WHEN b IS NULL THEN 0.0 ELSE t / (t + s / sxx) END, 6) AS weight,
  round(CASE WHEN b IS NULL THEN mu ELSE (t * b + s / sxx * mu) / (t + s / sxx) END, 6) AS elasticity_coefficient FROM o, t""")
def _(spark, sf):
    columns = ["own_elasticity", "common_elasticity", "weight", "elasticity_coefficient"]
    return rounded(P.pooled_elasticity(price_base(spark, sf)), columns)


@query("churn_outlook", f"""
WITH b AS ({CHURN_BASE_SQL}), {churn_features_sql('b')}, p AS (SELECT customer_id, 1 - activity_recency_score AS p FROM feat)
SELECT customer_id, CASE WHEN p < 0.25 THEN 'low' WHEN p < 0.5 THEN 'medium' WHEN p < 0.8 THEN 'high' WHEN p IS NOT NULL THEN 'critical' END AS risk_classification,
  CAST(ceil(30 * (1 - p)) AS BIGINT) AS estimated_churn_window,
  CASE WHEN p >= 0.8 THEN 'immediate_outreach,retention_offer' WHEN p >= 0.5 THEN 'engagement_campaign,retention_offer' WHEN p >= 0.25 THEN 'engagement_campaign' ELSE 'none' END AS intervention_protocols FROM p""")
def _(spark, sf):
    df = churn_base(spark, sf)
    from plumbline.functions.scalars import elapsed_days, recency_score

    p = 1 - recency_score(elapsed_days(as_of_column(), "last_activity_date"))
    return M.churn_outlook(df.select("customer_id", p.alias("p")), "p").drop("p")


@query("composite_score", """
WITH a AS (SELECT o_custkey AS k, count(*) / 50.0 AS s FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal / 10000 AS s FROM customer)
SELECT coalesce(a.k, b.k) AS k, round((coalesce(a.s, 0) * 2 + coalesce(b.s, 0) * 1) / 3, 6) AS composite_score FROM a FULL JOIN b ON a.k = b.k""")
def _(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") / 50.0).alias("s"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 10000).alias("s"))
    return rounded(M.composite_score([(orders, "s", 2.0), (customers, "s", 1.0)], "k"), ["composite_score"])


# --- trained models -----------------------------------------------------------------------------------

CHURN_FEATURES = ["account_tenure_days", "total_value", "support_intensity", "feature_usage_rate", "plan_value_score"]


def labelled(spark, sf):
    """Customers without an order in the last 180 days are churned."""
    df = materialise(churn_base(spark, sf), "churn")
    features = churn_features(df, as_of_column())
    return features.filter("days_since_last_activity IS NOT NULL").select(
        "customer_id", *[F.col(c).cast("double").alias(c) for c in CHURN_FEATURES],
        (F.col("days_since_last_activity") > 180).cast("double").alias("label"),
    )


@query("train_and_score")
def _(spark, sf):
    data = materialise(labelled(spark, sf), "labelled")
    model = M.train_classifier(data, CHURN_FEATURES, "label", "gradient_boosting")
    return M.score(model, data).select("customer_id", "churn_probability", "churn_prediction", "risk_category", "confidence")


@query("feature_importance")
def _(spark, sf):
    data = materialise(labelled(spark, sf), "labelled")
    model = M.train_classifier(data, CHURN_FEATURES, "label", "random_forest")
    return E.importance_table(M.feature_importance(spark, model), "feature", "importance")


@query("cross_validation")
def _(spark, sf):
    data = materialise(labelled(spark, sf), "labelled")
    _, scores = M.cross_validate(data, CHURN_FEATURES, "label", "logistic_regression", {"regParam": [0.0, 0.1]}, folds=3)
    return scores


@query("model_store", """
SELECT 'churn' AS name, CAST(v AS INTEGER) AS version, CASE v WHEN 1 THEN '{"regParam": 0.0}' ELSE '{"regParam": 0.1}' END AS metadata FROM (VALUES (1), (2)) t(v)""")
def _(spark, sf):
    data = materialise(labelled(spark, sf), "labelled")
    store = M.ModelStore(spark, scratch_path(spark, "models"))
    for reg in (0.0, 0.1):
        model = M.train_classifier(data, CHURN_FEATURES, "label", "logistic_regression", regParam=reg)
        store.save("churn", model, {"regParam": reg})
    return store.versions("churn").orderBy("version")


@query("stored_model_scores", """
WITH l AS (SELECT CAST(l_quantity > 25 AS INTEGER) AS big, CAST(l_discount > 0.05 AS INTEGER) AS a, CAST(l_tax > 0.03 AS INTEGER) AS b FROM lineitem)
SELECT CAST(1 AS INTEGER) AS version, big, round(avg(a), 3) AS mean_score, count(*) AS n FROM l GROUP BY 2
UNION ALL SELECT CAST(2 AS INTEGER), big, round(avg(b), 3), count(*) FROM l GROUP BY 2""")
def _(spark, sf):
    """Two versions saved, loaded back and scored: without a penalty, scores by a yes-or-no feature are the groups' shares."""
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_quantity") > 25).cast("int").alias("big"), (F.col("l_discount") > 0.05).cast("int").alias("a"), (F.col("l_tax") > 0.03).cast("int").alias("b"),
    )
    store = M.ModelStore(spark, scratch_path(spark, "models"))
    for label in ("a", "b"):
        store.save("share", M.train_classifier(lines, ["big"], label, "logistic_regression", tol=1e-10), {"label": label})
    scored = [
        store.load("share", version).transform(lines).groupBy("big").agg(F.round(F.avg(vector_to_array("probability")[1]), 3).alias("mean_score"), F.count("*").alias("n"))
        .select(F.lit(version).alias("version"), "big", "mean_score", "n") for version in (1, 2)
    ]
    return scored[0].unionByName(scored[1])


# --- streams ------------------------------------------------------------------------------------------

def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return S.file_stream(spark, f"{sf.rstrip('/')}/events.parquet*", schema)


@query("stream_daily_users", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS active_users FROM events GROUP BY 1")
def _(spark, sf):
    """Every day, with the count it had last."""
    stream = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.latest_rows(S.run_available(S.daily_active_users(stream), "dau", mode="update"), ["day"])


@query("daily_users", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS active_users FROM events GROUP BY 1")
def _(spark, sf):
    return S.daily_active_users(table(spark, sf, "events"))


SESSIONS_SQL = """
WITH u AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' END AS kind FROM events WHERE event_type IN ('signup', 'error')),
s AS (SELECT *, max(CASE WHEN kind = 'login' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS login FROM u)
SELECT user_id, event_id, (epoch_us(ts) - epoch_us(login)) / 1000000 AS session_duration FROM s WHERE kind = 'logout' AND login IS NOT NULL AND epoch_us(ts) - epoch_us(login) <= CAST({ttl} AS BIGINT) * 1000000"""


@query("stream_sessions", SESSIONS_SQL.format(ttl=86400))
def _(spark, sf):
    events = user_events(event_stream(spark, sf))
    return S.run_available(S.stateful_sessions(events, ttl_seconds=86400), "sessions")


GAP_SQL = """
WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS starts FROM events),
g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 3600000000 AS session_end, count(*) AS n_events FROM g GROUP BY user_id, s"""


@query("stream_gap_sessions", f"SELECT * FROM ({GAP_SQL}), (SELECT epoch_us(max(ts)) - 3600000000 AS w FROM events) WHERE session_end <= w".replace("SELECT * FROM", "SELECT user_id, session_start, session_end, n_events FROM", 1))
def _(spark, sf):
    stream = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.run_available(S.gap_sessions(stream), "gaps")
    return out.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


@query("gap_sessions", GAP_SQL)
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.gap_sessions(events).withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


TOTALS_SQL = """
WITH o AS (SELECT user_id AS customer_id, value AS amount, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS sign FROM events WHERE event_type IN ('purchase', 'error')),
t AS (SELECT customer_id, CAST(sum(sign) AS BIGINT) AS total_orders, sum(sign * amount) AS total_spent FROM o GROUP BY 1)
SELECT customer_id, total_orders, round(total_spent, 4) AS total_spent,
  CASE WHEN total_orders = 0 THEN 'new' WHEN total_spent >= 1000 THEN 'vip' WHEN total_orders >= 5 THEN 'loyal' ELSE 'regular' END AS customer_segment FROM t"""


@query("stream_order_totals", TOTALS_SQL)
def _(spark, sf):
    updates = S.run_available(S.running_order_totals(order_events(event_stream(spark, sf))), "totals", mode="update")
    last = S.latest_rows(updates, ["customer_id"])
    return rounded(last.select("customer_id", "total_orders", "total_spent", "customer_segment"), ["total_spent"], 4)


@query("order_totals", TOTALS_SQL)
def _(spark, sf):
    out = S.running_order_totals(order_events(table(spark, sf, "events")))
    return rounded(out.select("customer_id", "total_orders", "total_spent", "customer_segment"), ["total_spent"], 4)


@query("stream_segment_changes", TOTALS_SQL.replace("customer_segment FROM t", "new_segment FROM t"))
def _(spark, sf):
    """The last change per customer names the segment the customer ends in."""
    changes = S.run_available(S.segment_changes(order_events(event_stream(spark, sf))), "segments", mode="update")
    last = S.latest_rows(changes, ["customer_id"])
    return rounded(last.select("customer_id", "total_orders", "total_spent", "new_segment"), ["total_spent"], 4)


@query("stream_route", "SELECT CASE WHEN event_type IN ('signup', 'purchase') THEN event_type ELSE 'other' END AS route, count(*) AS n_events FROM events GROUP BY 1")
def _(spark, sf):
    routed = S.routed(event_stream(spark, sf), "event_type", ["signup", "purchase"])
    return S.run_available(routed, "route", partition_by="route").groupBy("route").agg(F.count("*").alias("n_events"))


BROKEN = "event_id % 25 = 0"


@query("stream_dead_letters", f"SELECT 'events' AS original_topic, substr(props, 1, length(props) - 1) AS message, 'malformed JSON' AS error, count(*) AS n FROM events WHERE {BROKEN} GROUP BY 2")
def _(spark, sf):
    text = F.when(F.expr(BROKEN), F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    messages = event_stream(spark, sf).select("event_id", text.alias("value"))
    parsed = S.parse_messages(messages, T.StructType([T.StructField("k", T.LongType())]))
    letters = S.run_available(S.dead_letters(parsed, F.lit("events")), "letters")
    return letters.groupBy("original_topic", "message", "error").agg(F.count("*").alias("n"))


@query("stream_parsed", f"SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE NOT ({BROKEN})")
def _(spark, sf):
    text = F.when(F.expr(BROKEN), F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    messages = event_stream(spark, sf).select("event_id", text.alias("value"))
    parsed = S.parse_messages(messages, T.StructType([T.StructField("k", T.LongType())]))
    return S.run_available(S.good_messages(parsed), "parsed").select("event_id", "k")


@query("stream_keyed_messages", "SELECT CAST(user_id AS VARCHAR) AS key, '{\"user_id\":' || user_id || ',\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def _(spark, sf):
    stream = event_stream(spark, sf).select("user_id", "event_id", "event_type")
    return S.run_available(S.keyed_messages(stream, "user_id"), "keyed")


@query("stream_completeness", "SELECT epoch_us(date_trunc('day', ts)) AS window_start, count(*) AS n_rows, round(CAST(count(CASE WHEN value >= 5 THEN value END) AS DOUBLE) / count(*), 6) AS value_completeness FROM events GROUP BY date_trunc('day', ts)")
def _(spark, sf):
    stream = event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") >= 5, F.col("value")).alias("value"))
    out = S.latest_rows(S.run_available(S.windowed_completeness(stream, ["value"]), "completeness", mode="update"), ["window_start"])
    return rounded(out.withColumn("window_start", F.unix_micros("window_start")), ["value_completeness"])


@query("stream_row_errors", "SELECT product_id, CASE WHEN price < 0.01 THEN 'price' ELSE '' END AS field FROM (SELECT CAST(event_id AS VARCHAR) AS product_id, value - 5 AS price FROM events)")
def _(spark, sf):
    """The batch row rules on a stream, unchanged."""
    stream = event_stream(spark, sf).select(
        F.col("event_id").cast("string").alias("product_id"), (F.col("value") - 5).alias("price"),
        F.lit(1).cast("bigint").alias("quantity_sold"), F.to_date("ts").alias("date"),
    )
    checked = validate_rows(stream, "price_optimization", as_of_column("2025-01-01 00:00:00"))
    fields = F.array_join(F.transform("errors", lambda e: e["field"]), ",")
    return S.run_available(checked.select("product_id", fields.alias("field")), "errors")


@query("stream_fitted_transform", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
c AS (SELECT event_id, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), value)) AS v FROM events, q)
SELECT event_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS value FROM c""")
def _(spark, sf):
    """Steps fitted on the stored table, applied to the stream."""
    events = table(spark, sf, "events").select("event_id", "value")
    cap = C.fit_cap(events, "iqr", columns=["value"])
    scale = C.fit_scale(cap.transform(events), "standard", columns=["value"])
    stream = scale.transform(cap.transform(event_stream(spark, sf).select("event_id", "value")))
    return rounded(S.run_available(stream, "fitted"), ["value"])


@query("stream_versioned_steps", """
WITH e AS (SELECT event_id, value, event_id <= (SELECT max(event_id) // 2 FROM events) AS early FROM events),
q AS (SELECT 1 AS version, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e WHERE early
      UNION ALL SELECT 2, quantile_cont(value, 0.25), quantile_cont(value, 0.75) FROM e),
c AS (SELECT version, early, event_id, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), value)) AS v FROM e, q),
m AS (SELECT version, avg(v) AS mean, stddev_pop(v) AS dev FROM c WHERE early OR version = 2 GROUP BY 1)
SELECT event_id, CAST(version AS INTEGER) AS model_version, round((v - mean) / dev, 6) AS value
FROM c JOIN m USING (version) WHERE version = CASE WHEN early THEN 1 ELSE 2 END""")
def _(spark, sf):
    """Events that arrive in two halves; after the first the steps are fitted anew, and the same stream goes on with them."""
    root, events = scratch_path(spark, "versioned"), table(spark, sf, "events").select("event_id", "value")
    half = events.agg(F.max("event_id")).first()[0] // 2
    run = VersionedRun(StepVersions(spark, f"{root}/steps"), f"{root}/out")

    def fitted(df):
        cap = C.fit_cap(df, "iqr", columns=["value"])
        return [cap, C.fit_scale(cap.transform(df), "standard", columns=["value"])]

    for known, arrived in ((events.where(F.col("event_id") <= half),) * 2, (events, events.where(F.col("event_id") > half))):
        run.versions.publish(fitted(known))
        arrived.write.mode("append").parquet(f"{root}/in")
        run.start(S.file_stream(spark, f"{root}/in", events.schema), f"{root}/state").awaitTermination()
    return rounded(run.rows(spark).drop("batch_id"), ["value"])


@query("stream_closing_totals", TOTALS_SQL)
def _(spark, sf):
    """Orders arrive in four stretches of time; customers quiet for two days leave the state, and their parts add up with what is open."""
    orders = order_events(table(spark, sf, "events"))
    low, high = orders.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    folder, out, state = (scratch_path(spark, n) for n in ("orders", "parts", "state"))
    step = (high - low) // 4 + 1
    for i in range(4):
        stretch = (F.unix_seconds("ts") >= low + i * step) & (F.unix_seconds("ts") < low + (i + 1) * step)
        orders.where(stretch).write.mode("append").parquet(folder)
        closing.start(closing.closed_parts(S.file_stream(spark, folder, orders.schema), ttl_days=2), out, state).awaitTermination()
    found = closing.totals(spark, out, state)
    return rounded(found.select("customer_id", "total_orders", "total_spent", "customer_segment"), ["total_spent"], 4)
