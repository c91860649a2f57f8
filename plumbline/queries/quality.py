"""Quality rules, row validation, profiles and compatibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.blueprints import CUSTOMER_CHURN, PRICE_OPTIMIZATION, REVENUE_PROJECTION, PLANS
from plumbline.operators import period_profile as PP
from plumbline.operators import profile as P
from plumbline.operators.clean import drop_empty_columns
from plumbline.operators import quality as Q
from plumbline.operators import rows as R
from plumbline.queries.registry import AS_OF_SQL, days_sql, query, rounded
from plumbline.session import materialise, scratch_path
from plumbline.sources.tables import (
    CHURN_BASE_SQL, CHURN_DIRTY_SQL, PRICE_BASE_SQL, REVENUE_BASE_SQL, as_of_column, churn_base, churn_dirty,
    price_base, revenue_base, table,
)

CHURN_COLUMNS = [f.name for f in CUSTOMER_CHURN.fields if f.listed]
CHURN_NUMBERS = ["total_value", "support_tickets", "feature_usage_count"]


def issue_view(issues, examples: bool = False):
    columns = ["column", "issue_type", "severity", "failed_count", "total_count", "failure_rate"]
    if examples:
        issues = issues.withColumn("example_values", F.array_join("examples", ","))
        columns.append("example_values")
    return rounded(issues.select(*columns), ["failure_rate"])


def issue_sql(column: str, kind: str, severity: str, failed: str, total: str, source: str, keep: str = "failed_count > 0", examples: str | None = None) -> str:
    shown = f", {examples} AS example_values" if examples else ""
    return f"""
SELECT * FROM (SELECT '{column}' AS "column", '{kind}' AS issue_type, '{severity}' AS severity,
  CAST({failed} AS BIGINT) AS failed_count, CAST({total} AS BIGINT) AS total_count,
  round(CASE WHEN {total} > 0 THEN CAST({failed} AS DOUBLE) / {total} ELSE 0.0 END, 6) AS failure_rate{shown}
FROM {source}) WHERE {keep}"""


def union_sql(parts: list[str], views: str) -> str:
    return f"WITH {views} " + " UNION ALL ".join(parts)


DIRTY_VIEW = f"d AS ({CHURN_DIRTY_SQL})"


def completeness_sql(c: str) -> str:
    first = f"(SELECT coalesce(string_agg(customer_id, ',' ORDER BY customer_id), '') FROM (SELECT customer_id FROM d WHERE {c} IS NULL ORDER BY customer_id LIMIT 5))"
    return issue_sql(c, "completeness", "high", f"(count(*) - count({c}))", "count(*)", "d",
                     "CAST(total_count - failed_count AS DOUBLE) / total_count < 0.95", first)


@query("quality_completeness", union_sql([completeness_sql(c) for c in CHURN_COLUMNS], DIRTY_VIEW))
def _(spark, sf):
    return issue_view(Q.run_rules(churn_dirty(spark, sf), [Q.Completeness()], key="customer_id"), examples=True)


def uniqueness_sql(c: str, source: str) -> str:
    return issue_sql(c, "uniqueness", "medium",
                     f"(count(*) - count(DISTINCT {c}) - coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0))", "count(*)", source)


@query("quality_uniqueness", union_sql([uniqueness_sql(c, "d") for c in ("customer_id", "plan_type", "total_value", "support_tickets")], DIRTY_VIEW))
def _(spark, sf):
    rule = Q.Uniqueness(["customer_id", "plan_type", "total_value", "support_tickets"])
    return issue_view(Q.run_rules(churn_dirty(spark, sf), [rule]))


@query("quality_duplicate_examples", "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5")
def _(spark, sf):
    return Q.duplicate_examples(table(spark, sf, "orders"), "o_custkey")


@query("quality_data_types", """
SELECT 'o_orderkey' AS "column", 'data_type' AS issue_type, 'medium' AS severity, CAST(1 AS BIGINT) AS failed_count,
       CAST(1 AS BIGINT) AS total_count, 1.0 AS failure_rate FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'o_totalprice', 'data_type', 'medium', 1, 1, 1.0 FROM (SELECT count(*) FROM orders)
""".replace("1.0 AS", "CAST(1.0 AS DOUBLE) AS").replace("1, 1, 1.0", "1, 1, CAST(1.0 AS DOUBLE)"))
def _(spark, sf):
    expected = {"o_orderkey": "string", "o_custkey": "integer", "o_totalprice": "integer", "o_orderdate": "datetime", "o_orderstatus": "categorical"}
    return issue_view(Q.run_rules(table(spark, sf, "orders"), [Q.DataTypes(expected)]))


@query("quality_range", "WITH l AS (SELECT *, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem) " + " UNION ALL ".join([
    issue_sql("quantity", "range", "medium", "(count(*) FILTER (WHERE quantity < 5 OR quantity > 45))", "count(*)", "l",
              examples="(SELECT string_agg(CAST(quantity AS VARCHAR), ',' ORDER BY l_orderkey, quantity) FROM (SELECT l_orderkey, quantity FROM l WHERE quantity < 5 OR quantity > 45 ORDER BY l_orderkey, CAST(quantity AS VARCHAR) LIMIT 5))".replace("ORDER BY l_orderkey, quantity)", "ORDER BY l_orderkey, CAST(quantity AS VARCHAR))")),
    issue_sql("l_linenumber", "range", "medium", "(count(*) FILTER (WHERE l_linenumber > 6))", "count(*)", "l",
              examples="(SELECT string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_orderkey) FROM (SELECT l_orderkey, l_linenumber FROM l WHERE l_linenumber > 6 ORDER BY l_orderkey LIMIT 5))"),
]))
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("quantity", F.col("l_quantity").cast("bigint"))
    rule = Q.Range({"quantity": (5, 45), "l_linenumber": (None, 6), "l_shipdate": (0, 1), "absent": (0, 1)})
    return issue_view(Q.run_rules(lines, [rule], key="l_orderkey"), examples=True)


@query("quality_pattern", union_sql([
    issue_sql("p_name", "pattern", "low", "(count(*) FILTER (WHERE NOT regexp_matches(p_name, '^(?:[a-r][a-z]+ (widget|ring))')))", "count(p_name)", "part",
              examples="(SELECT string_agg(p_name, ',' ORDER BY p_partkey) FROM (SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^(?:[a-r][a-z]+ (widget|ring))') ORDER BY p_partkey LIMIT 5))")], "one AS (SELECT 1)"))
def _(spark, sf):
    return issue_view(Q.run_rules(table(spark, sf, "part"), [Q.Pattern({"p_name": "[a-r][a-z]+ (widget|ring)"})], key="p_partkey"), examples=True)


EMAIL_VIEW = """e AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL
  WHEN c_custkey % 7 = 0 THEN replace(lower(c_name), '#', '') || '.example.com'
  ELSE replace(lower(c_name), '#', '.') || '@example.com' END AS email FROM customer)"""


def emails(spark, sf):
    name, key = F.lower("c_name"), F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 9 == 0, None)
        .when(key % 7 == 0, F.concat(F.replace(name, F.lit("#"), F.lit("")), F.lit(".example.com")))
        .otherwise(F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@example.com"))).alias("email"),
    )


@query("quality_email", union_sql([issue_sql("email", "pattern", "low", f"(count(*) FILTER (WHERE NOT regexp_matches(email, '{Q.EMAIL_PATTERN}')))", "count(email)", "e")], EMAIL_VIEW))
def _(spark, sf):
    return issue_view(Q.run_rules(emails(spark, sf), [Q.Pattern({"email": Q.EMAIL_PATTERN})]))


def iqr_sql(c: str, source: str, k: float = 3.0) -> str:
    bounds = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})"
    return issue_sql(c, "statistical_anomaly", "low",
                     f"(count(*) FILTER (WHERE {c} < q1 - {k} * (q3 - q1) OR {c} > q3 + {k} * (q3 - q1)))", f"count({c})",
                     f"{source}, {bounds}", "failed_count > 0 AND total_count >= 10")


def zscore_sql(c: str, source: str, k: float = 3.0) -> str:
    stats = f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {source})"
    return issue_sql(c, "statistical_anomaly", "low", f"(count(*) FILTER (WHERE s > 0 AND abs(({c} - m) / s) > {k}))", f"count({c})",
                     f"{source}, {stats}", "failed_count > 0 AND total_count >= 10")


@query("quality_iqr_anomaly", union_sql([iqr_sql(c, "d") for c in CHURN_NUMBERS], DIRTY_VIEW))
def _(spark, sf):
    return issue_view(Q.run_rules(churn_dirty(spark, sf), [Q.Anomaly("iqr")]))


@query("quality_zscore_anomaly", union_sql([zscore_sql(c, "d") for c in CHURN_NUMBERS], DIRTY_VIEW))
def _(spark, sf):
    return issue_view(Q.run_rules(churn_dirty(spark, sf), [Q.Anomaly("zscore")]))


@query("quality_not_null_check", f"""
WITH {DIRTY_VIEW}, m AS (SELECT count(*) AS n, count(*) - count(total_value) AS a, count(*) - count(support_tickets) AS b,
  count(*) - count(plan_type) AS c FROM d)
SELECT 'not_null_check' AS check_name, NOT (CAST(a AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE) OR CAST(b AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE) OR CAST(c AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE)) AS passed, 'high' AS severity,
  CAST(CASE WHEN CAST(a AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE) THEN a ELSE 0 END + CASE WHEN CAST(b AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE) THEN b ELSE 0 END + CASE WHEN CAST(c AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE) THEN c ELSE 0 END AS BIGINT) AS failed_count,
  CAST(n * 3 AS BIGINT) AS total_count,
  concat_ws(',', CASE WHEN CAST(a AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE) THEN 'total_value' END, CASE WHEN CAST(b AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE) THEN 'support_tickets' END, CASE WHEN CAST(c AS DOUBLE) / n > 1 - CAST(0.9 AS DOUBLE) THEN 'plan_type' END) AS failed_columns
FROM m""")
def _(spark, sf):
    return Q.not_null_check(churn_dirty(spark, sf), ["total_value", "support_tickets", "plan_type"], 0.9)


@query("quality_custom_rule", issue_sql("l_discount", "too_generous", "critical", "(count(*) FILTER (WHERE l_discount > 0.05 AND l_quantity > 40))", "count(*)", "lineitem"))
def _(spark, sf):
    def build(df):
        bad = (F.col("l_discount") > 0.05) & (F.col("l_quantity") > 40)
        return [Q.Check("l_discount", "too_generous", Q.CRITICAL, failed=F.count_if(bad), violation=bad)]

    return issue_view(Q.run_rules(table(spark, sf, "lineitem"), [Q.Custom(build)]))


@query("quality_domain", union_sql([
    issue_sql("plan_type", "domain", "medium", "(count(*) FILTER (WHERE plan_type NOT IN ('basic','premium','enterprise','trial','free','unknown')))", "count(*)", "d",
              examples="(SELECT string_agg(plan_type, ',' ORDER BY customer_id) FROM (SELECT customer_id, plan_type FROM d WHERE plan_type NOT IN ('basic','premium','enterprise','trial','free','unknown') ORDER BY customer_id LIMIT 5))")], DIRTY_VIEW))
def _(spark, sf):
    return issue_view(Q.run_rules(churn_dirty(spark, sf), [Q.Domain({"plan_type": PLANS})], key="customer_id"), examples=True)


@query("quality_duplicate_rows", """
SELECT event_id, user_id, event_type FROM events WHERE (user_id, event_type, CAST(ts AS DATE)) IN
  (SELECT (user_id, event_type, CAST(ts AS DATE)) FROM events GROUP BY user_id, event_type, CAST(ts AS DATE) HAVING count(*) > 1)""")
def _(spark, sf):
    dated = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return Q.duplicate_rows(dated, ["user_id", "event_type", "day"]).select("event_id", "user_id", "event_type")


@query("quality_orphans", """
SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1""")
def _(spark, sf):
    kept = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    return Q.orphans(table(spark, sf, "orders"), "o_custkey", kept, "c_custkey")


@query("quality_dataset_checks", """
SELECT 'positive_amount' AS check_name, bool_and(o_totalprice > 0) AS passed, 'All orders have positive amounts' AS description FROM orders
UNION ALL SELECT 'valid_status', bool_and(o_orderstatus IN ('O', 'F')), 'All orders have a valid status' FROM orders
UNION ALL SELECT 'priority_filled', count(o_orderpriority) >= 0.8 * count(*), 'At least 80% of orders have a priority' FROM orders
UNION ALL SELECT 'unique_ids', count(*) = count(DISTINCT o_orderkey), 'No duplicate order ids' FROM orders
UNION ALL SELECT 'priority_form', coalesce(bool_and(regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')), true), 'All priorities have the right form' FROM orders""")
def _(spark, sf):
    checks = {
        "positive_amount": (F.bool_and(F.col("o_totalprice") > 0), "All orders have positive amounts"),
        "valid_status": (F.bool_and(F.col("o_orderstatus").isin("O", "F")), "All orders have a valid status"),
        "priority_filled": (F.count("o_orderpriority") >= F.count("*") * 0.8, "At least 80% of orders have a priority"),
        "unique_ids": (F.count("*") == F.count_distinct("o_orderkey"), "No duplicate order ids"),
        "priority_form": (F.bool_and(F.col("o_orderpriority").rlike("^[1-5]-[A-Z ]+$")), "All priorities have the right form"),
    }
    return Q.dataset_checks(table(spark, sf, "orders"), checks)


RULE_PARTS = (
    [issue_sql(c, "completeness", "high", f"(count(*) - count({c}))", "count(*)", "d", "CAST(total_count - failed_count AS DOUBLE) / total_count < 0.95") for c in CHURN_COLUMNS]
    + [iqr_sql(c, "d") for c in CHURN_NUMBERS] + [zscore_sql(c, "d") for c in CHURN_NUMBERS]
    + [uniqueness_sql("customer_id", "d"),
       issue_sql("total_value", "range", "medium", "(count(*) FILTER (WHERE total_value < 0))", "count(*)", "d"),
       issue_sql("plan_type", "domain", "medium", "(count(*) FILTER (WHERE plan_type NOT IN ('basic','premium','enterprise','trial','free','unknown')))", "count(*)", "d")]
)
ISSUES_VIEW = f"{DIRTY_VIEW}, i AS ({' UNION ALL '.join(RULE_PARTS)})"


def report_rules():
    return [*Q.default_rules(), Q.Uniqueness(["customer_id"]), Q.Range({"total_value": (0, None)}), Q.Domain({"plan_type": PLANS})]


@query("quality_report", f"WITH {ISSUES_VIEW} SELECT * FROM i")
def _(spark, sf):
    return issue_view(Q.run_rules(materialise(churn_dirty(spark, sf), "churn"), report_rules()))


@query("quality_score", f"""WITH {ISSUES_VIEW}, w AS (SELECT sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END * failed_count) AS weighted, count(*) AS total_issues FROM i),
n AS (SELECT count(*) AS n_rows FROM d)
SELECT total_issues, n_rows, CASE WHEN n_rows = 0 OR total_issues = 0 THEN CAST(100.0 AS DOUBLE)
  ELSE round(greatest(0.0, 100 - 100 * CAST(weighted AS DOUBLE) / n_rows), 2) END AS quality_score FROM w, n""")
def _(spark, sf):
    df = materialise(churn_dirty(spark, sf), "churn")
    return Q.quality_score(Q.run_rules(df, report_rules()), df)


@query("quality_verdict", f"""WITH {ISSUES_VIEW} SELECT count(*) AS total_issues,
  count(*) FILTER (WHERE severity = 'critical') AS critical_issues, count(*) FILTER (WHERE severity = 'high') AS high_issues,
  count(*) FILTER (WHERE severity = 'medium') AS medium_issues, count(*) FILTER (WHERE severity = 'low') AS low_issues,
  count(*) FILTER (WHERE severity = 'critical') = 0 AND count(*) FILTER (WHERE severity = 'high') <= 5 AS passed FROM i""")
def _(spark, sf):
    return Q.verdict(Q.run_rules(materialise(churn_dirty(spark, sf), "churn"), report_rules()))


@query("quality_severity_summary", f"WITH {ISSUES_VIEW} SELECT severity, count(*) AS issues, CAST(sum(failed_count) AS BIGINT) AS failed_rows FROM i GROUP BY 1")
def _(spark, sf):
    return Q.severity_summary(Q.run_rules(materialise(churn_dirty(spark, sf), "churn"), report_rules()))


SPARK_TYPES = dict(zip(CHURN_COLUMNS, ["string", "timestamp", "timestamp", "double", "bigint", "bigint", "string"]))


@query("quality_column_summary", f"WITH {ISSUES_VIEW}, s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(CAST(count({c}) AS DOUBLE) / count(*), 6) AS completeness, round(CAST(count(DISTINCT {c}) AS DOUBLE) / count(*), 6) AS uniqueness, '{SPARK_TYPES[c]}' AS data_type FROM d"
    for c in CHURN_COLUMNS) + ") SELECT s.*, (SELECT count(*) FROM i WHERE i.\"column\" = s.\"column\") AS issues_count FROM s")
def _(spark, sf):
    df = materialise(churn_dirty(spark, sf), "churn")
    return rounded(Q.column_summary(df, Q.run_rules(df, report_rules())), ["completeness", "uniqueness"])


@query("quality_check_report", f"""WITH {ISSUES_VIEW}, r AS (SELECT severity, failure_rate < 0.1 AS passed FROM i)
SELECT count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed_checks, count(*) FILTER (WHERE NOT passed) AS failed_checks,
  count(*) FILTER (WHERE NOT passed AND severity = 'critical') AS failed_critical, count(*) FILTER (WHERE NOT passed AND severity = 'high') AS failed_high,
  count(*) FILTER (WHERE NOT passed AND severity = 'medium') AS failed_medium, count(*) FILTER (WHERE NOT passed AND severity = 'low') AS failed_low,
  round(CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*), 6) AS success_rate FROM r""")
def _(spark, sf):
    issues = Q.run_rules(materialise(churn_dirty(spark, sf), "churn"), report_rules())
    results = issues.select("severity", (F.col("failure_rate") < 0.1).alias("passed"))
    return rounded(Q.check_report(results), ["success_rate"])


@query("quality_final_qa", """
SELECT * FROM (SELECT 'high_cardinality' AS finding, 'o_orderid' AS "column" FROM orders HAVING count(DISTINCT 'O' || o_orderkey) > 0.5 * count(*)
UNION ALL SELECT 'high_cardinality', 'o_orderstatus' FROM orders HAVING count(DISTINCT o_orderstatus) > 0.5 * count(*)
UNION ALL SELECT 'all_missing', 'o_comment' FROM orders HAVING count(*) >= 0)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("o_orderid"), "o_orderstatus", "o_totalprice",
        F.lit(None).cast("double").alias("o_comment"),
    )
    return Q.final_qa(df)


LOG_LINE_SQL = "'10.0.' || (page_id % 7) || '.1 - GET ' || url || CASE WHEN page_id % 11 = 0 THEN '/../../etc' WHEN page_id % 13 = 0 THEN '/WP-Admin/x' WHEN page_id % 17 = 0 THEN '?id=1 union select *' ELSE '' END"


@query("access_log_scan", f"""
WITH l AS (SELECT page_id, {LOG_LINE_SQL} AS line FROM pages),
p AS (SELECT unnest(['\\.\\./', '<script>', 'UNION SELECT', '/admin', '/wp-admin', '../', '/en/']) AS pattern)
SELECT page_id, split_part(line, ' ', 1) AS source, pattern, 'high' AS severity FROM l, p WHERE contains(lower(line), lower(pattern))""")
def _(spark, sf):
    key = F.col("page_id")
    suffix = (
        F.when(key % 11 == 0, "/../../etc").when(key % 13 == 0, "/WP-Admin/x").when(key % 17 == 0, "?id=1 union select *").otherwise("")
    )
    line = F.concat(F.lit("10.0."), (key % 7).cast("string"), F.lit(".1 - GET "), F.col("url"), suffix)
    lines = table(spark, sf, "pages").select("page_id", line.alias("line"))
    return Q.scan_log_lines(lines, "line", ["page_id"], (*Q.SUSPICIOUS_PATTERNS, "../", "/en/"))


DRIFT_SQL = """
WITH a AS (SELECT o_totalprice AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b AS (SELECT o_totalprice * 1.1 AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
c AS (SELECT unnest(quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS cut FROM a),
ab AS (SELECT bin, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS s FROM (SELECT (SELECT count(*) FROM c WHERE a.v > cut) AS bin FROM a) GROUP BY bin),
bb AS (SELECT bin, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS s FROM (SELECT (SELECT count(*) FROM c WHERE b.v > cut) AS bin FROM b) GROUP BY bin)
SELECT CAST(coalesce(ab.bin, bb.bin) AS INTEGER) AS bin, round(coalesce(ab.s, 0.0), 6) AS reference_share, round(coalesce(bb.s, 0.0), 6) AS current_share,
  round((greatest(coalesce(bb.s, 0.0), 1e-6) - greatest(coalesce(ab.s, 0.0), 1e-6)) * ln(greatest(coalesce(bb.s, 0.0), 1e-6) / greatest(coalesce(ab.s, 0.0), 1e-6)), 6) AS psi
FROM ab FULL JOIN bb ON ab.bin = bb.bin"""


@query("quality_drift", DRIFT_SQL)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp")
    before = orders.filter(F.col("o_orderdate") < cut).select(F.col("o_totalprice").alias("v"))
    after = orders.filter(F.col("o_orderdate") >= cut).select((F.col("o_totalprice") * 1.1).alias("v"))
    return rounded(Q.drift(before, after, "v"), ["reference_share", "current_share", "psi"])


# --- row validation ---------------------------------------------------------------------------

def churn_errors_sql(max_age: int, plans: tuple[str, ...]) -> str:
    allowed = ",".join(f"'{p}'" for p in plans)
    tenure, recency = days_sql(AS_OF_SQL, "account_created_date"), days_sql(AS_OF_SQL, "last_activity_date")
    return f"""
v AS (SELECT customer_id, last_activity_date, account_created_date, total_value, support_tickets, feature_usage_count, lower(trim(plan_type)) AS plan_type FROM d),
f AS (SELECT *, concat_ws('; ',
   CASE WHEN last_activity_date IS NULL THEN 'last_activity_date: Field may not be null.' END,
   CASE WHEN account_created_date IS NULL THEN 'account_created_date: Field may not be null.' END,
   CASE WHEN total_value IS NULL THEN 'total_value: Field may not be null.' END,
   CASE WHEN total_value < 0 THEN 'total_value: Must be greater than or equal to 0.' END,
   CASE WHEN support_tickets IS NULL THEN 'support_tickets: Field may not be null.' END,
   CASE WHEN support_tickets < 0 THEN 'support_tickets: Must be greater than or equal to 0.' END,
   CASE WHEN feature_usage_count IS NULL THEN 'feature_usage_count: Field may not be null.' END,
   CASE WHEN plan_type IS NULL THEN 'plan_type: Field may not be null.' END,
   CASE WHEN plan_type NOT IN ({allowed}) THEN 'plan_type: Must be one of: {", ".join(plans)}.' END) AS fe FROM v),
e AS (SELECT *, CASE WHEN fe <> '' THEN fe
   WHEN account_created_date > last_activity_date THEN 'account_created_date: created later than the last activity'
   WHEN {tenure} > {max_age} THEN 'account_created_date: account is older than the limit'
   WHEN {tenure} < 0 THEN 'account_created_date: created after the reference time'
   WHEN {recency} < 0 THEN 'last_activity_date: active after the reference time'
   ELSE '' END AS errors,
   CASE WHEN total_value > 1000000 THEN 1 ELSE 0 END AS high FROM f)"""


def error_text(column: str = "errors"):
    return F.array_join(F.transform(column, lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")


CHURN_FORM_SQL = f"SELECT customer_id, errors, CAST(CASE WHEN errors = '' THEN high ELSE 0 END AS INTEGER) AS warnings FROM e"


@query("rows_churn", f"WITH {DIRTY_VIEW}, {churn_errors_sql(20 * 365, PLANS)} {CHURN_FORM_SQL}")
def _(spark, sf):
    checked = R.validate_rows(churn_dirty(spark, sf), "customer_churn", as_of_column())
    return checked.select("customer_id", error_text().alias("errors"), F.size("warnings").alias("warnings"))


STRICT_PLANS = ("basic", "premium", "enterprise", "trial", "unknown")


@query("rows_churn_strict", f"WITH {DIRTY_VIEW}, {churn_errors_sql(1500, STRICT_PLANS)} {CHURN_FORM_SQL}")
def _(spark, sf):
    checked = R.validate_rows(
        churn_dirty(spark, sf), "customer_churn", as_of_column(), max_age_days=1500, allowed={"plan_type": STRICT_PLANS}
    )
    return checked.select("customer_id", error_text().alias("errors"), F.size("warnings").alias("warnings"))


@query("rows_revenue", f"""
SELECT date, CASE WHEN revenue < 0 THEN 'revenue: Must be greater than or equal to 0.'
   WHEN date > DATE '2001-07-01' THEN 'date: day lies after the reference day' ELSE '' END AS errors,
  CAST(CASE WHEN revenue < 0 OR date > DATE '2001-07-01' THEN 0 WHEN revenue > 10000000 THEN 1 ELSE 0 END AS INTEGER) AS warnings
FROM (SELECT date, CASE WHEN day(date) = 13 THEN -revenue WHEN day(date) = 5 THEN revenue * 1000 ELSE revenue END AS revenue FROM ({REVENUE_BASE_SQL}))""")
def _(spark, sf):
    day = F.dayofmonth("date")
    revenue = F.when(day == 13, -F.col("revenue")).when(day == 5, F.col("revenue") * 1000).otherwise(F.col("revenue"))
    df = revenue_base(spark, sf).withColumn("revenue", revenue)
    checked = R.validate_rows(df, REVENUE_PROJECTION, as_of_column("2001-06-30 00:00:00"))
    return checked.select("date", error_text().alias("errors"), F.size("warnings").alias("warnings"))


@query("rows_price", f"""
SELECT product_id, date, CASE WHEN quantity_sold < 0 THEN 'quantity_sold: Must be greater than or equal to 0.'
   WHEN cost_per_unit <> 0 AND cost_per_unit > price THEN 'cost_per_unit: a unit costs more than its price' ELSE '' END AS errors,
   CAST(CASE WHEN quantity_sold < 0 OR (cost_per_unit <> 0 AND cost_per_unit > price) THEN 0 WHEN price > 100000 THEN 1 ELSE 0 END AS INTEGER) AS warnings
FROM (SELECT product_id, date, price, CASE WHEN day(date) = 13 THEN -quantity_sold ELSE quantity_sold END AS quantity_sold,
   CASE WHEN day(date) = 7 THEN 0.0 WHEN day(date) = 9 THEN NULL ELSE p_retailprice END AS cost_per_unit
   FROM ({PRICE_BASE_SQL}) b JOIN part ON CAST(p_partkey AS VARCHAR) = product_id)""")
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("product_id"), "p_retailprice")
    day = F.dayofmonth("date")
    df = price_base(spark, sf).join(parts, "product_id").select(
        "product_id", "date", "price",
        F.when(day == 13, -F.col("quantity_sold")).otherwise(F.col("quantity_sold")).alias("quantity_sold"),
        F.when(day == 7, 0.0).when(day == 9, None).otherwise(F.col("p_retailprice")).alias("cost_per_unit"),
    )
    checked = R.validate_rows(df, PRICE_OPTIMIZATION, as_of_column())
    return checked.select("product_id", "date", error_text().alias("errors"), F.size("warnings").alias("warnings"))


CHURN_E = f"{DIRTY_VIEW}, {churn_errors_sql(20 * 365, PLANS)}"


@query("rows_error_summary", f"""
WITH {CHURN_E}, x AS (SELECT unnest(string_split(errors, '; ')) AS m FROM e WHERE errors <> '')
SELECT split_part(m, ': ', 1) AS field, count(*) AS failed_count, (SELECT count(*) FROM e) AS total_count, 'high' AS severity FROM x GROUP BY 1""")
def _(spark, sf):
    checked = R.validate_rows(churn_dirty(spark, sf), "customer_churn", as_of_column())
    return R.error_summary(checked).select("field", "failed_count", "total_count", "severity")


@query("rows_validity", f"""
WITH {CHURN_E} SELECT count(*) AS total_records, count(*) FILTER (WHERE errors = '') AS valid_records, count(*) FILTER (WHERE errors <> '') AS invalid_records,
  CAST(sum(CASE WHEN errors = '' THEN high ELSE 0 END) AS BIGINT) AS warning_count, round(100.0 * count(*) FILTER (WHERE errors <> '') / count(*), 6) AS error_rate_percentage FROM e""")
def _(spark, sf):
    checked = R.validate_rows(churn_dirty(spark, sf), "customer_churn", as_of_column())
    return rounded(R.validity(checked), ["error_rate_percentage"])


@query("rows_samples", f"""
WITH {CHURN_E} SELECT * FROM (SELECT customer_id, true AS is_valid FROM e WHERE errors = '' ORDER BY 1 LIMIT 100)
UNION ALL SELECT * FROM (SELECT customer_id, false AS is_valid FROM e WHERE errors <> '' ORDER BY 1 LIMIT 100)""")
def _(spark, sf):
    checked = R.validate_rows(churn_dirty(spark, sf), "customer_churn", as_of_column())
    return R.sample_rows(checked, "customer_id").select("customer_id", "is_valid")


JSON_RULES = {
    "type": "object",
    "properties": {
        "o_orderkey": {"type": "integer", "minimum": 100},
        "o_orderstatus": {"type": "string", "enum": ["O", "F"]},
        "o_orderpriority": {"type": "string", "pattern": "^[1-4]-", "minLength": 6, "maxLength": 14},
        "o_totalprice": {"type": "number", "exclusiveMinimum": 1000, "maximum": 400000},
        "o_custkey": {"type": "string"},
        "o_clerk": {"type": ["string", "null"]},
    },
    "required": ["o_orderkey", "o_totalprice"],
    "additionalProperties": False,
}


@query("rows_json_schema", """
SELECT o_orderkey, concat_ws('; ',
  CASE WHEN o_totalprice IS NULL THEN 'o_totalprice: is a required property' END,
  CASE WHEN o_orderkey < 100 THEN 'o_orderkey: breaks minimum 100' END,
  CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'o_orderstatus: is not one of the allowed values' END,
  CASE WHEN length(o_orderpriority) < 6 THEN 'o_orderpriority: breaks minLength 6' END,
  CASE WHEN length(o_orderpriority) > 14 THEN 'o_orderpriority: breaks maxLength 14' END,
  CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'o_orderpriority: does not match the pattern' END,
  CASE WHEN o_totalprice > 400000 THEN 'o_totalprice: breaks maximum 400000' END,
  CASE WHEN o_totalprice <= 1000 THEN 'o_totalprice: breaks exclusiveMinimum 1000' END,
  'o_custkey: is not of type string', 'o_orderdate: additional property') AS errors
FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice) FROM orders)""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice"))
    checked = R.validate_json_schema(orders.withColumn("o_totalprice", price), JSON_RULES)
    return checked.select("o_orderkey", error_text().alias("errors"))


@query("rows_blueprint_json_schema", f"""
WITH {DIRTY_VIEW} SELECT customer_id, concat_ws('; ', CASE WHEN last_activity_date IS NULL THEN 'last_activity_date: is a required property' END,
  CASE WHEN total_value IS NULL THEN 'total_value: is a required property' END,
  CASE WHEN total_value < 0 THEN 'total_value: breaks minimum 0' END,
  CASE WHEN plan_type NOT IN ('basic','premium','enterprise','trial','free','unknown') THEN 'plan_type: is not one of the allowed values' END) AS errors FROM d""")
def _(spark, sf):
    checked = R.validate_json_schema(churn_dirty(spark, sf), CUSTOMER_CHURN.json_schema())
    return checked.select("customer_id", error_text().alias("errors"))


CORRECTED = f"""
c AS (SELECT customer_id, last_activity_date, account_created_date, total_value, coalesce(support_tickets, 0) AS support_tickets,
  coalesce(feature_usage_count, 0) AS feature_usage_count, coalesce(lower(trim(plan_type)), 'unknown') AS plan_type,
  concat_ws(',', CASE WHEN support_tickets IS NULL THEN 'support_tickets' END, CASE WHEN feature_usage_count IS NULL THEN 'feature_usage_count' END,
    CASE WHEN plan_type IS NULL OR plan_type <> lower(trim(plan_type)) THEN 'plan_type' END) AS corrected_fields,
  concat_ws(',', CASE WHEN last_activity_date IS NULL THEN 'last_activity_date' END, CASE WHEN total_value IS NULL THEN 'total_value' END,
    CASE WHEN support_tickets IS NULL THEN 'support_tickets' END, CASE WHEN feature_usage_count IS NULL THEN 'feature_usage_count' END,
    CASE WHEN plan_type IS NULL THEN 'plan_type' END) AS missing_fields FROM d)"""


@query("rows_auto_correct", f"WITH {DIRTY_VIEW}, {CORRECTED} SELECT customer_id, support_tickets, feature_usage_count, plan_type, corrected_fields FROM c")
def _(spark, sf):
    fixed = R.correct_rows(churn_dirty(spark, sf), "customer_churn")
    return fixed.select("customer_id", "support_tickets", "feature_usage_count", "plan_type", F.array_join("corrected_fields", ",").alias("corrected_fields"))


@query("rows_record_quality", f"""
WITH {DIRTY_VIEW}, {CORRECTED},
g AS (SELECT *, last_activity_date IS NULL AS b1, total_value IS NULL OR total_value < 0 AS b2, plan_type NOT IN ('basic','premium','enterprise','trial','free','unknown') AS b3 FROM c),
h AS (SELECT *, CASE WHEN b1 OR b2 OR b3 THEN concat_ws(',', CASE WHEN b1 THEN 'last_activity_date' END, CASE WHEN b3 THEN 'plan_type' END, CASE WHEN b2 THEN 'total_value' END)
  WHEN account_created_date > last_activity_date OR {days_sql(AS_OF_SQL, 'account_created_date')} > 7300 OR {days_sql(AS_OF_SQL, 'account_created_date')} < 0 THEN 'account_created_date'
  WHEN {days_sql(AS_OF_SQL, 'last_activity_date')} < 0 THEN 'last_activity_date' ELSE '' END AS invalid_fields FROM g)
SELECT customer_id, CASE WHEN invalid_fields <> '' THEN 'invalid' WHEN total_value > 1000000 THEN 'warning' ELSE 'valid' END AS validation_status,
  round(100.0 * (1 - CAST(CASE WHEN invalid_fields = '' THEN 0 ELSE len(string_split(invalid_fields, ',')) END AS DOUBLE) / 7), 2) AS data_quality_score,
  missing_fields, invalid_fields, corrected_fields FROM h""")
def _(spark, sf):
    records = R.record_quality(churn_dirty(spark, sf), "customer_churn", as_of_column(), "customer_id")
    return records.select(
        "customer_id", "validation_status", "data_quality_score",
        *[F.array_join(c, ",").alias(c) for c in ("missing_fields", "invalid_fields", "corrected_fields")],
    )


# --- profiles -----------------------------------------------------------------------------------

LINE_COLUMNS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]


def profile_sql(c: str, kind: str, source: str, extra: str = "") -> str:
    numeric = kind in ("bigint", "int", "double")
    stats = (
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std"
        if numeric else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std"
    )
    return (
        f"SELECT '{c}' AS \"column\", '{kind}' AS data_type, {str(numeric).lower()} AS is_numeric, {str(kind.startswith('timestamp')).lower()} AS is_datetime, "
        f"count({c}) AS non_null_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, {stats}{extra} FROM {source}"
    )


@query("profile_columns", f"WITH {DIRTY_VIEW} " + " UNION ALL ".join(profile_sql(c, SPARK_TYPES[c], "d") for c in CHURN_COLUMNS))
def _(spark, sf):
    return rounded(P.column_profile(churn_dirty(spark, sf)), ["mean", "std"], 4)


@query("profile_sample_values", f"WITH {DIRTY_VIEW} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY customer_id) AS INTEGER) AS n, CAST({c} AS VARCHAR) AS value FROM d WHERE {c} IS NOT NULL) WHERE n <= 5"
    for c in ("customer_id", "support_tickets", "plan_type")))
def _(spark, sf):
    return P.sample_values(churn_dirty(spark, sf).select("customer_id", "support_tickets", "plan_type"), "customer_id")


def top_sql(c: str, source: str, k: int = 5) -> str:
    return f"(SELECT string_agg({c} || '=' || n, ',' ORDER BY n DESC, {c}) FROM (SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, {c} LIMIT {k}))"


@query("profile_mixed", f"WITH {DIRTY_VIEW}, t AS (SELECT customer_id, total_value, support_tickets, plan_type FROM d) " + " UNION ALL ".join(
    profile_sql(c, SPARK_TYPES[c], "t", f", {top_sql(c, 't')} AS top_values" if SPARK_TYPES[c] == "string" else ", CAST(NULL AS VARCHAR) AS top_values")
    for c in ("customer_id", "total_value", "support_tickets", "plan_type")))
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "total_value", "support_tickets", "plan_type")
    return rounded(P.mixed_profile(df), ["mean", "std"], 4)


ORDER_KINDS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}


def order_states(spark, sf):
    """Stored monthly states of all orders: first of a table whose last quarter was wrong and that ended there, then refreshed from that quarter on."""
    path, orders = scratch_path(spark, "order-states"), table(spark, sf, "orders")
    price = F.when(F.col("o_orderdate") >= "1997-10-01", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
    early = orders.where("o_orderdate < '1998-01-01' OR o_orderdate IS NULL").withColumn("o_totalprice", price)
    PP.store_states(early, path, "o_orderdate", list(ORDER_KINDS), "month")
    PP.refresh_states(orders, path, "o_orderdate", "1997-10-01", "9999-01-01", list(ORDER_KINDS), "month")
    return PP.stored(spark, path)


@query("profile_incremental", " UNION ALL ".join(
    "SELECT \"column\", data_type, non_null_count + null_count AS n_rows, non_null_count, null_count, min, max, mean, std FROM ("
    + profile_sql(c, kind, "orders") + ")" for c, kind in ORDER_KINDS.items()))
def _(spark, sf):
    """The profile of all orders from stored monthly states, of which only the changed ones were made anew."""
    estimates = ["unique_estimate", "quantile_estimates", "top_estimates"]
    return rounded(PP.merged_profile(order_states(spark, sf)).drop(*estimates), ["mean", "std"], 4)


@query("profile_by_month", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_rows, count(*) - count({c}) AS null_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM orders GROUP BY ALL"
    for c in ("o_custkey", "o_totalprice")))
def _(spark, sf):
    """How a column drifts from month to month, from the stored states alone."""
    months = PP.merged_profile(order_states(spark, sf).where("is_numeric and column <> 'o_orderkey'"), ["_period"])
    return rounded(months.select("column", F.col("_period").alias("month"), "n_rows", "null_count", "mean", "std"), ["mean", "std"], 4)


@query("profile_incremental_counts", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n_rows, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS position, count(*) OVER () AS unique_count FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE position <= 5"
    for c in ("o_custkey", "o_orderstatus", "o_orderpriority")))
def _(spark, sf):
    """Exact distinct and top values from counts by month, those of the later months added to the stored ones."""
    orders, columns = table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"]
    early = orders.where("o_orderdate < '1998-01-01' OR o_orderdate IS NULL")
    stored = materialise(PP.period_counts(early, "o_orderdate", columns, "month"), "counts")
    return PP.merged_counts(stored.unionByName(PP.period_counts(PP.rows_of(orders, "o_orderdate", "1998-01-01", "9999-01-01"), "o_orderdate", columns, "month")))


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query("profile_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in PAIRS))
def _(spark, sf):
    return rounded(P.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), ["correlation"])


WIDE = {f"w{i:02}": f"CASE WHEN o_orderkey % {i + 2} <> 0 THEN o_totalprice * ((o_custkey + {i}) % {i % 5 + 2}) + o_orderkey % {i + 3} END" for i in range(30)}


@query("profile_wide_correlations", f"""
WITH w AS (SELECT {", ".join(f"{v} AS {c}" for c, v in WIDE.items())} FROM orders)
{" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM w" for a in WIDE for b in WIDE if a < b)}""")
def _(spark, sf):
    """Thirty columns with missing values, correlated by one Gram matrix."""
    wide = table(spark, sf, "orders").select(*[F.expr(v).alias(c) for c, v in WIDE.items()])
    return rounded(P.correlations(wide), ["correlation"])


def outlier_sql(c: str) -> str:
    if c not in CHURN_NUMBERS:
        return f"SELECT '{c}' AS \"column\", round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percent, CAST(NULL AS BIGINT) AS outlier_count FROM d"
    return (
        f"SELECT '{c}', round(100.0 * (count(*) - count({c})) / count(*), 6), count(*) FILTER (WHERE {c} < q1 - 3.0 * (q3 - q1) OR {c} > q3 + 3.0 * (q3 - q1)) "
        f"FROM d, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d)"
    )


@query("profile_missing_outliers", f"WITH {DIRTY_VIEW} " + " UNION ALL ".join(outlier_sql(c) for c in CHURN_COLUMNS))
def _(spark, sf):
    return rounded(P.missing_and_outliers(churn_dirty(spark, sf)), ["missing_percent"])


@query("profile_distribution", f"SELECT plan_type, count(*) AS n_rows FROM ({CHURN_BASE_SQL}) GROUP BY 1")
def _(spark, sf):
    return P.distribution(churn_base(spark, sf), "plan_type")


@query("profile_statistics", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM lineitem"
    for c in ("l_quantity", "l_extendedprice")))
def _(spark, sf):
    return rounded(P.statistics(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]), ["mean", "std"], 4)


@query("compatibility_scores", f"""
WITH {DIRTY_VIEW}, q AS (SELECT CAST(count(CASE WHEN CAST(customer_id AS BIGINT) % 4 <> 0 THEN last_activity_date END) AS DOUBLE) / count(*) AS a,
  CAST(count(account_created_date) AS DOUBLE) / count(*) AS b, CAST(count(total_value) AS DOUBLE) / count(*) AS c FROM d)
SELECT 'customer_churn' AS blueprint, (a < 0.8)::INT + (b < 0.8)::INT + (c < 0.8)::INT <= 2 AS compatible,
  round(0.7 + 0.2 * 2 / 3 + 0.1 - 0.1 * ((a < 0.8)::INT + (b < 0.8)::INT + (c < 0.8)::INT), 3) AS score, '' AS required_missing, 'feature_usage_count' AS optional_missing,
  concat_ws(',', CASE WHEN a < 0.8 THEN 'last_activity_date' END, CASE WHEN b < 0.8 THEN 'account_created_date' END, CASE WHEN c < 0.8 THEN 'total_value' END) AS quality_issues FROM q
UNION ALL SELECT 'revenue_projection', false, 0.0, 'date,revenue', 'customer_count', '' FROM q
UNION ALL SELECT 'price_optimization', false, 0.2, 'product_id,price,quantity_sold,date', '', '' FROM q""")
def _(spark, sf):
    df = churn_dirty(spark, sf).drop("feature_usage_count")
    activity = F.when(F.col("customer_id").cast("bigint") % 4 != 0, F.col("last_activity_date"))
    return P.compatibility(df.withColumn("last_activity_date", activity), [CUSTOMER_CHURN, REVENUE_PROJECTION, PRICE_OPTIMIZATION])


@query("compatibility_by_schema", f"""
WITH plans AS (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'MARINE'), tickets AS (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'customer_churn' AS blueprint, true AS compatible, round(0.8 + 0.2 * (1 + CAST(p.n > 0 AS INTEGER) + CAST(t.n > 0 AS INTEGER)) / 3, 6) AS score FROM plans p, tickets t
UNION ALL SELECT 'revenue_projection', false, 0.0
UNION ALL SELECT 'price_optimization', false, 0.2""")
def _(spark, sf):
    """Fit by the columns that hold any value: optional columns are filled for the customers of one segment only."""
    segments = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), "c_mktsegment")
    df = churn_base(spark, sf).join(segments, "customer_id")
    df = df.withColumns({
        "plan_type": F.when(F.col("c_mktsegment") == "MARINE", F.col("plan_type")), "support_tickets": F.when(F.col("c_mktsegment") == "BUILDING", F.col("support_tickets")),
    }).drop("c_mktsegment")
    filled = drop_empty_columns(materialise(df, "segments"))
    rows = [P.schema_compatibility(filled.columns, b) for b in ("customer_churn", "revenue_projection", "price_optimization")]
    return spark.createDataFrame([(r["blueprint"], r["compatible"], round(float(r["score"]), 6)) for r in rows], "blueprint string, compatible boolean, score double")
