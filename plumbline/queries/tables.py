"""Sources, sinks, joins, aggregations and projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import customer_segment, parse_timestamp, risk_category
from plumbline.operators import metrics as M
from plumbline.operators.profile import value_counts
from plumbline.operators.rows import fill_defaults, normalise_text
from plumbline.operators.skew import balanced_join
from plumbline.queries.registry import query, rounded
from plumbline.session import scratch_path
from plumbline.sources import files, sinks
from plumbline.sources.tables import CHURN_DIRTY_SQL, churn_base, churn_dirty, table

# --- sources ------------------------------------------------------------------------------------


@query("scan_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, sf):
    """CSV with null words and odd column names, with delimiter, encoding and types found."""
    path = scratch_path(spark, "csv")
    customers = table(spark, sf, "customer")
    raw = customers.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_custkey") % 6 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 4 == 0, "null").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    sinks.write_csv(raw.toDF("C_CustKey", "C_Name", " C_NationKey", "C_AcctBal ", "C_MktSegment"), path)
    return files.read_csv(spark, path)


@query("scan_delimited", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    path = scratch_path(spark, "piped")
    table(spark, sf, "supplier").write.option("header", True).option("sep", "|").csv(path)
    return files.read_csv(spark, path)


@query("scan_csv_schema", "SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.write_csv(orders, path)
    back = files.read_csv(spark, path, schema=orders.schema, delimiter=",", encoding="UTF-8")
    return rounded(back.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total")), ["total"], 2)


@query("scan_csv_multiline", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest, lang FROM (
  SELECT doc_id, replace('say "' || text || '"', chr(13), ' ') || chr(10) || 'end' AS text, lang FROM documents WHERE text IS NOT NULL)""")
def _(spark, sf):
    """Whole texts with their quotes and line breaks, stored as CSV and cut into records again in parallel."""
    path = scratch_path(spark, "documents-csv")
    docs = table(spark, sf, "documents").where("text is not null")
    text = F.concat(F.replace(F.concat(F.lit('say "'), "text", F.lit('"')), F.lit("\r"), F.lit(" ")), F.lit("\nend"))
    docs.select("doc_id", text.alias("text"), "lang").write.option("header", True).option("escape", '"').csv(path)
    back = files.read_csv(spark, path, infer=False)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "lang")


@query("scan_mixed_folder", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' Zoë; ,日本' WHEN 1 THEN c_name || ', Jürgen' ELSE c_name || ', 20 €' END AS c_name,
  c_acctbal FROM customer""")
def _(spark, sf):
    """One folder with files of three encodings and two delimiters."""
    path = scratch_path(spark, "mixed")
    customers, key = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), F.col("c_custkey") % 3
    # In windows-1252 the euro sign has the byte that is the control character 128 in Latin-1.
    for part, tail, sep, encoding in ((0, " Zoë; ,日本", ",", "UTF-8"), (1, ", Jürgen", ";", "ISO-8859-1"), (2, ", 20 \x80", ";", "ISO-8859-1")):
        rows = customers.where(key == part).withColumn("c_name", F.concat("c_name", F.lit(tail)))
        rows.write.mode("append").option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return files.read_csv(spark, path)


@query("check_utf8", "SELECT lang, count(*) AS n_docs, count(*) AS valid_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def _(spark, sf):
    content = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.is_valid_utf8(content.cast("string"))).alias("valid_docs"),
        F.sum(F.octet_length(content)).alias("n_bytes"),
    )


@query("choose_encoding", """
SELECT lang, CASE WHEN bool_and(NOT regexp_matches(text, '[\\x{80}-\\x{ff}]')) THEN 'UTF-8'
  WHEN bool_or(regexp_matches(text, '[\\x{80}-\\x{9f}]')) THEN 'windows-1252' ELSE 'ISO-8859-1' END AS encoding FROM documents GROUP BY 1""")
def _(spark, sf):
    """Documents stored as Latin-1 text files, one folder for each language: only plain ASCII text is also valid UTF-8."""
    docs, path = table(spark, sf, "documents"), scratch_path(spark, "latin")
    single = F.regexp_replace(F.regexp_replace("text", r"[^\x00-\xff]", "?"), r"[\r\n\x01]", " ")
    docs.select("lang", single.alias("value")).write.partitionBy("lang").option("encoding", "ISO-8859-1").option("quote", "").option("sep", "\u0001").csv(path)
    languages = sorted(r[0] for r in docs.select("lang").distinct().collect())
    judged = files.judge_files(spark, [f"{path}/lang={lang}" for lang in languages])
    return spark.createDataFrame([(lang, encoding) for lang, (_, encoding) in zip(languages, judged)], "lang string, encoding string")


@query("tidy_columns", 'SELECT o_orderkey AS order_key, round(o_totalprice, 2) AS total_price__, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0')
def _(spark, sf):
    """Names with blanks and signs, an unnamed column, a repeated name and rows without any value."""
    keep = F.col("o_orderkey") % 3 != 0
    columns = [F.when(keep, F.col(c)) for c in ("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")]
    messy = table(spark, sf, "orders").select(
        columns[0].alias(" Order Key"), columns[1].alias("Total Price($"), columns[2].alias("STATUS"),
        columns[3].alias("Unnamed: 4"), columns[3].alias("status "),
    )
    return rounded(files.tidy(messy), ["total_price__"], 2)


@query("content_hash", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(CAST(doc_id AS VARCHAR)) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash")
    )
    return files.duplicate_uploads(docs)


@query("file_facts", r"""
WITH f AS (SELECT doc_id // 100 AS upload, string_agg(regexp_replace(text, '[\r\n]', ' ', 'g') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1)
SELECT CAST(octet_length(encode(content)) AS BIGINT) AS file_size, sha256(content) AS content_hash, true AS is_utf8 FROM f""")
def _(spark, sf):
    """Facts about uploaded text files of up to a hundred documents each."""
    path = scratch_path(spark, "uploads")
    docs = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 100).alias("upload"), "doc_id", F.regexp_replace("text", r"[\r\n]", " ").alias("value")
    )
    docs.repartition("upload").sortWithinPartitions("upload", "doc_id").drop("doc_id").write.partitionBy("upload").text(path)
    facts = files.file_facts(spark, f"{path}/*/*.txt")
    return facts.select("file_size", "content_hash", "is_utf8")


@query("scan_json", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "json")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    events.write.json(path)
    back = files.read_json(spark, path, schema=events.schema)
    return rounded(back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), ["total"], 2)


@query("parquet_features_target", "SELECT l_linestatus, CAST(count(*) AS BIGINT) AS n, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS positives FROM lineitem GROUP BY 1")
def _(spark, sf):
    root = scratch_path(spark, "features")
    df = table(spark, sf, "lineitem").select("l_linestatus", "l_quantity", (F.col("l_returnflag") == "R").alias("returned"))
    sinks.write_features(df, root, "lines", target="returned")
    features, target = sinks.read_features(spark, root, "lines", target="returned")
    positives = target.agg(F.count_if("returned").alias("positives"))
    return features.groupBy("l_linestatus").agg(F.count("*").alias("n")).crossJoin(F.broadcast(positives))


@query("stage_by_day", "SELECT CAST(ts AS DATE) AS date, count(*) AS n_events FROM events GROUP BY 1")
def _(spark, sf):
    path = sinks.stage_by_day(table(spark, sf, "events"), scratch_path(spark, "lake"), "events", "ts")
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n_events"))


@query("incremental_extract", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'")
def _(spark, sf):
    return sinks.changed_on(table(spark, sf, "orders"), "o_orderdate", "1998-10-03").select("o_orderkey", "o_custkey")


@query("upsert_metrics", """
WITH a AS (SELECT o_custkey, count(*) AS total_orders, min(o_orderdate) AS first_order FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS total_orders, min(o_orderdate) AS first_order FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(b.total_orders, a.total_orders) AS total_orders,
  CAST(coalesce(a.first_order, b.first_order) AS DATE) AS first_order FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def _(spark, sf):
    orders = table(spark, sf, "orders")

    def totals(rows):
        return rows.groupBy("o_custkey").agg(F.count("*").alias("total_orders"), F.min("o_orderdate").cast("date").alias("first_order"))

    current = totals(orders.filter("o_orderdate < '2000-01-01'"))
    updates = totals(orders.filter("o_orderdate >= '2000-01-01'"))
    return sinks.upsert(current, updates, ["o_custkey"], keep=["first_order"])


@query("upsert_touched", """
WITH a AS (SELECT o_custkey, count(*) AS total_orders, min(o_orderdate) AS first_order FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-28' GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS total_orders, min(o_orderdate) AS first_order FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-28' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(b.total_orders, a.total_orders) AS total_orders,
  CAST(coalesce(a.first_order, b.first_order) AS DATE) AS first_order FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def _(spark, sf):
    """The last days' orders merged into a stored table, of which only the folders with a changed key are rewritten."""
    orders = table(spark, sf, "orders")

    def totals(rows):
        return rows.groupBy("o_custkey").agg(F.count("*").alias("total_orders"), F.min("o_orderdate").cast("date").alias("first_order"))

    path = scratch_path(spark, "totals")
    sinks.write_bucketed(totals(orders.filter("o_orderdate < '2001-07-28'")), path, ["o_custkey"], 16)
    sinks.upsert_touched(spark, path, totals(orders.filter("o_orderdate >= '2001-07-28'")), ["o_custkey"], keep=["first_order"], buckets=16)
    return spark.read.parquet(path).drop(sinks.BUCKET)


@query("fixed_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42-' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000")
def _(spark, sf):
    return files.fixed_sample(table(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey", "o_custkey")


@query("batch_report", "SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (WHERE l_orderkey % 20 = 0) AS corrupt_rows, CAST(0 AS BIGINT) AS empty_rows, count(*) FILTER (WHERE l_orderkey % 20 = 0) = 0 AS succeeded FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Several folders of CSV files read as one table, some rows of which do not fit the schema."""
    path = scratch_path(spark, "batch")
    key = F.when(F.col("l_orderkey") % 20 == 0, "broken").otherwise(F.col("l_orderkey").cast("string"))
    lines = table(spark, sf, "lineitem").select("l_returnflag", key.alias("l_orderkey"), "l_quantity")
    lines.write.partitionBy("l_returnflag").option("header", True).csv(path)
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_quantity", T.DoubleType())])
    rows = files.read_batch(spark, [f"{path}/l_returnflag={flag}" for flag in ("A", "N", "R")], schema)
    folder = F.regexp_extract("_metadata.file_path", "l_returnflag=([^/]+)/", 1)
    return files.batch_report(rows.withColumn("l_returnflag", folder), "l_returnflag")


@query("malformed_lines", "SELECT CASE WHEN c_custkey % 10 = 0 THEN 4 WHEN c_custkey % 15 = 1 THEN 2 ELSE 3 END AS n_fields, count(*) AS n_lines FROM customer GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "lines")
    key = F.col("c_custkey")
    whole = F.concat_ws(",", key, F.concat(F.lit('"'), F.col("c_name"), F.lit(', Ltd"')), "c_mktsegment")
    line = F.when(key % 10 == 0, F.concat(whole, F.lit(",extra"))).when(key % 15 == 1, F.concat_ws(",", key, "c_name")).otherwise(whole)
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    report = files.field_count_report(spark, path)
    return report.groupBy("n_fields").agg(F.sum("n_lines").alias("n_lines"))


# --- joins and aggregations -------------------------------------------------------------------------

METRICS_SQL = """
SELECT c_custkey, coalesce(total_orders, 0) AS total_orders, coalesce(total_cents, 0) / 100 AS total_spent,
  CASE WHEN total_orders IS NULL THEN 0.0 ELSE ((2 * total_cents + total_orders) // (2 * total_orders)) / 100 END AS avg_order_value, last_order_date
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS total_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents,
  CAST(max(o_orderdate) AS DATE) AS last_order_date FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
SEGMENT_SQL = "CASE WHEN total_orders = 0 THEN 'new' WHEN total_spent >= 1000 THEN 'vip' WHEN total_orders >= 5 THEN 'loyal' ELSE 'regular' END"


def dated_orders(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))


@query("customer_metrics", f"SELECT c_custkey, total_orders, total_spent, avg_order_value, last_order_date, {SEGMENT_SQL} AS customer_segment, DATE '2001-08-02' AS processed_date FROM ({METRICS_SQL})")
def customer_metrics_query(spark, sf):
    return M.customer_metrics(
        table(spark, sf, "customer").select("c_custkey"), dated_orders(spark, sf), key="c_custkey", customer="o_custkey",
        amount="o_totalprice", date="o_orderdate", processed="2001-08-02",
    )


@query("order_metrics", f"SELECT c_custkey AS o_custkey, total_orders, total_spent, avg_order_value, last_order_date FROM ({METRICS_SQL}) WHERE total_orders > 0")
def _(spark, sf):
    return M.order_metrics(dated_orders(spark, sf), "o_custkey", "o_totalprice", "o_orderdate")


@query("segment_sizes", "WITH t AS (SELECT o_custkey, count(*) AS total_orders, sum(o_totalprice) / 400 AS total_spent FROM orders GROUP BY 1) SELECT " + SEGMENT_SQL + " AS customer_segment, count(*) AS n_customers FROM t GROUP BY 1")
def _(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total_orders"), (F.sum("o_totalprice") / 400).alias("total_spent"))
    return totals.select(customer_segment("total_orders", "total_spent").alias("customer_segment")).groupBy("customer_segment").agg(F.count("*").alias("n_customers"))


@query("semi_membership", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("anti_membership", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("balanced_join", "SELECT l_returnflag, p_brand, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY 1, 2")
def _(spark, sf):
    """A join forced to take the way for large right sides: hot keys apart from the rest."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    parts = table(spark, sf, "part").filter("p_size > 10").select("p_partkey", "p_brand")
    return balanced_join(lines, parts, ["p_partkey"], "left", small=False).groupBy("l_returnflag", "p_brand").agg(F.count("*").alias("n"))


@query("dummy_columns", "SELECT o_orderkey, o_orderstatus = 'F' AS status_f, o_orderstatus = 'O' AS status_o, o_orderstatus = 'P' AS status_p FROM orders")
def _(spark, sf):
    """Columns put beside each other by row are a projection, not a join."""
    return table(spark, sf, "orders").select("o_orderkey", *[(F.col("o_orderstatus") == s).alias(f"status_{s.lower()}") for s in ("F", "O", "P")])


@query("scaled_by_maximum", "SELECT s_suppkey, round(s_acctbal / (SELECT max(s_acctbal) FROM supplier), 6) AS share_of_max FROM supplier")
def _(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    top = suppliers.agg(F.max("s_acctbal").alias("top"))
    return suppliers.crossJoin(F.broadcast(top)).select("s_suppkey", F.round(F.col("s_acctbal") / F.col("top"), 6).alias("share_of_max"))


@query("aggregate_statistics", """
SELECT l_returnflag, round(stddev_samp(l_extendedprice), 4) AS std_sample, round(stddev_pop(l_extendedprice), 4) AS std_population,
  count(DISTINCT l_partkey) AS n_parts, round(avg(l_discount), 6) AS mean_discount, max(l_quantity) AS max_quantity FROM lineitem GROUP BY 1""")
def _(spark, sf):
    out = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.stddev_samp("l_extendedprice").alias("std_sample"), F.stddev_pop("l_extendedprice").alias("std_population"),
        F.count_distinct("l_partkey").alias("n_parts"), F.avg("l_discount").alias("mean_discount"), F.max("l_quantity").alias("max_quantity"),
    )
    return rounded(rounded(out, ["std_sample", "std_population"], 4), ["mean_discount"])


@query("value_counts", "SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n_rows FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def _(spark, sf):
    return value_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("latency_summary", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM r WHERE n <= 100)
SELECT event_type, count(*) AS count, round(avg(value), 6) AS avg_duration, min(value) AS min_duration, max(value) AS max_duration,
  count(*) FILTER (WHERE value > 5.0) AS slow_count, max(CASE WHEN i = CAST(floor(c * 0.95) AS BIGINT) THEN value END) AS p95_duration FROM k GROUP BY 1""")
def _(spark, sf):
    return rounded(M.latency_summary(table(spark, sf, "events"), "event_type", "value", ["ts", "event_id"]), ["avg_duration"])


@query("error_summary", """
WITH e AS (SELECT event_type, json_extract_string(props, '$.k') AS k, ts FROM events),
m AS (SELECT event_type, k, max(ts) AS last_ts, row_number() OVER (PARTITION BY event_type ORDER BY max(ts) DESC, k) AS n FROM e GROUP BY 1, 2)
SELECT event_type, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen,
  (SELECT string_agg(k, ',' ORDER BY n) FROM m WHERE n <= 5 AND m.event_type = e.event_type) AS recent_messages FROM e GROUP BY 1""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_type", "ts", F.get_json_object("props", "$.k").alias("k"))
    return M.error_summary(events, "event_type", "k", "ts")


@query("most_frequent", "SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf):
    return M.most_frequent(table(spark, sf, "events"), "user_id", 5)


@query("newest_first", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, sf):
    return M.newest(table(spark, sf, "events"), "ts", "event_id", 20).select("event_id", "event_type")


@query("sorted_series", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(spark, sf):
    """The last rows of the table in date order, with their positions counted from the end."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    total = orders.agg(F.count("*").alias("n"))
    last = orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).agg(
        F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False).alias("rows")  # 50 rows
    )
    placed = last.crossJoin(F.broadcast(total)).select(F.posexplode("rows").alias("i", "row"), "n")
    return placed.select("row.o_orderkey", (F.col("n") - F.col("i")).alias("position"))


@query("run_summary", "SELECT count(*) AS total_runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS runs_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS runs_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS runs_p, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS success_rate FROM orders")
def _(spark, sf):
    return rounded(M.run_summary(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P"], "F"), ["success_rate"])


# --- projections ------------------------------------------------------------------------------------

@query("normalise_text", f"WITH d AS ({CHURN_DIRTY_SQL}) SELECT customer_id, lower(trim(plan_type)) AS plan_type, account_created_date FROM d")
def _(spark, sf):
    """Dates as ISO text for even keys and as plain dates for odd ones, parsed back."""
    date = F.col("account_created_date")
    text = F.when(F.col("customer_id").cast("bigint") % 2 == 0, F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    raw = churn_dirty(spark, sf).select(F.concat(F.lit(" "), "customer_id").alias("customer_id"), "plan_type", text.alias("account_created_date"))
    return normalise_text(raw, "customer_churn")


@query("fill_defaults", f"WITH d AS ({CHURN_DIRTY_SQL}) SELECT customer_id, coalesce(support_tickets, 0) AS support_tickets, coalesce(feature_usage_count, 0) AS feature_usage_count, coalesce(plan_type, 'unknown') AS plan_type, CAST(NULL AS DOUBLE) AS login_frequency, CAST(0 AS BIGINT) AS payment_failures, CAST(0 AS BIGINT) AS referral_count FROM d")
def _(spark, sf):
    df = churn_dirty(spark, sf).select("customer_id", "support_tickets", "feature_usage_count", "plan_type")
    return fill_defaults(df, "customer_churn")


@query("parse_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS parsed FROM orders")
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("on "), day)).otherwise(day)
    return table(spark, sf, "orders").select("o_orderkey", parse_timestamp(text).alias("parsed"))


@query("risk_category", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 < 0.25 THEN 'Low' WHEN l_discount * 10 < 0.5 THEN 'Medium' WHEN l_discount * 10 < 0.8 THEN 'High' ELSE 'Critical' END AS risk FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", risk_category(F.col("l_discount") * 10).alias("risk"))


@query("enrich_events", "SELECT event_id, TIMESTAMP '2024-02-01 00:00:00' AS processed_at, 'user_event_processor' AS processor FROM events")
def _(spark, sf):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return M.enrich(table(spark, sf, "events").select("event_id"), "user_event_processor", at)


@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))
