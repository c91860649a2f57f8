"""Customer metrics, run summaries and log summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import customer_segment

# Observations kept per operation, the slow limit in seconds, messages kept per error.
KEPT_OBSERVATIONS = 100
SLOW_SECONDS = 5.0
P95 = 0.95
KEPT_MESSAGES = 5


def order_metrics(orders: DataFrame, customer: str, amount: str, date: str) -> DataFrame:
    """Orders, spend, mean order and last order per customer, in exact cents."""
    money = F.col(amount).cast("decimal(18,2)")
    return orders.groupBy(customer).agg(
        F.count("*").alias("total_orders"),
        F.sum(money).cast("double").alias("total_spent"),
        F.round(F.avg(money), 2).cast("double").alias("avg_order_value"),
        F.max(date).alias("last_order_date"),
    )


def customer_metrics(customers: DataFrame, orders: DataFrame, *, key: str, customer: str, amount: str, date: str, processed: str | None = None) -> DataFrame:
    """Every customer with order totals (0 without orders) and segment. Orders are reduced before the join."""
    totals = order_metrics(orders, customer, amount, date).withColumnRenamed(customer, key)
    joined = customers.join(totals, key, "left").fillna({"total_orders": 0, "total_spent": 0.0, "avg_order_value": 0.0})
    out = joined.withColumn("customer_segment", customer_segment("total_orders", "total_spent"))
    return out if processed is None else out.withColumn("processed_date", F.lit(processed).cast("date"))


def latency_summary(observations: DataFrame, operation: str, duration: str, order: Sequence[str], kept: int = KEPT_OBSERVATIONS) -> DataFrame:
    """Count, mean, extremes and nearest-rank 95th percentile of each operation's latest observations.

    The rank limit keeps ``kept`` rows per operation in every task, so the gathered arrays stay that small.
    """
    newest = W.partitionBy(operation).orderBy(*[F.desc(c) for c in order])
    recent = observations.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= kept)
    summary = recent.groupBy(operation).agg(
        F.count("*").alias("count"),
        F.avg(duration).alias("avg_duration"),
        F.min(duration).alias("min_duration"),
        F.max(duration).alias("max_duration"),
        F.sort_array(F.collect_list(duration)).alias("_sorted"),
        F.count_if(F.col(duration) > SLOW_SECONDS).alias("slow_count"),
    )
    at = F.floor(F.size("_sorted") * F.lit(P95)).cast("int")
    return summary.withColumn("p95_duration", F.get("_sorted", at)).drop("_sorted")


def error_summary(errors: DataFrame, kind: str, message: str, ts: str, kept: int = KEPT_MESSAGES) -> DataFrame:
    """Per error type: occurrences, first and last time, and the latest distinct messages, newest first."""
    messages = errors.groupBy(kind, message).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    totals = messages.groupBy(kind).agg(
        F.sum("n").alias("count"), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen")
    )
    newest = W.partitionBy(kind).orderBy(F.desc("last_ts"), message)
    latest = (
        messages.filter(F.col(message).isNotNull())
        .withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= kept)
        .groupBy(kind)
        .agg(F.sort_array(F.collect_list(F.struct("_n", F.col(message).cast("string").alias("m")))).alias("_m"))
    )
    recent = F.array_join(F.transform("_m", lambda m: m["m"]), ",")
    return totals.join(latest, kind, "left").withColumn("recent_messages", recent).drop("_m")


def most_frequent(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values, the smaller first among equals."""
    return df.groupBy(column).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), column).limit(k)


def newest(df: DataFrame, ts: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(key)).limit(k)


def run_summary(runs: DataFrame, status: str, statuses: Sequence[str], success: str) -> DataFrame:
    """One row: runs per status and the percentage of successful ones."""
    row = runs.agg(F.count("*").alias("total_runs"), *[F.count_if(F.col(status) == s).alias(f"runs_{s.lower()}") for s in statuses])
    rate = F.coalesce(100 * F.col(f"runs_{success.lower()}") / F.nullif(F.col("total_runs"), F.lit(0)), F.lit(0.0))
    return row.withColumn("success_rate", rate)


def enrich(events: DataFrame, processor: str, processed_at: Column | None = None) -> DataFrame:
    at = F.current_timestamp() if processed_at is None else processed_at
    return events.withColumns({"processed_at": at, "processor": F.lit(processor)})
