"""Streaming counterparts: the same expressions on unbounded tables, with watermarks."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.functions.scalars import customer_segment
from plumbline.session import scratch_path

# The stateful processors travel to the executors by value, so these need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How long sessions, daily users and customer totals are kept.
SESSION_TTL_SECONDS = 3600
DAILY_USERS_DAYS = 7
CUSTOMER_TTL_DAYS = 30
MALFORMED = "_malformed"
UNKNOWN = "_unknown"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def kafka_stream(spark: SparkSession, servers: str, topics: Sequence[str], starting: str = "latest") -> DataFrame:
    """``topic`` and ``value`` text of several topics. Needs Spark's Kafka connector on the class path."""
    rows = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", starting).load()
    )
    return rows.select("topic", F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def parse_messages(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON text as columns; ``_malformed`` holds the text that could not be read."""
    full = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    parsed = messages.withColumn("_p", F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}))
    bad = F.col(f"_p.{MALFORMED}").isNotNull() | (F.col("_p").isNull() & F.col(value).isNotNull())
    fields = [F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields]
    return parsed.select(*messages.columns, *fields, F.when(bad, F.col(value)).alias(MALFORMED))


def good_messages(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(MALFORMED).isNull()).drop(MALFORMED)


def dead_letters(parsed: DataFrame, topic: Column, at: Column | None = None) -> DataFrame:
    """Messages that could not be read, with their topic, the error and the time."""
    return parsed.filter(F.col(MALFORMED).isNotNull()).select(
        topic.alias("original_topic"),
        F.col(MALFORMED).alias("message"),
        F.lit("malformed JSON").alias("error"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
    )


def routed(events: DataFrame, column: str, kinds: Sequence[str]) -> DataFrame:
    """Adds ``route``: the value of ``column`` if it is one of ``kinds``, else ``other``. Written partitioned by it
    (``run_available`` with ``partition_by``), one scan serves all kinds and no event is left without a place."""
    return events.withColumn("route", F.when(F.col(column).isin(list(kinds)), F.col(column)).otherwise(F.lit("other")))


def daily_active_users(events: DataFrame, *, user: str = "user_id", ts: str = "ts", delay: str | None = f"{DAILY_USERS_DAYS} days") -> DataFrame:
    """Distinct users per day. A day of a stream is final once the watermark has passed it.

    Users are made unique per day before the count, so a very active user is one row.
    """
    if events.isStreaming:
        events = events.withWatermark(ts, delay)
        once = events.withColumn("day", F.to_date(ts)).dropDuplicatesWithinWatermark([user, "day"])
        return once.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("active_users")).select(
            F.to_date("w.start").alias("day"), "active_users"
        )
    once = events.groupBy(F.to_date(ts).alias("day"), user).agg(F.lit(1).alias("one"))
    return once.groupBy("day").agg(F.count("*").alias("active_users"))


def gap_sessions(events: DataFrame, *, user: str = "user_id", ts: str = "ts", gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Sessions that end after a quiet ``gap``."""
    if events.isStreaming:
        events = events.withWatermark(ts, delay)
    return events.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n_events")).select(
        user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events"
    )


def keyed(df: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """``key``, a mark where it is null, and ``columns``. A stateful processor that groups by a null key loses other keys of its task."""
    return df.select(F.coalesce(key, F.lit(0)).cast("long").alias(key), F.col(key).isNull().alias(UNKNOWN), *columns)


def named(key: tuple, n: int) -> pd.Series:
    """The key of ``keyed`` as a column of ``n`` rows, null where it was."""
    return pd.Series([None if key[1] else key[0]] * n, dtype="Int64")


class _Sessions(StatefulProcessor):
    """Keeps a user's latest login and turns a logout into a session. A login goes when no logout can follow in time."""

    def __init__(self, ttl_seconds: int):
        self.ttl_millis = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.login = handle.getValueState("login", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows of one user in one trigger; only the event time order matters.
        events = pd.concat(list(rows)).sort_values(["micros", "event_id"], kind="stable")
        state = self.login.get() if self.login.exists() else None
        logins = events["micros"].where(events["event_type"] == "login").astype("Int64").ffill()
        if state is not None:
            logins = logins.fillna(state[0])
        if logins.notna().any():
            last = int(logins.iloc[-1])
            if state is None or last != state[0]:
                self.login.update((last,))
                self.handle.registerTimer(last // 1000 + self.ttl_millis + 1)
        length = events["micros"] - logins
        ended = ((events["event_type"] == "logout") & (length <= self.ttl_millis * 1000)).fillna(False).astype(bool)
        out = pd.DataFrame({"event_id": events["event_id"][ended].astype("int64"), "session_duration": length[ended].astype("float64") / 1_000_000})
        out.insert(0, "user_id", named(key, len(out)).to_numpy())
        yield out.astype({"user_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A later login has a timer of its own.
        if self.login.exists() and self.login.get()[0] // 1000 + self.ttl_millis < expiredTimerInfo.getExpiryTimeInMs():
            self.login.clear()
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "session_duration": pd.Series(dtype="float64")})

    def close(self) -> None:
        return None


def stateful_sessions(events: DataFrame, ttl_seconds: int = SESSION_TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Login-to-logout seconds per user, with the login kept as state until ``ttl_seconds`` after it have passed.

    Time is that of the events: rows more than ``delay`` behind the latest event of the triggers before are dropped.
    """
    stamped = events.filter(F.col("event_type").isin("login", "logout")).withColumn("ts", F.col("ts").cast("timestamp"))
    relevant = keyed(stamped.withWatermark("ts", delay), "user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("micros"))
    return relevant.groupBy("user_id", UNKNOWN).transformWithStateInPandas(
        _Sessions(ttl_seconds), "user_id long, event_id long, session_duration double", "Append", "EventTime"
    )


def running_order_totals(orders: DataFrame) -> DataFrame:
    """Orders and spend per customer, cancelled orders taken back, and the segment that follows.

    One signed sum per customer: tasks sum before the shuffle, so a busy customer is one row per task.
    """
    sign = F.when(F.col("event_type") == "order_created", 1).when(F.col("event_type") == "order_cancelled", -1).otherwise(0)
    totals = orders.groupBy("customer_id").agg(
        F.sum(sign).cast("bigint").alias("total_orders"),
        F.sum(sign * F.coalesce("amount", F.lit(0.0))).alias("total_spent"),
        F.max(F.when(sign == 1, F.col("ts"))).alias("last_order_date"),
    )
    return totals.withColumn("customer_segment", customer_segment("total_orders", "total_spent"))


class _SegmentChanges(StatefulProcessor):
    """Adds each trigger's totals to a customer's state and reports a changed segment. Quiet customers are forgotten."""

    def __init__(self, ttl_days: int):
        self.ttl_millis = ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "orders long, spent double, segment string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        orders, spent, segment, last = self.totals.get() if self.totals.exists() else (0, 0.0, None, 0)
        for chunk in rows:
            sign = chunk["sign"]
            orders, spent = orders + int(sign.sum()), spent + float((sign * chunk["amount"]).sum())
            last = max(last, int(chunk["millis"].max()))
        new = "new" if orders == 0 else "vip" if spent >= 1000 else "loyal" if orders >= 5 else "regular"
        self.totals.update((orders, spent, new, last))
        self.handle.registerTimer(last + self.ttl_millis + 1)
        if new != segment:
            yield pd.DataFrame({"customer_id": named(key, 1), "old_segment": [segment], "new_segment": [new],
                                "total_orders": [orders], "total_spent": [spent]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A later order has a timer of its own.
        if self.totals.exists() and self.totals.get()[3] + self.ttl_millis < expiredTimerInfo.getExpiryTimeInMs():
            self.totals.clear()
        yield pd.DataFrame({"customer_id": pd.Series(dtype="int64"), "old_segment": pd.Series(dtype="object"), "new_segment": pd.Series(dtype="object"),
                            "total_orders": pd.Series(dtype="int64"), "total_spent": pd.Series(dtype="float64")})

    def close(self) -> None:
        return None


def segment_changes(orders: DataFrame, ttl_days: int = CUSTOMER_TTL_DAYS, delay: str = "1 day") -> DataFrame:
    """An event whenever a customer's segment differs from the one last reported.

    A customer without an order for ``ttl_days`` of event time is forgotten and starts anew. Orders more than ``delay``
    behind the latest one of the triggers before are dropped.
    """
    sign = F.when(F.col("event_type") == "order_created", 1).when(F.col("event_type") == "order_cancelled", -1).otherwise(0)
    stamped = orders.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    signed = keyed(stamped, "customer_id", sign.alias("sign"), F.coalesce("amount", F.lit(0.0)).alias("amount"), "ts", F.unix_millis("ts").alias("millis"))
    return signed.groupBy("customer_id", UNKNOWN).transformWithStateInPandas(
        _SegmentChanges(ttl_days),
        "customer_id long, old_segment string, new_segment string, total_orders long, total_spent double",
        "Update", "EventTime",
    )


def windowed_completeness(events: DataFrame, columns: Sequence[str], *, ts: str = "ts", size: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Share of present values per column and time window."""
    if events.isStreaming:
        events = events.withWatermark(ts, delay)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(window.alias("w")).agg(
        F.count("*").alias("n_rows"), *[F.count(c).alias(f"_v_{c}") for c in columns]
    )
    return out.select(
        F.col("w.start").alias("window_start"), "n_rows", *[(F.col(f"_v_{c}") / F.col("n_rows")).alias(f"{c}_completeness") for c in columns]
    )


def keyed_messages(df: DataFrame, key: str) -> DataFrame:
    """``key`` and JSON ``value``, the columns a Kafka sink takes."""
    return df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def run_available(stream: DataFrame, label: str, mode: str = "append", partition_by: str | None = None) -> DataFrame:
    """Run a stream over everything available now, into Parquet in the shared scratch folder.

    An update-mode stream is written batch by batch with its ``batch_id``.
    """
    spark = stream.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)  # keeps large state on disk, and stateful processors need it
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        if partition_by:
            writer = writer.partitionBy(partition_by)
        query: StreamingQuery = writer.format("parquet").option("path", out).start()
        schema = stream.schema
    else:
        # A batch that is run again after a failure replaces its own folder.
        query = writer.foreachBatch(
            lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch_id={i}")
        ).start()
        schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def latest_rows(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row each key had in an update-mode stream."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    best = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
