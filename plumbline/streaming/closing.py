"""Running order totals with bounded state: customers who went quiet leave the state for a table.

A customer's orders are summed in the state while they come. After ``ttl_days`` of event time without one, a timer hands
the sums as a part to the table of closed parts and takes them out of the state. A cancel that comes later opens the customer again
with what it takes back, and that becomes a further part: sums add up, so no part is ever changed and nothing is looked up. The totals
at any time are the closed parts and the open state, which Spark's state reader gives. The state holds the customers of the
last ``ttl_days`` and no more.

The state has one list of customers for each of ``BUCKETS`` hashes, which is read, summed and stored as a whole when orders of
its customers come: calls to the state cost far more than sums, so there are few calls however many customers there are. A
checkpoint belongs to one number of buckets.

Defined results: a null amount is 0; other kinds of events are not counted; rows without a time are left out, and
so are rows more than ``delay`` behind the latest of the triggers before, as in any stream with a watermark; a null customer is one
customer; an empty stream gives no parts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.functions.scalars import customer_segment
from plumbline.streaming.jobs import CUSTOMER_TTL_DAYS, ROCKSDB, STATE_STORE, UNKNOWN, keyed

# The processor travels to the executors by value, so these need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = -(2**63)  # no order was created
BUCKETS = 512
PART = "customer_id long, total_orders long, total_spent double, last_order long"
STATE = "open"
OPEN = "customer_id long, unknown boolean, total_orders long, total_spent double, last_order long, last long"
COLUMNS = [c.split()[0] for c in OPEN.split(", ")]


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each customer, whose key may be the one of those without."""
    by = rows.groupby(["customer_id", "unknown"], as_index=False, sort=False)
    return by.agg({"total_orders": "sum", "total_spent": "sum", "last_order": "max", "last": "max"})


class _OpenTotals(StatefulProcessor):
    """The sums of one bucket's customers since their last parts were handed over."""

    def __init__(self, ttl_days: int):
        self.ttl_millis = ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState(STATE, OPEN)
        self.due = handle.getValueState("due", "millis long")  # when the first customer has been quiet for long enough

    def read(self) -> pd.DataFrame:
        frame = pd.DataFrame(list(self.open.get()) if self.due.exists() else [], columns=COLUMNS)
        kinds = dict.fromkeys(COLUMNS, "int64") | {"unknown": "bool", "total_spent": "float64"}
        return frame.astype(kinds)

    def store(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.open.clear()
            self.due.clear()
            return
        self.open.put(list(zip(*[rows[c].tolist() for c in COLUMNS])))
        due = int(rows["last"].min()) + self.ttl_millis + 1
        self.due.update((due,))
        self.handle.registerTimer(due)

    def part(self, closed: pd.DataFrame | None = None) -> pd.DataFrame:
        frame = pd.DataFrame(columns=COLUMNS) if closed is None else closed
        known = frame["customer_id"].astype("Int64").mask(frame["unknown"].astype(bool))
        frame = frame.assign(customer_id=known)[["customer_id", "total_orders", "total_spent", "last_order"]]
        return frame.astype({"customer_id": "Int64", "total_orders": "int64", "total_spent": "float64", "last_order": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = self.read()
        for chunk in rows:  # one piece of a busy bucket at a time
            new = pd.DataFrame({
                "customer_id": chunk["customer_id"], "unknown": chunk["unknown"], "total_orders": chunk["sign"].astype("int64"),
                "total_spent": chunk["sign"] * chunk["amount"], "last_order": chunk["millis"].where(chunk["sign"] == 1, NEVER), "last": chunk["millis"],
            })
            new = _summed(new)
            sums = _summed(pd.concat([sums, new])) if len(sums) else new
        self.store(sums[COLUMNS])
        yield self.part()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # One timer closes all customers whose time is over. Those of customers who ordered since find nothing due.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        if not self.due.exists() or self.due.get()[0] > now:
            yield self.part()
            return
        sums = self.read()
        over = sums["last"] + self.ttl_millis < now
        self.store(sums[~over])
        yield self.part(sums[over])

    def close(self) -> None:
        return None


def closed_parts(orders: DataFrame, ttl_days: int = CUSTOMER_TTL_DAYS, delay: str = "1 day") -> DataFrame:
    """A stream of parts: the sums of customers who went quiet."""
    sign = F.when(F.col("event_type") == "order_created", 1).when(F.col("event_type") == "order_cancelled", -1)
    stamped = orders.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counted = keyed(stamped, "customer_id", sign.alias("sign"), F.coalesce("amount", F.lit(0.0)).alias("amount"), "ts", F.unix_millis("ts").alias("millis"))
    kept = counted.where("sign IS NOT NULL AND ts IS NOT NULL")
    bucket = F.pmod(F.xxhash64("customer_id", UNKNOWN), F.lit(BUCKETS)).cast("int")
    return kept.withColumn("bucket", bucket).withColumnRenamed(UNKNOWN, "unknown").groupBy("bucket").transformWithStateInPandas(_OpenTotals(ttl_days), PART, "Append", "EventTime")


def start(parts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all parts that are due now to the table ``out``, each once."""
    parts.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    writer = parts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("parquet").option("path", out).start()


def open_parts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sums still in the state, after the last trigger that ended."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    customer = F.when(~F.col("list_element.unknown"), F.col("list_element.customer_id")).alias("customer_id")
    return state.select(customer, "list_element.total_orders", "list_element.total_spent", "list_element.last_order")


def totals(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """Orders, spend, last order and segment of every customer, from the closed parts and the open state."""
    parts = spark.read.schema(PART).parquet(out).unionByName(open_parts(spark, checkpoint))
    summed = parts.groupBy("customer_id").agg(
        F.sum("total_orders").alias("total_orders"), F.sum("total_spent").alias("total_spent"),
        F.timestamp_millis(F.max(F.when(F.col("last_order") != NEVER, F.col("last_order")))).alias("last_order_date"),
    )
    return summed.withColumn("customer_segment", customer_segment("total_orders", "total_spent"))
