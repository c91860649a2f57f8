"""Totals of closed and open customers against the batch; the state holds recent customers only."""

import random

from plumbline.session import scratch_path
from plumbline.streaming import closing as K
from plumbline.streaming import jobs as S

SCHEMA = "customer_id long, event_type string, amount double, ts timestamp"
DAY = 86_400


def test_totals_equal_the_batch_and_state_stays_small(spark):
    r = random.Random(5)
    created, cancelled = "order_created", "order_cancelled"
    weeks = []
    for week in range(5):  # each week has customers of its own, a busy one, a null one, and the fourth a late cancel of the first week's
        at = week * 7 * DAY
        rows = [(100 * week + r.randrange(30), r.choice([created, created, cancelled, "viewed"]), r.choice([float(r.randrange(900)), None]), at + r.randrange(7 * DAY)) for _ in range(200)]
        rows += [(7777, created, 1.0, at + r.randrange(7 * DAY)) for _ in range(100)] + [(None, created, 2.0, at + DAY)]
        rows += [(3, cancelled, 5.0, at + 3 * DAY)] * (week == 3)
        weeks.append([(c, e, a, t) for c, e, a, t in rows])
    folder, out, state = (scratch_path(spark, n) for n in ("orders", "parts", "state"))
    sizes = []
    for rows in weeks:
        frame = spark.createDataFrame(rows, "customer_id long, event_type string, amount double, s long").selectExpr("customer_id", "event_type", "amount", "timestamp_seconds(s) AS ts")
        frame.coalesce(2).write.mode("append").parquet(folder)
        K.start(K.closed_parts(S.file_stream(spark, folder, SCHEMA), ttl_days=4), out, state).awaitTermination()
        sizes.append(K.open_parts(spark, state).count())
        batch = S.running_order_totals(spark.read.schema(SCHEMA).parquet(folder).where("event_type <> 'viewed'"))
        columns = ["customer_id", "total_orders", "total_spent", "last_order_date", "customer_segment"]
        got, want = (sorted(map(tuple, df.select(columns).collect()), key=str) for df in (K.totals(spark, out, state), batch))
        assert got == want
    parts = spark.read.schema(K.PART).parquet(out)
    both = parts.unionByName(K.open_parts(spark, state)).where("customer_id = 3")
    assert parts.where("customer_id = 3").count() >= 1 and both.count() == 2  # closed, and opened again by the late cancel
    # All customers together are about 150; the state holds those of the last days.
    assert max(sizes) < 75 and K.totals(spark, out, state).count() > 120


def test_calls_to_the_state_do_not_grow_with_customers(spark):
    """3,000 customers in two stretches: the state has a list for each bucket, closed and open parts add up to the batch."""
    folder, out, state = (scratch_path(spark, n) for n in ("orders", "parts", "state"))
    for week in range(2):
        orders = spark.range(4_000).selectExpr(
            f"nullif(id % 3000 + {week} * 1500, 5) AS customer_id", "IF(id % 7 = 0, 'order_cancelled', 'order_created') AS event_type",
            "CAST(id % 11 AS DOUBLE) AS amount", f"timestamp_seconds({week * 7 * DAY} + id + 1) AS ts",
        )
        orders.coalesce(2).write.mode("append").parquet(folder)
        K.start(K.closed_parts(S.file_stream(spark, folder, SCHEMA), ttl_days=2), out, state).awaitTermination()
        keys = spark.read.format("statestore").option("stateVarName", K.STATE).load(state).select("key").distinct().count()
        assert 0 < keys <= K.BUCKETS
    batch = S.running_order_totals(spark.read.schema(SCHEMA).parquet(folder))
    columns = ["customer_id", "total_orders", "total_spent", "last_order_date", "customer_segment"]
    got, want = (sorted(map(tuple, df.select(columns).collect()), key=str) for df in (K.totals(spark, out, state), batch))
    assert got == want and len(got) == 4_500
    assert spark.read.schema(K.PART).parquet(out).count() == 1_500 and K.open_parts(spark, state).count() == 3_000
