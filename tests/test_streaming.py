"""Streams over several files and triggers equal their batch twins."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.series import session_durations
from plumbline.streaming import jobs as S

SCHEMA = "user_id long, event_id long, event_type string, amount double, s long"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """One busy user and some quiet ones, in three files in time order."""
    rows = []
    for i in range(240):
        user = 1 if i % 2 else 2 + i % 6
        rows.append((user, i, ["login", "logout", "order_created", "order_cancelled", "order_created"][i * 7 % 5], float(i % 50 * 10), 86_400 + i * 500))
    path = str(tmp_path_factory.mktemp("events"))
    for part in range(3):
        spark.createDataFrame(rows[part * 80:(part + 1) * 80], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return S.file_stream(spark, path, SCHEMA, files_per_trigger=1).withColumn("ts", F.timestamp_seconds("s"))


def batch(spark, path):
    return spark.read.schema(SCHEMA).parquet(path).withColumn("ts", F.timestamp_seconds("s"))


def test_sessions_over_triggers(spark, events):
    got = S.run_available(S.stateful_sessions(stream(spark, events), ttl_seconds=20_000), "s").collect()
    want = session_durations(batch(spark, events), ttl_seconds=20_000).select("user_id", "event_id", "session_duration").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_totals_and_segment_changes(spark, events):
    def orders(df):
        return df.filter("event_type LIKE 'order%'").withColumnRenamed("user_id", "customer_id")

    want = {r.customer_id: (r.total_orders, r.total_spent, r.customer_segment) for r in S.running_order_totals(orders(batch(spark, events))).collect()}
    updates = S.run_available(S.running_order_totals(orders(stream(spark, events))), "t", mode="update")
    last = S.latest_rows(updates, ["customer_id"]).collect()
    assert {r.customer_id: (r.total_orders, r.total_spent, r.customer_segment) for r in last} == want
    changes = S.run_available(S.segment_changes(orders(stream(spark, events))), "c", mode="update")
    assert {r.customer_id: r.new_segment for r in S.latest_rows(changes, ["customer_id"]).collect()} == {k: v[2] for k, v in want.items()}


def stored_keys(spark, query_label, stream_frame, mode):
    """The keys that are left in the state after a stream has ended."""
    out, checkpoint = S.scratch_path(spark, "x"), S.scratch_path(spark, query_label)
    spark.conf.set(S.STATE_STORE, S.ROCKSDB)
    writer = stream_frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/{i}")).start().awaitTermination()
    name = "login" if mode == "append" else "totals"
    return {r.key[0] for r in spark.read.format("statestore").option("stateVarName", name).load(checkpoint).collect()}


@pytest.mark.parametrize("mode", ["append", "update"])
def test_state_of_quiet_keys_is_gone(spark, tmp_path, mode):
    path, day = str(tmp_path / mode), 86_400
    kind = "login" if mode == "append" else "order_created"
    for rows in ([(1, 1, kind, 5.0, 10), (2, 2, kind, 5.0, 20)], [(3, 3, kind, 5.0, 60 * day)], [(3, 4, kind, 5.0, 61 * day)], [(3, 5, kind, 5.0, 62 * day)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = stream(spark, path)
    frame = S.stateful_sessions(source) if mode == "append" else S.segment_changes(source.withColumnRenamed("user_id", "customer_id"))
    assert stored_keys(spark, f"state-{mode}", frame, mode) <= {3}


def test_late_rows_and_days(spark, tmp_path):
    path = str(tmp_path / "days")
    for rows in ([(1, 1, "x", 0.0, 10), (1, 2, "x", 0.0, 20), (2, 3, "x", 0.0, 30)], [(3, 4, "x", 0.0, 40 * 86_400)], [(3, 6, "x", 0.0, 40 * 86_400)], [(9, 5, "x", 0.0, 50)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = S.run_available(S.daily_active_users(stream(spark, path)), "d").collect()
    assert [(str(r.day), r.active_users) for r in got] == [("1970-01-01", 2)]  # the late user 9 is left out


def test_messages_and_dead_letters(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ('{"a": "x"}',), (None,)], "value string")
    parsed = S.parse_messages(df, T.StructType([T.StructField("a", T.LongType())]))
    letters = S.dead_letters(parsed, F.lit("t")).collect()
    assert sorted(r.message for r in letters) == ['{"a": ', '{"a": "x"}'] and letters[0].original_topic == "t"
    assert sorted(str(r.a) for r in S.good_messages(parsed).collect()) == ["1", "None"]


def test_rows_without_a_user_take_no_others_with_them(spark, tmp_path):
    path, names = str(tmp_path / "null"), ["login", "logout", "order_created"]
    rows = [(None if i % 4 == 0 else i % 29, i, names[i * 5 % 3], 10.0, 1_000 + i * 100) for i in range(300)]
    for part in range(2):
        spark.createDataFrame(rows[part * 150:(part + 1) * 150], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = S.run_available(S.stateful_sessions(stream(spark, path), ttl_seconds=20_000), "n").collect()
    want = session_durations(batch(spark, path), ttl_seconds=20_000).select("user_id", "event_id", "session_duration").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and any(r.user_id is None for r in got)
    orders = batch(spark, path).where("event_type = 'order_created'").withColumnRenamed("user_id", "customer_id")
    changes = S.run_available(S.segment_changes(stream(spark, path).where("event_type = 'order_created'").withColumnRenamed("user_id", "customer_id")), "m", mode="update")
    segments = {r.customer_id: r.customer_segment for r in S.running_order_totals(orders).collect()}
    assert {r.customer_id: r.new_segment for r in S.latest_rows(changes, ["customer_id"]).collect()} == segments and None in segments
