"""Streams of small files against the batch operators on the same rows."""

import compare
import pytest
from pyspark.sql import functions as F

from tidewater.streaming import events as S


@pytest.fixture
def stream(spark, tmp_path):
    events = spark.read.parquet(f"{compare.DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(300)
    again = events.filter("event_id % 10 = 0")
    # later files hold later times, the last one repeats some events of the one before it, and ends far in the future to close windows
    rows = events.orderBy("ts").collect()
    parts = [rows[:100], rows[100:200], rows[200:]]
    end = rows[0].asDict() | {"event_id": -1, "user_id": -1, "ts": rows[-1].ts.replace(year=2030)}
    for i, part in enumerate(parts):
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.createDataFrame([tuple(end[c] for c in events.columns)], events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    return events, again, S.source(spark, f"{tmp_path}/in/*", events.schema), tmp_path


def run(spark, out, path, name):
    S.written_rounds(out, f"{path}/{name}", f"{path}/{name}-state")
    return spark.read.parquet(f"{path}/{name}")


def same(a, b):
    key = sorted(a.columns)
    assert sorted(map(tuple, a.select(key).collect()), key=repr) == sorted(map(tuple, b.select(key).collect()), key=repr)


def test_window_stats(spark, stream):
    batch, _, live, path = stream
    same(run(spark, S.window_stats(live, "1 day", "400 days"), path, "w").filter("start_ts < '2029-01-01'"), S.window_stats(batch, "1 day"))


def test_session_stats(spark, stream):
    batch, _, live, path = stream
    got = run(spark, S.session_stats(live, "6 hours", "400 days"), path, "s").filter("user_id >= 0")
    same(got.select("user_id", "start_ts", "n"), S.session_stats(batch, "6 hours").select("user_id", "start_ts", "n"))


def test_sliding_counts(spark, stream):
    batch, _, live, path = stream
    same(run(spark, S.sliding_counts(live, "user_id", "12 hours", "6 hours", "400 days"), path, "c").filter("user_id >= 0"), S.sliding_counts(batch, "user_id", "12 hours", "6 hours"))


def test_dedup(spark, stream):
    batch, again, _, path = stream
    batch.coalesce(1).write.parquet(f"{path}/twice/0")
    again.coalesce(1).write.parquet(f"{path}/twice/1")
    live = S.source(spark, f"{path}/twice/*", batch.schema)
    got = run(spark, S.dedup(live, "400 days"), path, "d")
    same(got.select("event_id"), S.dedup_batch(batch).select("event_id"))


def test_routes_and_rejects(spark, stream):
    batch, _, live, path = stream
    now = F.lit("2024-01-20").cast("timestamp")
    got = run(spark, S.late_policy(live.filter("event_id >= 0"), now), path, "l").select("event_id", "reject")
    same(got, S.late_policy(batch, now).select("event_id", "reject"))
    assert {r.reject for r in got.collect()} <= {None, "future", "too_old"}


def test_empty_batches(spark):
    none = spark.read.parquet(f"{compare.DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(0)
    for out in (S.dedup_batch(none), S.ordered(none), S.window_stats(none), S.session_stats(none), S.sliding_counts(none, "user_id")):
        assert out.count() == 0
