"""Streaming operators over events (event_id, user_id, event_type, ts, value, ...).

Each takes and gives a DataFrame and works on a stream; those marked so work
on batches, too, with the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of Parquet files, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def event_hash() -> Column:
    """md5 of user, type and time."""
    return F.md5(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.col("ts").cast("string")))


def dedup(events: DataFrame, within: str = "5 minutes") -> DataFrame:
    """The first of events with the same hash inside the watermark (stream)."""
    return events.withColumn("event_hash", event_hash()).withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_hash"])


def dedup_batch(events: DataFrame, minutes: int = 5) -> DataFrame:
    """The same on a batch: an event goes if one of its hash came in the minutes before it."""
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(W.partitionBy("event_hash").orderBy("ts", "event_id")))
    out = events.withColumn("event_hash", event_hash()).withColumn("_gap", gap)
    return out.filter(F.col("_gap").isNull() | (F.col("_gap") > minutes * 60_000_000)).drop("_gap")


def late_policy(events: DataFrame, now: Column, future: str = "5 minutes", past: str = "30 days") -> DataFrame:
    """Adds reject: future, too_old, bad_user or null (stream and batch)."""
    reason = F.when(F.col("ts") > now + F.expr(f"interval {future}"), "future").when(F.col("ts") < now - F.expr(f"interval {past}"), "too_old").when(F.col("user_id").isNull(), "bad_user")
    return events.withColumn("reject", reason)


def routed(events: DataFrame, filters: list[Column], rules: list[tuple[int, Column, str]], default: str = "default") -> DataFrame:
    """Events that pass all filters, with the route of the first rule that holds, by priority (stream and batch)."""
    out = events.filter(reduce(lambda a, b: a & b, filters, F.lit(True)))
    route = F.lit(default)
    for _, condition, name in sorted(rules, key=lambda r: r[0]):
        route = F.when(condition, name).otherwise(route)
    return out.withColumn("route", route)


def window_stats(events: DataFrame, width: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """start_ts, event_type, n, errors, error_rate, status of fixed windows (stream and batch)."""
    bad = F.col("value").isNull() | (F.col("value") < 0)
    a = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("errors"))
    rate = F.col("errors") / F.col("n")
    return a.select(F.col("w.start").alias("start_ts"), "event_type", "n", "errors", rate.alias("error_rate"), F.when(rate > 0.1, "degraded").otherwise("healthy").alias("status"))


def session_stats(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start_ts, n, mean of sessions by gap (stream and batch)."""
    a = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return a.select("user_id", F.col("s.start").alias("start_ts"), "n", "mean")


def sliding_counts(events: DataFrame, item: str = "item_id", width: str = "1 hour", step: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start_ts, item, n of moving windows (stream and batch)."""
    a = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), item).agg(F.count(F.lit(1)).alias("n"))
    return a.select(F.col("w.start").alias("start_ts"), item, "n")


def ordered(events: DataFrame) -> DataFrame:
    """Adds position: the event's place in its user's time order (batch)."""
    return events.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))


def dead_letters(events: DataFrame, now: Column, retries: int = 3) -> DataFrame:
    """Adds dlq_reason: past_deadline, exhausted, malformed or null, over columns deadline, retry_count, malformed (stream and batch)."""
    reason = F.when(F.col("malformed").isNotNull(), "malformed").when(F.col("deadline") < now, "past_deadline").when(F.col("retry_count") >= retries, "exhausted")
    return events.withColumn("dlq_reason", reason)


def replay(letters: DataFrame, ids: DataFrame) -> DataFrame:
    """Dead letters of the given ids, to be tried anew."""
    return letters.join(ids, "event_id", "left_semi").withColumn("retry_count", F.lit(0)).drop("dlq_reason")


def reconcile(records: DataFrame, seconds: int = 60) -> DataFrame:
    """entity_id, versions, conflicts, and the newest source and value of records (entity_id, source, ts, value): neighbours of different sources inside the seconds conflict (batch)."""
    w = W.partitionBy("entity_id").orderBy("ts", "source")
    near = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) <= seconds * 1_000_000
    own = records.withColumn("conflict", F.coalesce(near & (F.lag("source").over(w) != F.col("source")), F.lit(False)))
    newest = F.max(F.struct("ts", "source", "value"))
    return own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("versions"), F.count_if("conflict").alias("conflicts"), newest.alias("x")).select("entity_id", "versions", "conflicts", F.col("x.source").alias("source"), F.col("x.value").alias("value"))


def freshness_levels(records: DataFrame, now: Column) -> DataFrame:
    """level, n: ages of 1 s, 10 s, 1 min and 10 min at most, and beyond (batch)."""
    age = (F.unix_micros(now) - F.unix_micros("ts")) / 1e6
    level = F.when(age <= 1, "real_time").when(age <= 10, "near_real_time").when(age <= 60, "recent").when(age <= 600, "stale").otherwise("expired")
    return records.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def version_log(records: DataFrame) -> DataFrame:
    """entity_id, source, version, content hash of each record (batch)."""
    v = F.row_number().over(W.partitionBy("entity_id", "source").orderBy("ts", "value"))
    return records.select("entity_id", "source", "ts", v.alias("version"), F.sha2(F.col("value").cast("string"), 256).alias("content_hash"))


def written_rounds(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write all that is available as Parquet, with a checkpoint, and wait."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
