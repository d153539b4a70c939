"""Registered queries of the streaming operators on batches, of the envelope, and of stacked sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.views import CONTENT, INTERACTIONS, PURCHASES, content, interactions, purchases, table
from ..streaming import events as S
from .q_users import rounded
from .registry import query


def stream_events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


#: Events by the minute, so that hashes repeat.
MINUTES = "m AS (SELECT event_id, user_id % 10 AS user_id, event_type, date_trunc('hour', ts) AS ts, value FROM events)"


def by_hour(spark, sf_dir):
    return stream_events(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts")).withColumn("user_id", F.col("user_id") % 10)


@query(f"""WITH {MINUTES}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) AS gap FROM m) SELECT event_id FROM g WHERE gap IS NULL OR gap > INTERVAL 5 MINUTE""")
def dedup_window(spark, sf_dir):
    return S.dedup_batch(by_hour(spark, sf_dir)).select("event_id")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position FROM events")
def per_user_ordering(spark, sf_dir):
    return S.ordered(stream_events(spark, sf_dir)).select("event_id", "position")


@query(f"""SELECT event_id, CASE WHEN ts > {NOW} + INTERVAL 5 MINUTE THEN 'future' WHEN ts < {NOW} - INTERVAL 10 DAY THEN 'too_old' WHEN user_id IS NULL THEN 'bad_user' END AS reject FROM events""")
def late_data_policy(spark, sf_dir):
    return S.late_policy(stream_events(spark, sf_dir), now(), past="10 days").select("event_id", "reject")


@query("""SELECT event_id, CASE WHEN value > 80 THEN 'high_value' WHEN event_type = 'click' THEN 'clicks' ELSE 'default' END AS route FROM events WHERE value >= 1 AND event_type <> 'error'""")
def event_routing(spark, sf_dir):
    return S.routed(stream_events(spark, sf_dir), [F.col("value") >= 1, F.col("event_type") != "error"], [(0, F.col("event_type") == "click", "clicks"), (5, F.col("value") > 80, "high_value")]).select("event_id", "route")


@query("""WITH a AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, event_type, count(*) AS n, count(*) FILTER (value IS NULL OR value < 0) AS errors FROM events GROUP BY 1, 2)
SELECT start_ts, event_type, n, errors, round(errors / n, 6) AS error_rate, CASE WHEN errors / n > 0.1 THEN 'degraded' ELSE 'healthy' END AS status FROM a""")
def stream_stats(spark, sf_dir):
    return rounded(S.window_stats(stream_events(spark, sf_dir), "1 hour"))


@query(f"""WITH {INTERACTIONS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start_ts, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY user_id, s""")
def stream_session_metrics(spark, sf_dir):
    return rounded(S.session_stats(interactions(spark, sf_dir), "6 hours"))


@query(f"""WITH {INTERACTIONS} SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start_ts, item_id, count(*) AS n FROM interactions, range(0, 2) t(k) GROUP BY 1, 2""")
def sliding_item_counts(spark, sf_dir):
    return S.sliding_counts(interactions(spark, sf_dir), width="12 hours", step="6 hours")


@query("""WITH a AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start_ts, count(*) AS n, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1) SELECT start_ts, n, round(median, 6) AS median FROM a""")
def tumbling_event_counts(spark, sf_dir):
    a = stream_events(spark, sf_dir).groupBy(F.window("ts", "1 day")["start"].alias("start_ts")).agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("median"))
    return rounded(a)


#: Order lines as records of two sources.
RECORDS = "r AS (SELECT l_orderkey AS entity_id, CASE WHEN l_linenumber % 2 = 0 THEN 'stream' ELSE 'batch' END AS source, CAST(l_shipdate AS TIMESTAMP) + l_linenumber * INTERVAL 20 SECOND AS ts, CAST(l_quantity AS DOUBLE) AS value FROM lineitem)"


def records(spark, sf_dir):
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + 20 * F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.when(F.col("l_linenumber") % 2 == 0, "stream").otherwise("batch").alias("source"), ts.alias("ts"), F.col("l_quantity").cast("double").alias("value"))


@query(f"""WITH {RECORDS}, c AS (SELECT *, coalesce(ts - lag(ts) OVER w <= INTERVAL 60 SECOND AND lag(source) OVER w <> source, false) AS c FROM r WINDOW w AS (PARTITION BY entity_id ORDER BY ts, source))
SELECT entity_id, count(*) AS versions, count(*) FILTER (c) AS conflicts, max({{'ts': ts, 'source': source, 'value': value}}).source AS source, max({{'ts': ts, 'source': source, 'value': value}}).value AS value FROM c GROUP BY 1""")
def batch_stream_reconcile(spark, sf_dir):
    return S.reconcile(records(spark, sf_dir))


@query(f"""WITH a AS (SELECT date_diff('microsecond', ts, {NOW}) / 1e6 / 86400 AS d FROM events) SELECT CASE WHEN d <= 1 THEN 'real_time' WHEN d <= 10 THEN 'near_real_time' WHEN d <= 60 THEN 'recent' WHEN d <= 600 THEN 'stale' ELSE 'expired' END AS level, count(*) AS n FROM a GROUP BY 1""")
def freshness_levels(spark, sf_dir):
    # days as seconds, so that the month of events spreads over the levels
    days = (F.unix_micros(now()) - F.unix_micros("ts")) / 86400
    aged = stream_events(spark, sf_dir).select(F.timestamp_micros((F.unix_micros(now()) - days).cast("bigint")).alias("ts"))
    return S.freshness_levels(aged, now())


@query(f"WITH {RECORDS} SELECT entity_id, source, CAST(max(v) AS INTEGER) AS version FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source ORDER BY ts, value) AS v FROM r) GROUP BY 1, 2")
def version_log(spark, sf_dir):
    return S.version_log(records(spark, sf_dir)).groupBy("entity_id", "source").agg(F.max("version").alias("version"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'malformed' WHEN ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-20' THEN 'past_deadline' WHEN event_id % 5 >= 3 THEN 'exhausted' END AS dlq_reason FROM events""")
def deadline_and_dlq(spark, sf_dir):
    e = stream_events(spark, sf_dir).withColumns({"deadline": F.col("ts") + F.expr("interval 1 day"), "retry_count": (F.col("event_id") % 5).cast("int"), "malformed": F.when(F.col("event_id") % 11 == 0, "x")})
    return S.dead_letters(e, now()).select("event_id", "dlq_reason")


@query("SELECT event_id, 0 AS retry_count FROM events WHERE event_id % 5 >= 3 AND event_type = 'error'")
def dlq_replay(spark, sf_dir):
    e = stream_events(spark, sf_dir).withColumns({"deadline": F.lit(None).cast("timestamp"), "retry_count": (F.col("event_id") % 5).cast("int"), "malformed": F.lit(None).cast("string")})
    letters = S.dead_letters(e, now()).filter("dlq_reason = 'exhausted'")
    return S.replay(letters, e.filter("event_type = 'error'").select("event_id")).select("event_id", "retry_count")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, ts, json_extract_string(props, '$.k') AS k FROM events")
def event_json_codec(spark, sf_dir):
    e = stream_events(spark, sf_dir).select("event_id", "event_type", "user_id", "ts", F.from_json("props", "map<string,string>").alias("payload"))
    return files.from_envelope(files.to_envelope(e)).filter("malformed is null").select("event_id", "event_type", "user_id", "ts", F.col("payload.k").alias("k"))


@query(f"""WITH {INTERACTIONS}, {PURCHASES}, u AS (SELECT 'events' AS dataset, user_id, item_id, rating, ts, interaction_type FROM interactions UNION ALL SELECT 'orders', user_id, item_id, rating, ts, 'rating' FROM purchases)
SELECT dataset, interaction_type, dayname(ts) AS day_name, isodow(ts) >= 6 AS is_weekend, count(*) AS n, round(avg(rating), 6) AS mean FROM u GROUP BY ALL""")
def unify_all_datasets(spark, sf_dir):
    every = files.unify({"events": interactions(spark, sf_dir).drop("event_id", "value"), "orders": purchases(spark, sf_dir).select("user_id", "item_id", "rating", "ts")})
    return rounded(every.groupBy("dataset", "interaction_type", "day_name", "is_weekend").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean")))


@query(f"""WITH {INTERACTIONS}, {CONTENT}, a AS (SELECT item_id, count(*) AS n, count(DISTINCT user_id) AS users, avg(rating) AS mean FROM interactions GROUP BY 1)
SELECT content_id, title, vec_id IS NOT NULL AS has_embedding, coalesce(n, 0) AS n, coalesce(users, 0) AS users, round(mean, 6) AS mean FROM content LEFT JOIN embeddings ON vec_id = content_id LEFT JOIN a ON item_id = content_id""")
def feature_store_content(spark, sf_dir):
    return rounded(files.feature_store(content(spark, sf_dir), table(spark, sf_dir, "embeddings"), interactions(spark, sf_dir)).select("content_id", "title", "has_embedding", "n", "users", "mean"))


@query("SELECT c_custkey AS user_id, c_name AS name, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def schema_mapping_rename(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return files.renamed(both, {"c_custkey": "user_id", "c_name": "name", "n_name": "country"}).select("user_id", "name", "country")


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS ts, CAST(o_totalprice AS DOUBLE) AS rating FROM orders""")
def type_coercion(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.when(F.col("o_orderkey") % 3 == 0, "bad").when(F.col("o_orderkey") % 3 == 1, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ts"), F.col("o_totalprice").cast("string").alias("rating"))
    return files.coerced(raw)


@query("""SELECT p_partkey AS content_id, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE len(string_split(p_name, ' ')) END AS n_genres FROM part""")
def genre_string_to_array(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content_id"), F.when(F.col("p_partkey") % 8 == 0, None).when(F.col("p_partkey") % 4 == 0, "(no genres listed)").otherwise(F.replace("p_name", F.lit(" "), F.lit("|"))).alias("genres"))
    return raw.select("content_id", F.size(files.genre_array("genres")).cast("long").alias("n_genres"))


@query("""SELECT p_partkey AS content_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN CAST(1900 + p_partkey % 120 AS INTEGER) END AS publication_year FROM part""")
def year_from_title(spark, sf_dir):
    year = (1900 + F.col("p_partkey") % 120).cast("string")
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" ("), year, F.lit(")"))).otherwise(F.col("p_name")).alias("title"))
    return files.year_from_title(raw).select("content_id", "title", "publication_year")
