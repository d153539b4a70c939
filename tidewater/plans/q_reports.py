"""Registered queries of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as R
from ..operators import reports as P
from ..sources.views import CONTENT, INTERACTIONS, content, interactions, table
from .q_cleaning import GAPS, gaps
from .q_evaluation import SERIES, series
from .q_preferences import HORIZONS, wide
from .q_recommend import GENRE_TOP, genre_lists
from .q_users import SESSIONS, rounded, sessions
from .registry import query


@query(f"""WITH {INTERACTIONS}, a AS (SELECT count(DISTINCT user_id) / (SELECT count(*) FROM customer) AS e, count(rating) / count(*) AS r, count(*) FILTER (ts >= (SELECT max(ts) FROM interactions) - INTERVAL 10 DAY) / count(*) AS f FROM interactions)
SELECT round(e, 6) AS engagement, round(r, 6) AS rating_coverage, round(f, 6) AS freshness, round((e + r + f) / 3, 6) AS score, CASE WHEN (e + r + f) / 3 >= 0.9 THEN 'A' WHEN (e + r + f) / 3 >= 0.7 THEN 'B' WHEN (e + r + f) / 3 >= 0.5 THEN 'C' ELSE 'D' END AS grade FROM a""")
def data_quality_dashboard(spark, sf_dir):
    return rounded(P.quality_dashboard(interactions(spark, sf_dir), table(spark, sf_dir, "customer"), 10))


@query(f"WITH {CONTENT} SELECT count(popularity_score) AS n, round(avg(popularity_score), 6) AS mean, round(quantile_cont(popularity_score, 0.5), 6) AS median, round(stddev_samp(popularity_score), 6) AS deviation, min(popularity_score) AS lowest, max(popularity_score) AS highest, round(skewness(popularity_score), 6) AS skew FROM content")
def quality_distribution(spark, sf_dir):
    return rounded(P.distribution(content(spark, sf_dir), "popularity_score"))


@query(f"WITH {GAPS} SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM gaps)) + 1e-9, 6) AS price, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, 'Unknown') AS o_orderpriority FROM gaps")
def impute_domain(spark, sf_dir):
    own = gaps(spark, sf_dir).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return rounded(P.impute_domain(own, {"price": 0.0}, {"o_orderpriority": "Unknown"}).select("o_orderkey", "price", "o_orderpriority"), 1e-9)


@query("""WITH i AS (SELECT event_type AS field, CASE WHEN value > 80 THEN 'CRITICAL' WHEN value > 40 THEN 'ERROR' ELSE 'WARNING' END AS level, CASE WHEN value > 80 THEN 3 WHEN value > 40 THEN 2 ELSE 1 END AS w FROM events)
SELECT field, count(*) AS issues, CASE max(w) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'ERROR' ELSE 'WARNING' END AS worst, count(*) > 3 AS flagged FROM i GROUP BY 1""")
def quality_rollup(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return P.issue_rollup(own.select(F.col("event_type").alias("field"), F.when(F.col("value") > 80, "CRITICAL").when(F.col("value") > 40, "ERROR").otherwise("WARNING").alias("level")))


FOLLOW = f"{SESSIONS}, fo AS (SELECT user_id, interaction_type AS first, lead(interaction_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS second FROM s)"


@query(f"{FOLLOW}, n AS (SELECT user_id, first, second, count(*) AS n FROM fo WHERE second IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, first) AS p FROM n) SELECT user_id, first, second, n, round(p, 6) AS p FROM p WHERE n >= 3")
def session_bigrams(spark, sf_dir):
    return rounded(P.session_bigrams(sessions(spark, sf_dir), "interaction_type"))


@query(f"{SESSIONS}, f AS (SELECT interaction_type AS kind, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS i FROM s) SELECT kind, count(*) AS n, count(*) FILTER (i = 1) AS starts FROM f GROUP BY 1")
def sequence_stats(spark, sf_dir):
    return P.sequence_stats(sessions(spark, sf_dir), "interaction_type")


@query(f"{GENRE_TOP}, n2 AS (SELECT user_id, content_type, count(*) AS n FROM g JOIN content ON item_id = content_id GROUP BY 1, 2) SELECT user_id, CAST(sum(n) AS BIGINT) AS items, count(*) AS types, round(max(n) / sum(n), 6) AS largest_share FROM n2 GROUP BY 1")
def recommendation_diversity(spark, sf_dir):
    return rounded(P.list_diversity(genre_lists(spark, sf_dir), content(spark, sf_dir)))


@query(f"{GENRE_TOP}, y AS (SELECT user_id, 1960 + item_id * 7 % 60 AS year FROM g) SELECT user_id, round(stddev_pop(year), 6) AS deviation, max(year) - min(year) AS year_range, round(1 / (1 + avg(2020 - year)), 6) AS freshness FROM y GROUP BY 1")
def temporal_metrics(spark, sf_dir):
    years = content(spark, sf_dir).select(F.col("content_id").alias("item_id"), (1960 + F.col("content_id") * 7 % 60).alias("year"))
    return rounded(P.temporal_metrics(genre_lists(spark, sf_dir), years, 2020))


@query(f"""WITH {SERIES}, a AS (SELECT metric, CASE WHEN value > 60 THEN 'critical' ELSE 'warning' END AS severity, ts FROM s WHERE value > 40), g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY metric, severity ORDER BY ts))) / 3.6e9 AS gap FROM a)
SELECT metric, severity, count(*) AS alerts, round(avg(gap), 6)::DOUBLE AS mean_hours FROM g GROUP BY 1, 2""")
def alert_statistics(spark, sf_dir):
    a = series(spark, sf_dir).filter("value > 40").select("metric", F.when(F.col("value") > 60, "critical").otherwise("warning").alias("severity"), F.col("ts").cast("timestamp").alias("ts"))
    return rounded(P.alert_statistics(a))


@query(f"{HORIZONS} SELECT genre, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM c WHERE horizon = 1000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def global_preference_stats(spark, sf_dir):
    return rounded(P.key_statistics(wide(spark, sf_dir).filter("horizon = 1000"), "genre", "value"))


@query(f"""{FOLLOW}, n AS (SELECT first, second, count(*) AS n FROM fo WHERE second IS NOT NULL GROUP BY 1, 2), t AS (SELECT first, second, row_number() OVER (PARTITION BY first ORDER BY n DESC, second) AS k FROM n QUALIFY k <= 2),
l AS (SELECT user_id, session, interaction_type AS last, lag(interaction_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id, session ORDER BY ts DESC, event_id DESC) AS i FROM s), z AS (SELECT before, last FROM l WHERE i = 1 AND before IS NOT NULL)
SELECT count(*) AS sessions, count(t.first) AS hits, round(count(t.first) / count(*), 6) AS rate FROM z LEFT JOIN t ON before = first AND last = second""")
def next_item_hit_rate(spark, sf_dir):
    own = sessions(spark, sf_dir)
    return rounded(P.hit_rate_of_next(own, R.transition_matrix(own, "interaction_type"), "interaction_type"))


@query(f"""WITH {INTERACTIONS}, {CONTENT} SELECT 'content_features' AS feature_set, 'content' AS category, count(*) AS rows, 7 AS columns, 3 AS numeric, 3 AS categorical, round(100.0 * (7 * count(*) - count(content_id) - count(title) - count(genres) - count(content_type) - count(creator) - count(duration) - count(popularity_score)) / (7 * count(*)), 6)::DOUBLE AS missing_percent FROM content
UNION ALL SELECT 'user_item_interaction', 'user', count(*), 3, 3, 0, round(100.0 * (3 * count(*) - count(user_id) - count(item_id) - count(rating)) / (3 * count(*)), 6)::DOUBLE FROM interactions""")
def feature_set_report(spark, sf_dir):
    return rounded(P.feature_set_report({"content_features": content(spark, sf_dir), "user_item_interaction": interactions(spark, sf_dir).select("user_id", "item_id", "rating")}))


@query(f"""WITH {CONTENT}, w AS (SELECT content_id, list_filter(regexp_split_to_array(lower(content_type), '\\s+'), lambda x: x <> '') AS x, content_type, creator, genres, popularity_score FROM content),
r AS (SELECT content_id, 'genres_' || unnest(genres) AS feature, 1.0::DOUBLE AS value FROM w UNION SELECT content_id, 'creator_' || creator, 1.0 FROM w WHERE length(creator) <= 20 UNION SELECT content_id, 'content_type_' || content_type, 1.0 FROM w WHERE length(content_type) <= 20
UNION SELECT content_id, 'content_type_word_' || unnest(x[1:10]), 1 / len(x) FROM w WHERE length(content_type) > 20 UNION SELECT content_id, 'popularity_score_numeric', popularity_score FROM w)
SELECT content_id, feature, round(value, 6) AS value FROM r WHERE feature IS NOT NULL""")
def content_feature_vector(spark, sf_dir):
    return rounded(P.content_vectors(content(spark, sf_dir), "content_id", ["genres"], ["content_type", "creator"], ["popularity_score"]))
