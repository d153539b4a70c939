"""Registered queries of user, session and preference features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import strips as S
from ..operators import users as U
from ..sources.views import CONTENT, INTERACTIONS, PURCHASES, content, interactions, purchases
from .registry import query


def rounded(df, nudge: float = 0.0):
    """df with its doubles rounded; a nudge takes results that lie on half a digit off it, where two engines round apart."""
    return df.select(*[r6(F.col(f.name) + nudge if nudge else f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


@query(f"""WITH {INTERACTIONS}, a AS (SELECT user_id, count(*) AS n, avg(rating) AS mean, coalesce(stddev_samp(rating), 0) AS deviation, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS days FROM interactions GROUP BY 1)
SELECT user_id, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, CAST(days AS INTEGER) AS days, round(n / days, 6) AS per_day, CASE WHEN n <= 10 THEN 'low' WHEN n <= 50 THEN 'medium' WHEN n <= 200 THEN 'high' ELSE 'very_high' END AS level, mean >= 4 AS generous, mean <= 2 AS harsh, round(1 / (1 + deviation), 6) AS consistency FROM a""")
def user_activity(spark, sf_dir):
    return rounded(U.user_activity(interactions(spark, sf_dir)))


@query(f"""WITH {INTERACTIONS}, {CONTENT}, b AS (SELECT user_id, rating, genres, duration FROM interactions JOIN content ON item_id = content_id), e AS (SELECT user_id, unnest(genres) AS genre FROM b), c AS (SELECT user_id, genre, count(*) AS c FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, genre) AS rank FROM c), t AS (SELECT user_id, string_agg(genre, ',' ORDER BY rank) FILTER (rank <= 3) AS genres, count(*) AS genre_count FROM r GROUP BY 1)
SELECT user_id, t.genres, genre_count, round(avg(duration), 6) AS mean_duration, round(avg(CAST(rating >= 4 AS DOUBLE)), 6) AS high_share FROM t JOIN b USING (user_id) GROUP BY ALL""")
def user_content_preferences(spark, sf_dir):
    return rounded(U.user_content_preferences(interactions(spark, sf_dir), content(spark, sf_dir)))


@query(f"""WITH {INTERACTIONS}, o AS (SELECT user_id, hour(ts) AS hour, isodow(ts) - 1 AS day, ts::DATE AS date FROM interactions),
h AS (SELECT user_id, hour, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, hour) AS r FROM o GROUP BY 1, 2), d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, day) AS r FROM o GROUP BY 1, 2),
s AS (SELECT user_id, avg(CAST(hour >= 6 AND hour < 12 AS DOUBLE)) AS morning, avg(CAST(hour >= 18 AND hour < 23 AS DOUBLE)) AS evening, avg(CAST(hour >= 23 OR hour < 6 AS DOUBLE)) AS night, avg(CAST(day >= 5 AS DOUBLE)) AS weekend FROM o GROUP BY 1),
c AS (SELECT user_id, 1 / (1 + coalesce(stddev_samp(n), 0)) AS regularity FROM (SELECT user_id, date, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1)
SELECT user_id, CAST(hour AS INTEGER) AS modal_hour, CAST(day AS INTEGER) AS modal_day, round(morning, 6) AS morning, round(evening, 6) AS evening, round(night, 6) AS night, round(weekend, 6) AS weekend, round(regularity, 6) AS regularity
FROM s JOIN c USING (user_id) JOIN h USING (user_id) JOIN d USING (user_id) WHERE h.r = 1 AND d.r = 1""")
def user_temporal_behavior(spark, sf_dir):
    return rounded(U.user_temporal_behavior(interactions(spark, sf_dir)))


@query(f"""WITH {INTERACTIONS} SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS number, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9, 6)::DOUBLE AS hours_since, lag(rating) OVER w AS previous_rating, rating - lag(rating) OVER w AS rating_change FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def interaction_sequence(spark, sf_dir):
    return rounded(U.interaction_sequence(interactions(spark, sf_dir)))


@query(f"""WITH {INTERACTIONS}, u AS (SELECT user_id, count(*) AS user_n, avg(rating) AS um, count(DISTINCT item_id) AS user_items FROM interactions GROUP BY 1), u2 AS (SELECT *, (rank() OVER (ORDER BY user_n) + (count(*) OVER (PARTITION BY user_n) - 1) / 2) / count(*) OVER () AS activity FROM u),
i AS (SELECT item_id, count(*) AS item_n, avg(rating) AS im, count(DISTINCT user_id) AS item_users FROM interactions GROUP BY 1), i2 AS (SELECT *, (rank() OVER (ORDER BY item_n) + (count(*) OVER (PARTITION BY item_n) - 1) / 2) / count(*) OVER () AS popularity FROM i)
SELECT event_id, user_n, user_items, item_n, item_users, round(rating - um, 6) AS user_bias, round(rating - im, 6) AS item_bias, round(activity, 6) AS activity, round(popularity, 6) AS popularity, user_n <= 5 AS new_user, item_n <= 5 AS new_item FROM interactions JOIN u2 USING (user_id) JOIN i2 USING (item_id)""")
def user_item_history(spark, sf_dir):
    return rounded(U.user_item_history(interactions(spark, sf_dir)))


@query(f"WITH {INTERACTIONS} SELECT user_id, item_id, sum(rating) AS rating FROM interactions GROUP BY ALL")
def user_item_matrix(spark, sf_dir):
    return U.user_item_matrix(interactions(spark, sf_dir))


PAIRS = f"""WITH {INTERACTIONS}, m AS (SELECT user_id, item_id, sum(rating) AS r FROM interactions GROUP BY ALL),
p AS (SELECT x.user_id AS a, y.user_id AS b, sum(x.r * y.r) AS dot, sum(x.r * x.r) AS xx, sum(y.r * y.r) AS yy, count(*) AS shared FROM m x JOIN m y ON x.item_id = y.item_id AND x.user_id < y.user_id GROUP BY ALL)"""


#: Ratings of users over items and of items over users, and pairs that share a key.
BOTH = f"""WITH {INTERACTIONS}, m AS (SELECT user_id, item_id, sum(rating) AS r FROM interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY ALL HAVING sum(rating) IS NOT NULL),
v AS (SELECT 'user' AS side, user_id AS id, item_id AS k, r FROM m UNION ALL SELECT 'item', item_id, user_id, r FROM m),
p AS (SELECT x.side, x.id AS a, y.id AS b, sum(x.r * y.r) AS dot, sum(x.r * x.r) AS xx, sum(y.r * y.r) AS yy, count(*) AS shared FROM v x JOIN v y ON x.side = y.side AND x.k = y.k AND x.id < y.id GROUP BY ALL)"""


def both_sides(matrix, of):
    """What `of` gives for users over items and for items over users, with the side."""
    users, items = (of(matrix, a, b).select(F.lit(side).alias("side"), "*") for side, a, b in (("user", "user_id", "item_id"), ("item", "item_id", "user_id")))
    return users.unionByName(items)


@query(f"""{BOTH}, s AS (SELECT side, a, b, coalesce(dot / nullif(sqrt(xx * yy), 0), 0) AS similarity FROM p), e AS (SELECT side, a AS id, b AS other, similarity FROM s UNION ALL SELECT side, b, a, similarity FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY side, id ORDER BY similarity DESC, other) AS i FROM e) SELECT side, id, round(max(similarity), 6) AS highest, round(avg(similarity), 4) AS mean, count(*) AS n FROM r WHERE i <= 50 GROUP BY 1, 2""")
def pairwise_similarity_features(spark, sf_dir):
    near = both_sides(U.user_item_matrix(interactions(spark, sf_dir)), lambda m, a, b: S.nearest(m, 50, a, b, common=True))
    # ties of the fiftieth place are broken by the last bits of sums, which the mean's fourth digit does not show
    return near.groupBy("side", "id").agg(F.max("similarity").alias("highest"), F.avg("similarity").alias("mean"), F.count(F.lit(1)).alias("n")).select("side", "id", r6("highest").alias("highest"), F.round("mean", 4).alias("mean"), "n")


@query(f"""{BOTH}, q AS (SELECT side, id, sum(r * r) AS q FROM v GROUP BY 1, 2)
SELECT x.side, x.id AS a, y.id AS b, coalesce(shared, 0) AS shared, round(coalesce(dot / nullif(sqrt(x.q * y.q), 0), 0), 6) AS similarity FROM q x JOIN q y ON x.side = y.side AND x.id < y.id LEFT JOIN p ON p.side = x.side AND a = x.id AND b = y.id""")
def cosine_similarity_matrix(spark, sf_dir):
    return rounded(both_sides(U.user_item_matrix(interactions(spark, sf_dir)), lambda m, a, b: S.pairs(m, a, b, every=True)))


@query(f"""WITH {INTERACTIONS}, {CONTENT}, a AS (SELECT user_id, count(*) AS n, avg(rating) AS mean FROM interactions GROUP BY 1), c AS (SELECT content_id, content_type FROM content)
SELECT event_id, n, round(mean, 6) AS mean, coalesce(content_type, 'unknown') AS content_type FROM interactions JOIN a USING (user_id) LEFT JOIN c ON item_id = content_id""")
def feature_sets_union(spark, sf_dir):
    own = interactions(spark, sf_dir)
    users = U.user_activity(own).select("user_id", "n", "mean")
    items = content(spark, sf_dir).select(F.col("content_id").alias("item_id"), "content_type")
    return rounded(U.feature_sets_union(own.select("event_id", "user_id", "item_id"), [("user_id", users), ("item_id", items)]).select("event_id", "n", "mean", "content_type"))


@query(f"""WITH {INTERACTIONS}, c AS (SELECT corr(value, rating) AS v, corr(item_id, rating) AS i, corr(hour(ts), rating) AS h FROM interactions)
SELECT * FROM (SELECT 'value' AS feature, round(v, 6) AS correlation FROM c UNION ALL SELECT 'item_id', round(i, 6) FROM c UNION ALL SELECT 'hour', round(h, 6) FROM c)""")
def feature_correlation(spark, sf_dir):
    own = interactions(spark, sf_dir).withColumn("hour", F.hour("ts")).withColumn("item_id", F.col("item_id").cast("double"))
    return rounded(U.feature_correlation(own, "rating", ["value", "item_id", "hour"]))


@query(f"""WITH {INTERACTIONS}, a AS (SELECT user_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY 1)
SELECT CASE WHEN n >= 50 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS activity, CASE WHEN m >= 4 THEN 'positive' WHEN m >= 3 THEN 'neutral' ELSE 'critical' END AS taste, count(*) AS users FROM a GROUP BY ALL""")
def user_distribution(spark, sf_dir):
    return U.user_distribution(interactions(spark, sf_dir))


@query(f"""WITH {INTERACTIONS}, a AS (SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS items, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(rating), 6) AS mean FROM interactions GROUP BY 1),
k AS (SELECT user_id, interaction_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, interaction_type) AS r FROM interactions GROUP BY 1, 2), t AS (SELECT user_id, string_agg(interaction_type, ',' ORDER BY r) AS types FROM k WHERE r <= 3 GROUP BY 1)
SELECT user_id, n, items, first_ts, last_ts, mean, types, round(items / n, 6) AS diversity FROM a JOIN t USING (user_id)""")
def user_profile_summary(spark, sf_dir):
    return rounded(U.user_profile_summary(interactions(spark, sf_dir)))


#: Sessions with a gap of six hours, and their metrics, as SQL.
SESSIONS = f"""WITH {INTERACTIONS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS f FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)"""
METRICS = SESSIONS + """, q AS (SELECT user_id, session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, count(DISTINCT item_id) AS items, count(DISTINCT interaction_type) AS types, avg(rating) AS mean, count(rating) AS rated FROM s GROUP BY 1, 2 HAVING count(*) >= 2),
z AS (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 6e7 AS minutes FROM q)"""


def sessions(spark, sf_dir):
    return U.sessionize(interactions(spark, sf_dir), 360)


@query(f"{SESSIONS} SELECT event_id, session FROM s")
def sessionize(spark, sf_dir):
    return sessions(spark, sf_dir).select("event_id", "session")


@query(f"""{METRICS} SELECT user_id, session, start_ts, end_ts, round(minutes + 1e-9, 6)::DOUBLE AS minutes, n, items, types, round(mean + 1e-9, 6) AS mean,
round((least(1.0, CASE WHEN minutes > 0 THEN n / minutes / 2 ELSE 1.0 END) + items / n + rated / n + CASE WHEN minutes < 20 THEN minutes / 20 WHEN minutes <= 60 THEN 1.0 ELSE 60 / minutes END) / 4 + 1e-9, 6)::DOUBLE AS quality FROM z""")
def session_metrics(spark, sf_dir):
    return rounded(U.session_metrics(sessions(spark, sf_dir)), 1e-9)


@query(f"""{METRICS}, a AS (SELECT user_id, count(*) AS sessions, date_diff('day', min(start_ts)::DATE, max(end_ts)::DATE) + 1 AS days, avg(minutes) AS mm FROM z GROUP BY 1)
SELECT user_id, sessions, round(sessions / days, 6) AS per_day, round(mm, 6) AS mean_minutes, CASE WHEN sessions / days >= 1 AND sessions >= 10 THEN 'very_high' WHEN sessions / days >= 0.5 THEN 'high' WHEN sessions / days >= 0.2 THEN 'medium' ELSE 'low' END AS level FROM a""")
def session_frequency(spark, sf_dir):
    return rounded(U.session_frequency(U.session_metrics(sessions(spark, sf_dir))))


@query(f"""{METRICS}, a AS (SELECT user_id, count(*) AS s, avg(minutes) AS mm, stddev_pop(minutes) AS sm, avg(n) AS mn, stddev_pop(n) AS sn, stddev_pop(hour(start_ts)) AS sh FROM z GROUP BY 1)
SELECT user_id, round(CASE WHEN s < 3 THEN 0.5 ELSE (greatest(0, 1 - coalesce(sm / nullif(mm, 0), 0)) + greatest(0, 1 - coalesce(sn / nullif(mn, 0), 0)) + greatest(0, 1 - sh / 12)) / 3 END, 6)::DOUBLE AS consistency FROM a""")
def consistency_score(spark, sf_dir):
    return rounded(U.consistency(U.session_metrics(sessions(spark, sf_dir))))


@query(f"""{SESSIONS}, m AS (SELECT user_id, session, count(*) AS n, count(DISTINCT item_id) AS items, min(ts) AS st FROM s GROUP BY 1, 2),
a AS (SELECT user_id, count(*) AS total, count(*) FILTER (n >= 5) AS binge, count(*) FILTER (n <= 2) AS quick, count(*) FILTER (isodow(st) >= 6) AS weekend, count(*) FILTER (hour(st) >= 18) AS evening, count(*) FILTER (items = n AND n >= 2) AS explorer FROM m GROUP BY 1),
u AS (UNPIVOT a ON binge, quick, weekend, evening, explorer INTO NAME pattern VALUE frequency) SELECT user_id, pattern, frequency, round(frequency / total, 6) AS confidence FROM u WHERE frequency >= greatest(2.0, 0.2 * total)""")
def behavior_patterns(spark, sf_dir):
    return rounded(U.behavior_patterns(sessions(spark, sf_dir)))


@query(f"""WITH {INTERACTIONS}, h AS (SELECT user_id, hour(ts) AS hour, count(*) AS n FROM interactions GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM h)
SELECT user_id, CAST(hour AS INTEGER) AS hour, n FROM t WHERE total >= 10 AND n <= 0.1 * total""")
def behavior_anomalies(spark, sf_dir):
    return U.unusual_hours(interactions(spark, sf_dir))


@query(f"""WITH {PURCHASES}, {CONTENT}, m AS (SELECT max(ts) AS t FROM purchases), e AS (SELECT user_id, rating, exp(-0.1 * date_diff('day', ts::DATE, t::DATE) / 365) AS w, unnest(list_distinct(genres)) AS genre FROM purchases JOIN content ON item_id = content_id, m)
SELECT user_id, genre, round(sum(w * (rating - 1) / 4) / sum(w), 6) AS score, round(count(*) / (count(*) + 5), 6) AS confidence, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 2""")
def genre_preference_profile(spark, sf_dir):
    return rounded(U.genre_preference_profile(purchases(spark, sf_dir), content(spark, sf_dir)))


@query(f"""WITH {PURCHASES}, m AS (SELECT max(ts) AS t FROM purchases), a AS (SELECT user_id, avg(rating) FILTER (ts >= t - INTERVAL 365 DAY) AS recent, avg(rating) FILTER (ts < t - INTERVAL 365 DAY) AS older FROM purchases, m GROUP BY 1)
SELECT user_id, round(recent, 6) AS recent, round(older, 6) AS older, CASE WHEN recent - older IS NULL THEN 'unknown' WHEN recent - older > 0.5 THEN 'increasing' WHEN recent - older < -0.5 THEN 'decreasing' ELSE 'stable' END AS trend FROM a""")
def preference_trend(spark, sf_dir):
    return rounded(U.preference_trend(purchases(spark, sf_dir), 365))


@query(f"""WITH {PURCHASES}, a AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS deviation, max(rating) - min(rating) AS range, avg(CAST(rating >= 4 AS DOUBLE)) AS high, avg(CAST(rating <= 2 AS DOUBLE)) AS low FROM purchases GROUP BY 1)
SELECT user_id, round(mean, 6) AS mean, round(deviation, 6) AS deviation, range, round(high, 6) AS high, round(low, 6) AS low, round((5 - mean) / 4, 6) AS harshness, round(1 / (1 + deviation), 6) AS consistency FROM a""")
def rating_tendencies(spark, sf_dir):
    return rounded(U.rating_tendencies(purchases(spark, sf_dir)))


@query(f"""WITH {PURCHASES}, {CONTENT}, a AS (SELECT user_id, content_type, avg(rating) AS m, count(*) AS n FROM purchases JOIN content ON item_id = content_id GROUP BY 1, 2 HAVING count(*) >= 2) SELECT user_id, content_type, n, round((m - 1) / 4 * least(1.0, n / 10), 6) AS score FROM a""")
def content_type_preferences(spark, sf_dir):
    return rounded(U.type_preferences(purchases(spark, sf_dir), content(spark, sf_dir)))


@query(f"""WITH {INTERACTIONS}, h AS (SELECT user_id, hour(ts) AS hour, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, hour(ts)) AS r FROM interactions GROUP BY 1, 2), b AS (SELECT user_id, string_agg(CAST(hour AS VARCHAR), ',' ORDER BY r) AS hours FROM h WHERE r <= 3 GROUP BY 1),
d AS (SELECT user_id, ts::DATE AS d, count(*) AS c FROM interactions GROUP BY 1, 2) SELECT user_id, hours, round(avg(c), 6) AS daily_mean, max(c) AS daily_max, count(*) AS active_days FROM d JOIN b USING (user_id) GROUP BY 1, 2""")
def activity_calendar(spark, sf_dir):
    return rounded(U.activity_calendar(interactions(spark, sf_dir)))


@query(f"""WITH {INTERACTIONS}, {CONTENT}, e AS (SELECT user_id, event_id, ts, unnest(genres) AS genre FROM interactions JOIN content ON item_id = content_id), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, genre ORDER BY ts, event_id) AS r FROM e),
a AS (SELECT user_id, count(DISTINCT genre) AS g, count(DISTINCT event_id) AS n, count(DISTINCT event_id) FILTER (r = 1) AS new FROM f GROUP BY 1) SELECT user_id, round(least(1.0, g / n), 6) AS diversity, round(least(1.0, 2 * new / n), 6) AS exploration FROM a""")
def diversity_exploration(spark, sf_dir):
    return rounded(U.diversity_exploration(interactions(spark, sf_dir), content(spark, sf_dir)))
