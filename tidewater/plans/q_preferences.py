"""Registered queries of preferences, evolution and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preferences as P
from ..sources.views import CONTENT, INTERACTIONS, PURCHASES, content, interactions, purchases, table
from .q_users import SESSIONS, rounded, sessions
from .registry import query

TYPE = "CASE interaction_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.6 WHEN 'view' THEN 0.4 WHEN 'signup' THEN 0.5 ELSE 0.3 END"


def decayed_sql(hours: float, rate: float) -> str:
    return f"""WITH {INTERACTIONS}, m AS (SELECT max(ts) AS t FROM interactions), a AS (SELECT user_id, item_id, interaction_type, rating, (epoch_us(t) - epoch_us(ts)) / 3.6e9 AS age FROM interactions, m),
w AS (SELECT user_id, item_id, sum(exp(-{rate} * age) * {TYPE} * rating / 5) AS w FROM a WHERE age <= {hours} GROUP BY 1, 2) SELECT user_id, item_id, round(w / max(w) OVER (PARTITION BY user_id), 6) AS weight FROM w"""


@query(decayed_sql(72, 0.1))
def short_term_vector(spark, sf_dir):
    return rounded(P.decayed_vector(interactions(spark, sf_dir), 72, 0.1))


@query(decayed_sql(24 * 365, 0.01 / 24))
def long_term_vector(spark, sf_dir):
    return rounded(P.decayed_vector(interactions(spark, sf_dir), 24 * 365, 0.01 / 24))


@query(f"""WITH {INTERACTIONS}, m AS (SELECT max(ts) AS t FROM interactions), n AS (SELECT user_id, interaction_type AS key, count(*) FILTER (ts >= t - INTERVAL 120 HOUR) AS a, count(*) FILTER (ts < t - INTERVAL 120 HOUR) AS b FROM interactions, m WHERE ts >= t - INTERVAL 240 HOUR GROUP BY 1, 2),
g AS (SELECT user_id, key, coalesce(a / nullif(sum(a) OVER w, 0), 0) - coalesce(b / nullif(sum(b) OVER w, 0), 0) AS gain FROM n WINDOW w AS (PARTITION BY user_id)) SELECT user_id, key, round(gain, 6) AS gain FROM g WHERE gain > 0""")
def trending_for_user(spark, sf_dir):
    return rounded(P.trending_for_user(interactions(spark, sf_dir), 240))


@query(f"""{SESSIONS}, n AS (SELECT user_id, session, interaction_type, count(*) AS n FROM s GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, session) AS p FROM n), h AS (SELECT user_id, session, -sum(p * ln(p)) AS h FROM p GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session DESC) AS r FROM h) SELECT user_id, round(stddev_pop(h), 6) AS volatility FROM l WHERE r <= 5 GROUP BY 1""")
def preference_volatility(spark, sf_dir):
    return rounded(P.volatility(sessions(spark, sf_dir), "interaction_type"))


HORIZONS = f"""WITH {PURCHASES}, {CONTENT}, m AS (SELECT max(ts) AS t FROM purchases), e AS (SELECT user_id, (rating - 2.5) / 2.5 AS x, date_diff('day', ts::DATE, t::DATE) AS age, unnest(genres) AS genre FROM purchases JOIN content ON item_id = content_id, m),
v AS (SELECT user_id, CAST(d AS INTEGER) AS horizon, genre, avg(x) AS value, count(*) AS n FROM e, (VALUES (30), (180), (365), (1000)) t(d) WHERE age < d GROUP BY 1, 2, 3 HAVING count(*) >= 2), c AS (SELECT *, 0.7 * least(1.0, n / 5) + 0.3 * least(1.0, abs(value)) AS confidence FROM v)"""


def wide(spark, sf_dir):
    return P.horizons(purchases(spark, sf_dir), content(spark, sf_dir), (30, 180, 365, 1000))


@query(f"{HORIZONS} SELECT user_id, horizon, genre, round(value, 6) AS value, n, round(confidence, 6) AS confidence FROM c")
def multi_timescale_vector(spark, sf_dir):
    return rounded(wide(spark, sf_dir))


@query(f"""{HORIZONS}, s AS (SELECT user_id, value - min(value) OVER (PARTITION BY user_id) + 0.01 AS s FROM c WHERE horizon = 1000), p AS (SELECT user_id, s / sum(s) OVER (PARTITION BY user_id) AS p FROM s)
SELECT user_id, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6)::DOUBLE AS entropy FROM p GROUP BY 1""")
def preference_entropy(spark, sf_dir):
    return rounded(P.normalised_entropy(wide(spark, sf_dir).filter("horizon = 1000"), "genre", "value"))


@query(f"""WITH {INTERACTIONS}, a AS (SELECT user_id, count(*) AS n, avg(CAST(hour(ts) BETWEEN 6 AND 11 AS DOUBLE)) AS morning, avg(CAST(hour(ts) BETWEEN 18 AND 22 AS DOUBLE)) AS evening, avg(CAST(hour(ts) >= 23 OR hour(ts) < 6 AS DOUBLE)) AS night, avg(CAST(isodow(ts) >= 6 AS DOUBLE)) AS weekend FROM interactions GROUP BY 1)
SELECT user_id, n, round(morning, 6) AS morning, round(evening, 6) AS evening, round(night, 6) AS night, round(weekend, 6) AS weekend FROM a WHERE n >= 10""")
def time_of_day_prefs(spark, sf_dir):
    return rounded(P.time_of_day(interactions(spark, sf_dir)))


SNAPS = f"""WITH {PURCHASES}, {CONTENT}, f AS (SELECT user_id, min(ts) AS first FROM purchases GROUP BY 1), e AS (SELECT user_id, CAST(floor(date_diff('day', first::DATE, ts::DATE) / 365) AS INTEGER) AS period, rating, unnest(genres) AS genre FROM purchases JOIN f USING (user_id) JOIN content ON item_id = content_id),
sn AS (SELECT user_id, period, genre, avg(rating) / 5 AS value FROM e GROUP BY 1, 2, 3), nu AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY period) AS n FROM sn)"""


def snaps(spark, sf_dir):
    return P.snapshots(purchases(spark, sf_dir), content(spark, sf_dir), 365)


@query(f"""{SNAPS}, me AS (SELECT *, round(avg(value) OVER g, 9) AS mean, CASE WHEN count(*) OVER g > 1 THEN round(round(max_by(value, period) OVER g, 9) - round(min_by(value, period) OVER g, 9), 9) END AS change FROM sn WINDOW g AS (PARTITION BY user_id, genre)),
pl AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY mean DESC, genre NULLS FIRST) AS INTEGER) AS place FROM me)
SELECT user_id, period, genre, round(value, 6) AS value, place, place <= 5 AS shown, round(change, 6) AS change, CASE WHEN change > 0.1 THEN 'increased' WHEN change < -0.1 THEN 'decreased' WHEN change IS NOT NULL THEN 'stable' END AS direction FROM pl""")
def preference_evolution_series(spark, sf_dir):
    return rounded(P.evolution_series(snaps(spark, sf_dir)))


@query(f"""{SNAPS}, no AS (SELECT user_id, n, sqrt(sum(value * value)) AS norm FROM nu GROUP BY 1, 2), d AS (SELECT a.user_id, a.n, sum(a.value * b.value) AS dot FROM nu a JOIN nu b ON a.user_id = b.user_id AND a.genre = b.genre AND b.n = a.n + 1 GROUP BY 1, 2)
SELECT a.user_id, round(avg(coalesce(dot, 0) / (a.norm * b.norm)), 6) AS stability FROM no a JOIN no b ON a.user_id = b.user_id AND b.n = a.n + 1 LEFT JOIN d ON d.user_id = a.user_id AND d.n = a.n GROUP BY 1""")
def preference_stability(spark, sf_dir):
    return rounded(P.stability(snaps(spark, sf_dir)))


@query(f"""{SNAPS}, l AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS last FROM nu), b AS (SELECT user_id, genre, max(value) FILTER (n = last) AS now, max(value) FILTER (n = last - 1) AS before FROM l WHERE n >= last - 1 AND last > 1 GROUP BY 1, 2)
SELECT user_id, genre, CASE WHEN before IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN now > before THEN 'increase' ELSE 'decrease' END AS change, round(coalesce(now, 0) - coalesce(before, 0), 6) AS difference FROM b WHERE abs(coalesce(now, 0) - coalesce(before, 0)) > 0.2""")
def preference_changes(spark, sf_dir):
    return rounded(P.changes(snaps(spark, sf_dir)))


#: Daily mean values of each user as series, t in days from the first event of all.
DAILY = "d AS (SELECT user_id, CAST(date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS DOUBLE) AS t, avg(value) / 100 AS value FROM events GROUP BY 1, 2)"


def daily(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.to_date(F.min("ts")).alias("first"))
    own = e.crossJoin(F.broadcast(first)).withColumn("t", F.datediff(F.to_date("ts"), "first").cast("double"))
    return own.groupBy("user_id", "t").agg((F.avg("value") / 100).alias("value"))


@query(f"""WITH {DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS r FROM d), a AS (SELECT user_id, regr_slope(value, t) AS s, regr_intercept(value, t) AS i, max(t) AS t, count(*) AS n FROM l WHERE r <= 3 GROUP BY 1)
SELECT user_id, round(s + 1e-9, 6) AS slope, round(greatest(-1.0, least(1.0, i + s * (t + 1))) + 1e-9, 6) AS forecast, n FROM a WHERE s IS NOT NULL""")
def preference_trends_forecast(spark, sf_dir):
    return rounded(P.trend(daily(spark, sf_dir), ["user_id"]), 1e-9)


@query(f"""WITH {DAILY}, a AS (SELECT user_id, regr_slope(value, t) AS s, coalesce(regr_r2(value, t), 0) AS r2, count(*) AS n FROM d GROUP BY 1)
SELECT user_id, round(s, 6) AS slope, round(r2, 6) AS r2, n, CASE WHEN abs(s) < 0.001 THEN 'stable' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, CASE WHEN r2 >= 0.7 THEN 'strong' WHEN r2 >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM a WHERE n >= 3 AND s IS NOT NULL""")
def evolution_trends(spark, sf_dir):
    return rounded(P.evolution_trends(daily(spark, sf_dir), ["user_id"]))


#: Hourly means of each event type, t in hours.
HOURLY = "h AS (SELECT event_type, CAST(date_diff('hour', (SELECT date_trunc('hour', min(ts)) FROM events), date_trunc('hour', ts)) AS DOUBLE) AS t, avg(value) AS value FROM events GROUP BY 1, 2)"


def hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    first = e.agg(F.min("ts").alias("first"))
    own = e.crossJoin(F.broadcast(first)).withColumn("t", ((F.unix_timestamp("ts") - F.unix_timestamp("first")) / 3600).cast("double"))
    return own.groupBy("event_type", "t").agg(F.avg("value").alias("value"))


@query(f"""WITH {HOURLY}, w AS (SELECT event_type, t, count(*) OVER a AS na, avg(value) OVER a AS ma, var_samp(value) OVER a AS va, count(*) OVER b AS nb, avg(value) OVER b AS mb, var_samp(value) OVER b AS vb FROM h
WINDOW a AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), v AS (SELECT *, (mb - ma) / sqrt(va / na + vb / nb) AS tv FROM w WHERE na = 20 AND nb = 20)
SELECT event_type, t, round(mb - ma, 6) AS magnitude, round(tv, 6) AS t_value FROM v WHERE abs(tv) > 2""")
def change_points(spark, sf_dir):
    return rounded(P.change_points(hourly(spark, sf_dir), ["event_type"], limit=2.0))


@query(f"""WITH {HOURLY}, s AS (SELECT event_type, CAST(p AS INTEGER) AS period, sin(2 * pi() * t / p) AS s, cos(2 * pi() * t / p) AS c, value AS y FROM h, (VALUES (24), (168)) q(p)),
a AS (SELECT event_type, period, covar_pop(s, y) AS sy, covar_pop(c, y) AS cy, covar_pop(s, c) AS sc, var_pop(s) AS ss, var_pop(c) AS cc, var_pop(y) AS yy FROM s GROUP BY 1, 2), b AS (SELECT *, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS b1, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS b2 FROM a)
SELECT event_type, period, round(sqrt(b1 * b1 + b2 * b2), 6) AS amplitude, round((b1 * sy + b2 * cy) / yy, 6) AS r2 FROM b""")
def seasonality(spark, sf_dir):
    return rounded(P.seasonality(hourly(spark, sf_dir), ["event_type"]))


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
j AS (SELECT event_id, r.value, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.value) AS k FROM l JOIN r ON l.user_id = r.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 3600000000)
SELECT event_id, round(value, 6) AS value, round(gap / 1e6, 6)::DOUBLE AS gap_seconds FROM j WHERE k = 1""")
def asof_value(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    left, right = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", "value")
    return rounded(P.asof_join(left, right, ["user_id"], 3600).select("event_id", "value", "gap_seconds"))


@query("""WITH cur AS (SELECT c_custkey AS user_id, 'f' || (c_custkey % 3) AS feature, CAST((c_custkey % 21 - 10) / 10 AS DOUBLE) AS value, 'implicit' AS source, c_custkey % 4 = 0 AS locked FROM customer WHERE c_acctbal >= 0),
up AS (SELECT c_custkey AS user_id, 'f' || (c_custkey % 3) AS feature, CAST((c_custkey % 31 - 15) / 10 AS DOUBLE) AS value, CASE WHEN c_custkey % 2 = 0 THEN 'explicit' ELSE 'implicit' END AS source, CASE WHEN c_custkey % 3 = 0 THEN 'merge' ELSE 'replace' END AS action FROM customer WHERE c_mktsegment <> 'BUILDING'),
b AS (SELECT user_id, feature, c.value AS v, c.source AS s, c.locked, CASE WHEN u.value IS NOT NULL THEN greatest(-1.0, least(1.0, u.value)) END AS n, u.source AS ns, u.action FROM cur c FULL JOIN up u USING (user_id, feature)), k AS (SELECT *, n IS NULL OR (coalesce(locked, false) AND ns <> 'explicit') AS keep FROM b)
SELECT user_id, feature, round(CASE WHEN keep THEN v WHEN action = 'merge' AND v IS NOT NULL THEN (v + n) / 2 ELSE n END, 6)::DOUBLE AS value, CASE WHEN keep THEN s ELSE ns END AS source FROM k""")
def explicit_preference_merge(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    feature = F.concat(F.lit("f"), (k % 3).cast("string"))
    current = c.filter("c_acctbal >= 0").select(k.alias("user_id"), feature.alias("feature"), ((k % 21 - 10) / 10).alias("value"), F.lit("implicit").alias("source"), (k % 4 == 0).alias("locked"))
    updates = c.filter("c_mktsegment <> 'BUILDING'").select(k.alias("user_id"), feature.alias("feature"), ((k % 31 - 15) / 10).alias("value"), F.when(k % 2 == 0, "explicit").otherwise("implicit").alias("source"), F.when(k % 3 == 0, "merge").otherwise("replace").alias("action"))
    return rounded(P.merged_preferences(current, updates))


@query(f"""WITH {INTERACTIONS}, m AS (SELECT max(ts) AS t FROM interactions), n AS (SELECT user_id, hour(ts) AS h, count(*) FILTER (ts >= t - INTERVAL 15 DAY) AS a, count(*) FILTER (ts < t - INTERVAL 15 DAY) AS b FROM interactions, m WHERE ts >= t - INTERVAL 30 DAY GROUP BY 1, 2),
u AS (SELECT user_id, sum(a) AS ta, sum(b) AS tb FROM n GROUP BY 1 HAVING sum(a) > 0 AND sum(b) > 0), g AS (SELECT user_id, (coalesce(a, 0) + 1) / (ta + 24) AS p, (coalesce(b, 0) + 1) / (tb + 24) AS q FROM u CROSS JOIN range(0, 24) r(h) LEFT JOIN n USING (user_id, h))
SELECT user_id, round(sum(p * ln(p / q)), 6) AS kl FROM g GROUP BY 1""")
def drift_hour_kl(spark, sf_dir):
    return rounded(P.hour_drift(interactions(spark, sf_dir)))


@query(f"""WITH {PURCHASES}, {CONTENT}, o AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, item_id, rating) > floor(count(*) OVER (PARTITION BY user_id) / 2) AS second FROM purchases), e AS (SELECT user_id, second, unnest(genres) AS genre FROM o JOIN content ON item_id = content_id),
n AS (SELECT user_id, genre, count(*) FILTER (NOT second) AS a, count(*) FILTER (second) AS b FROM e GROUP BY 1, 2), s AS (SELECT user_id, coalesce(a / nullif(sum(a) OVER w, 0), 0) AS p, coalesce(b / nullif(sum(b) OVER w, 0), 0) AS q FROM n WINDOW w AS (PARTITION BY user_id))
SELECT user_id, round(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 6) AS js FROM s GROUP BY 1""")
def drift_genre_js(spark, sf_dir):
    return rounded(P.genre_drift(purchases(spark, sf_dir), content(spark, sf_dir)))


@query(f"""WITH {PURCHASES}, o AS (SELECT user_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, item_id, rating) > floor(count(*) OVER (PARTITION BY user_id) / 2) AS second FROM purchases), n AS (SELECT user_id, rating, count(*) FILTER (NOT second) AS a, count(*) FILTER (second) AS b FROM o GROUP BY 1, 2),
g AS (SELECT user_id, abs(sum(a) OVER u / nullif(sum(a) OVER w, 0) - sum(b) OVER u / nullif(sum(b) OVER w, 0)) AS gap FROM n WINDOW w AS (PARTITION BY user_id), u AS (PARTITION BY user_id ORDER BY rating ROWS UNBOUNDED PRECEDING)), k AS (SELECT user_id, max(gap) AS ks FROM g GROUP BY 1 HAVING max(gap) IS NOT NULL),
a AS (SELECT user_id, avg(rating) FILTER (NOT second) AS ma, avg(rating) FILTER (second) AS mb, var_pop(rating) FILTER (NOT second) AS va, var_pop(rating) FILTER (second) AS vb FROM o GROUP BY 1), c AS (SELECT user_id, ks, abs(mb - ma) / ma AS mc, coalesce(abs(vb - va) / nullif(va, 0), 0) AS vc FROM k JOIN a USING (user_id))
SELECT user_id, round(ks + 1e-9, 6) AS ks, round(mc + 1e-9, 6) AS mean_change, round(vc + 1e-9, 6) AS variance_change, round(greatest(ks, mc, vc) + 1e-9, 6) AS score FROM c""")
def drift_rating(spark, sf_dir):
    return rounded(P.rating_drift(purchases(spark, sf_dir), ["ts", "l_orderkey", "l_linenumber", "item_id", "rating"]), 1e-9)


@query(f"""WITH {DAILY}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) > floor(count(*) OVER (PARTITION BY user_id) / 2) AS second FROM d), a AS (SELECT user_id, count(*) AS n, avg(value) FILTER (NOT second) AS ma, avg(value) FILTER (second) AS mb, var_pop(value) AS v FROM o GROUP BY 1 HAVING count(*) >= 4)
SELECT user_id, n, round(abs(mb - ma), 6) AS gap, round(sqrt(2 * v * ln(2 / 0.05) / floor(n / 2)), 6) AS bound, abs(mb - ma) > sqrt(2 * v * ln(2 / 0.05) / floor(n / 2)) AS drift FROM a""")
def adwin_split(spark, sf_dir):
    return rounded(P.adwin(daily(spark, sf_dir), ["user_id"]))


@query()
def page_hinkley(spark, sf_dir):
    return rounded(P.page_hinkley(daily(spark, sf_dir), ["user_id"]))


@query(f"""WITH {PURCHASES}, a AS (SELECT user_id, count(*) AS n, date_diff('day', max(ts)::DATE, (SELECT max(ts)::DATE FROM purchases)) AS quiet, date_diff('day', min(ts)::DATE, (SELECT max(ts)::DATE FROM purchases)) AS age FROM purchases GROUP BY 1)
SELECT user_id, n, CAST(quiet AS INTEGER) AS quiet, CAST(age AS INTEGER) AS age, CASE WHEN quiet > 90 THEN 'inactive' WHEN age < 30 THEN 'new' WHEN n < 20 THEN 'developing' WHEN quiet <= 7 THEN 'active' ELSE 'regular' END AS stage FROM a""")
def lifecycle_stage(spark, sf_dir):
    return P.lifecycle(purchases(spark, sf_dir))
