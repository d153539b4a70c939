"""Registered queries of re-ranking, control, explanations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import serving as S
from ..operators import strips
from ..operators import users as U
from ..sources.views import CONTENT, INTERACTIONS, content, interactions, table
from .q_recommend import GENRE_TOP, GROUPS, STATS, genre_lists, members
from .q_users import PAIRS, rounded
from .registry import query

JACCARD = "len(list_distinct(list_intersect({a}, {b}))) / len(list_distinct(list_concat({a}, {b})))"


@query(f"""WITH {CONTENT}, s AS (SELECT content_id AS item_id, round(((CASE WHEN regexp_matches(lower(array_to_string(genres, ' ')), 'green|red') THEN 0.7 ELSE 0.5 END) + (CASE WHEN lower(content_type) IN ('promo', 'standard') THEN 0.8 ELSE 0.5 END)) / 2, 9)::DOUBLE AS score FROM content)
SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def contextual_items(spark, sf_dir):
    rules = [("season", "summer", "genre", ["green", "red"], 0.7, 0.5), ("device", "tv", "type", ["promo", "standard"], 0.8, 0.5), ("device", "mobile", "type", ["economy"], 0.8, 0.5)]
    return S.contextual_items(content(spark, sf_dir), {"season": "summer", "device": "tv", "mood": "calm"}, rules)


@query(f"""{GENRE_TOP}, n2 AS (SELECT item_id, 1 - count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM interactions) AS novelty FROM interactions GROUP BY 1),
l AS (SELECT user_id, g.item_id, score, content_type AS category, round(novelty, 9) AS novelty FROM g JOIN content ON g.item_id = content_id JOIN n2 ON g.item_id = n2.item_id),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, item_id) AS p FROM l WHERE NOT (user_id % 3 = 1 AND category = 'PROMO') AND NOT (user_id % 2 = 0 AND novelty < 0.3))
SELECT user_id, item_id, round(score, 6) AS score, category, round(novelty, 6) AS novelty FROM f WHERE user_id % 5 <> 0 OR p <= 2""")
def recommendation_control_filter(spark, sf_dir):
    own = interactions(spark, sf_dir)
    total = own.select("user_id").distinct().count()
    novelty = own.groupBy("item_id").agg(F.round(1 - F.countDistinct("user_id") / total, 9).alias("novelty"))
    lists = genre_lists(spark, sf_dir).join(content(spark, sf_dir).select(F.col("content_id").alias("item_id"), F.col("content_type").alias("category")), "item_id").join(novelty, "item_id").select("user_id", "item_id", "score", "category", "novelty")
    u = F.col("user_id")
    settings = own.select("user_id").distinct().select("user_id", F.when(u % 3 == 1, F.array(F.lit("PROMO"))).alias("blocked"), F.when(u % 2 == 0, 0.3).alias("novelty_preference"), (u % 5 == 0).alias("enforce_diversity"), F.lit(2).alias("most"))
    return rounded(S.controlled(lists, settings))


@query(f"""WITH {INTERACTIONS}, a AS (SELECT user_id, interaction_type AS arm, avg(rating) AS reward FROM interactions GROUP BY 1, 2), o AS (SELECT user_id, list(arm ORDER BY arm) AS arms FROM a GROUP BY 1), b AS (SELECT user_id, arm AS best FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(reward, 9) DESC, arm) = 1),
r AS (SELECT user_id, ts::DATE AS round FROM interactions GROUP BY 1, 2), d AS (SELECT r.*, CAST('0x' || substr(md5(user_id || ':' || round || ':explore'), 1, 8) AS BIGINT) AS x, CAST('0x' || substr(md5(user_id || ':' || round || ':arm'), 1, 8) AS BIGINT) AS y FROM r)
SELECT user_id, CAST(round AS VARCHAR) AS round, CASE WHEN x % 10000 < 1000 THEN arms[y % len(arms) + 1] ELSE best END AS arm, x % 10000 < 1000 AS explored FROM d JOIN o USING (user_id) JOIN b USING (user_id)""")
def bandit_select(spark, sf_dir):
    own = interactions(spark, sf_dir)
    arms = own.groupBy("user_id", F.col("interaction_type").alias("arm")).agg(F.round(F.avg("rating"), 9).alias("reward"))
    return S.bandit_select(arms, own.select("user_id", F.to_date("ts").cast("string").alias("round")).distinct())


@query(f"""WITH {INTERACTIONS}, p AS (SELECT DISTINCT user_id, item_id FROM interactions), u AS (SELECT user_id, avg(rating) AS a FROM interactions GROUP BY 1), i AS (SELECT item_id, avg(rating) AS b FROM interactions GROUP BY 1), t AS (SELECT item_id, 2.5 + least(2.5, ln(1 + count(*))) AS c FROM interactions WHERE interaction_type = 'purchase' GROUP BY 1)
SELECT user_id, item_id, round(least(5.0, greatest(0.0, (0.4 * a + 0.4 * b + coalesce(0.2 * c, 0)) / CASE WHEN c IS NULL THEN 0.8 ELSE 1.0 END)) + 1e-9, 6)::DOUBLE AS prediction FROM p JOIN u USING (user_id) JOIN i USING (item_id) LEFT JOIN t USING (item_id)""")
def ensemble_predict(spark, sf_dir):
    own = interactions(spark, sf_dir)
    popular = own.filter("interaction_type = 'purchase'").groupBy("item_id").agg((2.5 + F.least(F.lit(2.5), F.ln(1 + F.count(F.lit(1))))).alias("prediction"))
    mean = lambda k: own.groupBy(k).agg(F.avg("rating").alias("prediction"))
    return rounded(S.ensemble_predict(own.select("user_id", "item_id").distinct(), {"user": (mean("user_id"), ["user_id"], 0.4), "item": (mean("item_id"), ["item_id"], 0.4), "popular": (popular, ["item_id"], 0.2)}), 1e-9)


@query(f"""{GROUPS}{STATS}, sc AS (SELECT group_id, item_id, round(mean, 9) AS score FROM st), b AS (SELECT group_id, item_id FROM sc QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, item_id) <= 20),
gt2 AS (SELECT group_id, user_id, sum(score) AS got FROM own JOIN b USING (group_id, item_id) GROUP BY 1, 2), al AS (SELECT group_id, user_id, coalesce(got, 0) AS got, avg(coalesce(got, 0)) OVER (PARTITION BY group_id) AS m FROM mem LEFT JOIN gt2 USING (group_id, user_id)), un AS (SELECT group_id, user_id FROM al WHERE round(got, 9) < round(0.8 * m, 9)),
li AS (SELECT group_id, item_id, 1 + 0.3 * sum(score) AS lift FROM own JOIN un USING (group_id, user_id) GROUP BY 1, 2) SELECT group_id, item_id, round(sc.score * coalesce(lift, 1) + 1e-9, 6)::DOUBLE AS score, coalesce(lift, 1) > 1 AS boosted FROM sc LEFT JOIN li USING (group_id, item_id)""")
def group_fair_boost(spark, sf_dir):
    lists, own = genre_lists(spark, sf_dir), members(spark, sf_dir)
    scores = own.join(lists, "user_id").groupBy("group_id", "item_id").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 9).alias("score"))
    return rounded(S.fair_boost(scores, lists, own), 1e-9)


@query(f"""{GENRE_TOP}, rc AS (SELECT user_id, item_id AS other FROM interactions GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, max(event_id) DESC) <= 5),
b AS (SELECT g.user_id, g.item_id, other, {JACCARD.format(a="x.genres", b="y.genres")} AS s FROM g JOIN content x ON g.item_id = x.content_id JOIN rc ON g.user_id = rc.user_id JOIN content y ON other = y.content_id)
SELECT user_id, item_id, other AS because, round(s, 6) AS similarity FROM b QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY s DESC, other) = 1""")
def history_explanation(spark, sf_dir):
    return rounded(S.history_explanation(genre_lists(spark, sf_dir), interactions(spark, sf_dir), content(spark, sf_dir)))


@query(f"""{PAIRS}, s AS (SELECT a, b, round(dot / sqrt(xx * yy), 9) AS similarity FROM p), e AS (SELECT a AS user_id, b AS neighbour, similarity FROM s UNION ALL SELECT b, a, similarity FROM s), l AS (SELECT user_id, max(item_id) AS item_id FROM m GROUP BY 1),
r AS (SELECT l.user_id, l.item_id, neighbour, similarity, m.r AS rating FROM l JOIN m ON l.item_id = m.item_id JOIN e ON e.user_id = l.user_id AND e.neighbour = m.user_id)
SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id, item_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank, neighbour, round(similarity, 6) AS similarity, rating FROM r QUALIFY rank <= 5""")
def neighbour_explanation(spark, sf_dir):
    matrix = U.user_item_matrix(interactions(spark, sf_dir))
    lists = matrix.groupBy("user_id").agg(F.max("item_id").alias("item_id"))
    near = strips.nearest_raters(lists, matrix)
    ratings = matrix.select(F.col("user_id").alias("neighbour"), "item_id", "rating")
    return rounded(near.join(ratings.hint("merge"), ["neighbour", "item_id"]).select("user_id", "item_id", "rank", "neighbour", "similarity", "rating"))


@query(f"""{GENRE_TOP}, o AS (SELECT user_id, rank, score, genres FROM g JOIN content ON item_id = content_id), p AS (SELECT x.user_id, avg(1 - {JACCARD.format(a="x.genres", b="y.genres")}) AS diversity FROM o x JOIN o y ON x.user_id = y.user_id AND x.rank < y.rank GROUP BY 1), a AS (SELECT user_id, avg(score) AS accuracy FROM o GROUP BY 1)
SELECT user_id, round(accuracy, 6) AS accuracy, round(coalesce(diversity, 0), 6)::DOUBLE AS diversity, round(0.4 * accuracy + 0.2 * coalesce(diversity, 0) + 1e-9, 6)::DOUBLE AS overall FROM a LEFT JOIN p USING (user_id)""")
def overall_score(spark, sf_dir):
    lists, items = genre_lists(spark, sf_dir), content(spark, sf_dir)
    known = lists.join(items.select(F.col("content_id").alias("item_id")), "item_id", "left_semi")
    parts = {"accuracy": known.groupBy("user_id").agg(F.avg("score").alias("value")), "diversity": E.intra_list_diversity(lists, items).select("user_id", F.col("diversity").alias("value"))}
    out = S.overall_score(parts, {"accuracy": 0.4, "diversity": 0.2})
    return rounded(out.select("user_id", "accuracy", "diversity", (F.col("overall") + 1e-9).alias("overall")))


@query(f"""WITH {INTERACTIONS}, a AS (SELECT ts::DATE AS day, round(avg(rating) / 5, 9) AS ndcg, round(count(DISTINCT item_id) / count(*), 9) AS diversity, round(avg(value), 9) AS latency, CAST(count(*) AS DOUBLE) AS throughput FROM interactions GROUP BY 1),
i AS (SELECT *, concat_ws(',', CASE WHEN ndcg < 0.35 THEN 'ndcg' END, CASE WHEN diversity < 0.65 THEN 'diversity' END, CASE WHEN latency > 100 THEN 'latency' END, CASE WHEN throughput < 500 THEN 'throughput' END) AS issues FROM a), n AS (SELECT *, CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END AS n FROM i)
SELECT CAST(day AS VARCHAR) AS day, issues, CASE WHEN n = 0 AND ndcg >= 0.4 AND diversity >= 0.7 THEN 'A' WHEN n = 0 THEN 'B' WHEN n = 1 THEN 'C' WHEN n = 2 THEN 'D' ELSE 'F' END AS grade,
CASE WHEN ndcg - lag(ndcg) OVER (ORDER BY day) > 0.01 THEN 'improving' WHEN ndcg - lag(ndcg) OVER (ORDER BY day) < -0.01 THEN 'declining' ELSE 'stable' END AS trend FROM n""")
def quality_grade_trend(spark, sf_dir):
    from pyspark.sql import Window as W

    daily = interactions(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg("rating") / 5, 9).alias("ndcg"), F.round(F.countDistinct("item_id") / F.count(F.lit(1)), 9).alias("diversity"), F.round(F.avg("value"), 9).alias("latency"), F.count(F.lit(1)).cast("double").alias("throughput"))
    # one row a day
    change = F.col("ndcg") - F.lag("ndcg").over(W.orderBy("day"))
    trend = F.when(change > 0.01, "improving").when(change < -0.01, "declining").otherwise("stable")
    return S.quality_grade(daily).select("day", "issues", "grade", trend.alias("trend"))


@query("""WITH l AS (SELECT CASE event_id % 7 WHEN 0 THEN 'batch' WHEN 1 THEN 'conflict' WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'resolved' ELSE 'conflict' END ELSE 'stream' END AS kind, ts FROM events),
a AS (SELECT count(*) FILTER (kind = 'batch') AS b, count(*) FILTER (kind = 'stream') AS s, count(*) FILTER (kind = 'conflict') AS c, count(*) FILTER (kind = 'resolved') AS r, epoch_us(max(ts)) - epoch_us(max(ts) FILTER (kind = 'batch')) AS lag FROM l)
SELECT b AS batch_updates, s AS stream_updates, c AS conflicts, r AS resolved, (lag / 1e6)::DOUBLE AS lag_seconds, round(greatest(0.0, 1 - (c - r) / (b + s)), 6)::DOUBLE AS success_rate FROM a""")
def sync_metrics(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(i % 7 == 0, "batch").when(i % 7 == 1, "conflict").when(i % 7 == 2, F.when(i % 2 == 0, "resolved").otherwise("conflict")).otherwise("stream")
    log = e.select(kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return rounded(S.sync_metrics(log, F.lit(log.agg(F.max("ts")).first()[0])))


@query(f"""WITH {INTERACTIONS}, r AS (SELECT CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'a' ELSE 'b' END AS variant, 'rating' AS metric, rating AS x FROM interactions UNION ALL SELECT CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'a' ELSE 'b' END, 'value', value FROM interactions),
a AS (SELECT metric, variant, count(*) AS n, avg(x) AS mean, var_samp(x) AS v FROM r GROUP BY 1, 2), o AS (SELECT a.metric, a.variant, a.n, a.mean, c.mean AS cm, c.n AS cn, (a.mean - c.mean) / c.mean AS lift, (a.mean - c.mean) / sqrt(a.v / a.n + c.v / c.n) AS t FROM a JOIN a c ON a.metric = c.metric AND c.variant = 'control' AND a.variant <> 'control')
SELECT metric, variant, n, round(mean + 1e-9, 6) AS mean, round(cm + 1e-9, 6) AS control_mean, round(lift + 1e-9, 6) AS lift, round(t + 1e-9, 6) AS t, abs(t) > 1.96 AS significant, CASE WHEN n < 30 OR cn < 30 THEN 'insufficient_data' WHEN abs(t) > 1.96 AND lift > 0 THEN 'declare_winner' WHEN abs(t) > 1.96 THEN 'stop' ELSE 'continue' END AS decision FROM o""")
def experiment_report(spark, sf_dir):
    u = F.col("user_id") % 3
    results = interactions(spark, sf_dir).select(F.when(u == 0, "control").when(u == 1, "a").otherwise("b").alias("variant"), "rating", "value")
    return rounded(S.experiment_report(results, ["rating", "value"], "control"), 1e-9)


@query(f"""{GENRE_TOP}, s AS (SELECT 'group' AS kind, c_mktsegment AS name, avg(score) AS v FROM g JOIN customer ON user_id = c_custkey GROUP BY 2 UNION ALL SELECT 'type', content_type, avg(score) FROM g JOIN content ON item_id = content_id GROUP BY 2), m AS (SELECT kind, name, round(v / max(v) OVER (PARTITION BY kind), 9) AS value FROM s)
SELECT kind, count(*) AS n, round(avg(value) + 1e-9, 6) AS score, count(*) FILTER (value < 0.95) = 0 AS passed, CASE WHEN avg(value) >= 0.9 THEN 'compliant' WHEN avg(value) >= 0.8 THEN 'mostly_compliant' WHEN avg(value) >= 0.6 THEN 'partly_compliant' ELSE 'non_compliant' END AS band, coalesce(string_agg(name, ',' ORDER BY name) FILTER (value < 0.95), '') AS alerts FROM m GROUP BY 1""")
def fairness_report(spark, sf_dir):
    from pyspark.sql import Window as W

    lists = genre_lists(spark, sf_dir)
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("name"))
    types = content(spark, sf_dir).select(F.col("content_id").alias("item_id"), F.col("content_type").alias("name"))
    rows = lists.join(groups, "user_id").groupBy(F.lit("group").alias("kind"), "name").agg(F.avg("score").alias("v")).unionByName(lists.join(types, "item_id").groupBy(F.lit("type").alias("kind"), "name").agg(F.avg("score").alias("v")))
    measures = rows.select("kind", "name", F.round(F.col("v") / F.max("v").over(W.partitionBy("kind")), 9).alias("value"), F.lit(0.95).alias("limit"))
    return rounded(S.fairness_report(measures), 1e-9)


@query(f"""{GENRE_TOP}, o AS (SELECT user_id, genres, creator, content_type FROM interactions JOIN content ON item_id = content_id), n2 AS (SELECT user_id, count(*) AS n, list_distinct(flatten(list(genres))) AS known FROM o GROUP BY 1), c AS (SELECT user_id, creator, count(*) AS nc FROM o GROUP BY 1, 2), t AS (SELECT user_id, content_type, count(*) AS nt FROM o GROUP BY 1, 2),
b AS (SELECT g.user_id, g.item_id, len(list_intersect(list_distinct(x.genres), known)) / len(list_distinct(x.genres)) AS genre, coalesce(nc, 0) / n AS creator, coalesce(nt, 0) / n AS type FROM g JOIN content x ON g.item_id = x.content_id JOIN n2 ON g.user_id = n2.user_id LEFT JOIN c ON c.user_id = g.user_id AND c.creator = x.creator LEFT JOIN t ON t.user_id = g.user_id AND t.content_type = x.content_type),
r AS (SELECT user_id, item_id, 'genre' AS feature, round(genre, 9) AS v FROM b UNION ALL SELECT user_id, item_id, 'creator', round(creator, 9) FROM b UNION ALL SELECT user_id, item_id, 'type', round(type, 9) FROM b)
SELECT user_id, item_id, feature, round(v, 6) AS contribution, CAST(row_number() OVER (PARTITION BY user_id, item_id ORDER BY v DESC, feature) AS INTEGER) AS rank FROM r""")
def feature_contributions(spark, sf_dir):
    return rounded(S.feature_contributions(genre_lists(spark, sf_dir), interactions(spark, sf_dir), content(spark, sf_dir)))


@query(f"""WITH {INTERACTIONS}, {CONTENT}, o AS (SELECT user_id, rating, genres, content_type FROM interactions JOIN content ON item_id = content_id), e AS (SELECT user_id, unnest(genres) AS genre FROM o), d AS (SELECT user_id, count(DISTINCT genre) / count(*) AS diversity FROM e GROUP BY 1),
gr AS (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS r FROM e GROUP BY 1, 2), gs AS (SELECT user_id, string_agg(genre, ',' ORDER BY r) AS genres FROM gr WHERE r <= 5 GROUP BY 1), tr AS (SELECT user_id, content_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, content_type) AS r FROM o GROUP BY 1, 2),
ts2 AS (SELECT user_id, string_agg(content_type, ',' ORDER BY r) AS types FROM tr WHERE r <= 3 GROUP BY 1), s AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS deviation FROM o GROUP BY 1)
SELECT user_id, genres, types, round(mean + 1e-9, 6) AS mean, round(deviation + 1e-9, 6) AS deviation, round(diversity + 1e-9, 6) AS diversity FROM gs JOIN ts2 USING (user_id) JOIN s USING (user_id) JOIN d USING (user_id)""")
def preference_summary(spark, sf_dir):
    return rounded(S.preference_summary(interactions(spark, sf_dir), content(spark, sf_dir)), 1e-9)


@query()
def mmr_rerank(spark, sf_dir):
    return S.mmr_rerank(genre_lists(spark, sf_dir), content(spark, sf_dir))


@query()
def content_recommend(spark, sf_dir):
    return S.content_recommend(interactions(spark, sf_dir), content(spark, sf_dir))


@query()
def factor_export(spark, sf_dir):
    return S.factor_export(interactions(spark, sf_dir))
