"""Registered queries of feedback, adaptation and explanation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import feedback as B
from ..operators import users as U
from ..sources.views import CONTENT, INTERACTIONS, PURCHASES, USERS, content, interactions, purchases, table, users
from .q_recommend import GENRE_TOP, GROUPS, genre_lists, members
from .q_users import rounded
from .registry import query

#: Events as signals: a completion and a duration from the value, a query for some.
SIGNALS = """sg AS (SELECT event_id, user_id, ts, event_type AS kind, CASE WHEN event_id % 4 <> 0 THEN (value % 100) / 100 END AS completion, value * 10 AS watched, CAST(500 AS DOUBLE) AS duration, CAST(event_id % 3 AS INTEGER) AS positives, CAST(event_id % 2 AS INTEGER) AS negatives,
CASE WHEN event_id % 6 = 0 THEN 'q' || user_id END AS query, CAST(event_id % 8 AS DOUBLE) AS rating, (event_id % 101) / 100 AS value FROM events)"""


def signals(spark, sf_dir):
    e, i = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    return e.select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), F.when(i % 4 != 0, (F.col("value") % 100) / 100).alias("completion"), (F.col("value") * 10).alias("watched"), F.lit(500.0).alias("duration"), (i % 3).cast("int").alias("positives"), (i % 2).cast("int").alias("negatives"), F.when(i % 6 == 0, F.concat(F.lit("q"), F.col("user_id").cast("string"))).alias("query"), (i % 8).cast("double").alias("rating"), ((i % 101) / 100).alias("value"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1-5' WHEN 1 THEN '1-10' WHEN 2 THEN '0-100' WHEN 3 THEN 'thumbs' ELSE 'stars' END AS scale, CAST(event_id % 12 - 1 AS DOUBLE) AS v FROM events)
SELECT event_id, round(CASE scale WHEN '1-5' THEN greatest(0, least(1, (v - 1) / 4)) WHEN '1-10' THEN greatest(0, least(1, (v - 1) / 9)) WHEN '0-100' THEN greatest(0, least(1, v / 100)) WHEN 'thumbs' THEN CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END END, 6)::DOUBLE AS rating FROM r""")
def feedback_normalise(spark, sf_dir):
    i = F.col("event_id")
    scale = F.when(i % 5 == 0, "1-5").when(i % 5 == 1, "1-10").when(i % 5 == 2, "0-100").when(i % 5 == 3, "thumbs").otherwise("stars")
    return rounded(table(spark, sf_dir, "events").select("event_id", B.normalised_rating((i % 12 - 1).cast("double"), scale).cast("double").alias("rating")))


@query(f"WITH {SIGNALS} SELECT event_id, round(greatest(0.0, least(1.0, 0.5 + coalesce((completion - 0.5) * 0.3, 0) + coalesce((least(1.0, watched / duration) - 0.5) * 0.2, 0) + 0.1 * positives - 0.2 * negatives)), 6)::DOUBLE AS implicit_rating FROM sg")
def implicit_rating(spark, sf_dir):
    return rounded(B.implicit_rating(signals(spark, sf_dir)).select("event_id", "implicit_rating"))


VALENCE = f"""WITH {SIGNALS}, vv AS (SELECT *, CASE WHEN kind = 'skip' THEN -1 WHEN kind = 'like' THEN 1 WHEN value >= 0.8 THEN 2 WHEN value >= 0.6 THEN 1 WHEN value > 0.4 THEN 0 WHEN value > 0.2 THEN -1 ELSE -2 END AS valence,
CAST(CASE kind WHEN 'rating' THEN 1.0 WHEN 'like' THEN 0.9 WHEN 'skip' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence FROM sg)"""


@query(f"{VALENCE} SELECT event_id, valence, confidence FROM vv")
def feedback_valence(spark, sf_dir):
    return B.valence(signals(spark, sf_dir)).select("event_id", "valence", "confidence")


@query(f"""WITH {SIGNALS} SELECT event_id, CASE WHEN query IS NOT NULL THEN 'search' WHEN completion < 0.1 THEN 'skip' WHEN completion IS NOT NULL THEN 'view' ELSE 'click' END AS class,
round(list_avg(list_filter([CASE WHEN completion IS NOT NULL THEN 0.8 END, CASE WHEN watched IS NOT NULL THEN 0.7 END, CASE WHEN query IS NOT NULL THEN 0.6 END], lambda x: x IS NOT NULL)), 6)::DOUBLE AS confidence FROM sg""")
def implicit_classify(spark, sf_dir):
    return rounded(B.implicit_classes(signals(spark, sf_dir)).select("event_id", "class", "confidence"))


@query(f"WITH {SIGNALS} SELECT event_id, CASE WHEN user_id IS NULL THEN 'no_user' WHEN rating NOT BETWEEN 0 AND 5 THEN 'bad_rating' WHEN duration NOT BETWEEN 0 AND 86400 THEN 'bad_duration' WHEN completion NOT BETWEEN 0 AND 1 THEN 'bad_completion' END AS reject FROM sg")
def feedback_validate(spark, sf_dir):
    return B.validated(signals(spark, sf_dir)).select("event_id", "reject")


@query(f"WITH {SIGNALS} SELECT event_id, 'query' AS signal, query AS value FROM sg WHERE query IS NOT NULL UNION ALL SELECT event_id, 'kind', kind FROM sg WHERE kind IS NOT NULL")
def context_signals(spark, sf_dir):
    return B.context_signals(signals(spark, sf_dir), ["query", "kind"])


@query(f"""{VALENCE}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > floor(count(*) OVER (PARTITION BY user_id) / 2) AS newer FROM vv WHERE ts >= (SELECT max(ts) FROM vv) - INTERVAL 30 DAY),
a AS (SELECT user_id, count(*) AS n, sum(valence * confidence) / sum(confidence) AS mean, count(*) FILTER (valence > 0) AS positives, count(*) FILTER (valence < 0) AS negatives, avg(valence) FILTER (newer) - avg(valence) FILTER (NOT newer) AS d FROM o GROUP BY 1)
SELECT user_id, n, round(mean, 6) AS mean, positives, negatives, CASE WHEN d > 0.3 THEN 'improving' WHEN d < -0.3 THEN 'declining' ELSE 'stable' END AS trend FROM a""")
def feedback_summary(spark, sf_dir):
    return rounded(B.feedback_summary(B.valence(signals(spark, sf_dir))))


@query(f"""{VALENCE}, h AS (SELECT kind, hour(ts) AS hour, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, hour(ts)) AS r FROM vv GROUP BY 1, 2), a AS (SELECT kind, count(*) AS n, avg(confidence) AS c, avg(CAST(valence > 0 AS DOUBLE)) AS p FROM vv GROUP BY 1)
SELECT kind, n, round(c, 6) AS confidence, round(p, 6) AS positive_share, CAST(hour AS INTEGER) AS peak_hour FROM a JOIN h USING (kind) WHERE r = 1""")
def feedback_insights(spark, sf_dir):
    return rounded(B.feedback_insights(B.valence(signals(spark, sf_dir))))


@query(f"""WITH {INTERACTIONS}, c AS (SELECT item_id AS a, (item_id * 7 + 3) % 100 AS b, CASE WHEN rating >= 3 THEN 1 ELSE -1 END AS w, rating AS s FROM interactions), u AS (SELECT a AS item_id, w, s FROM c UNION ALL SELECT b, -w, s FROM c)
SELECT item_id, count(*) FILTER (w > 0) AS wins, count(*) FILTER (w < 0) AS losses, sum(w * s) AS score FROM u GROUP BY 1""")
def pairwise_comparisons(spark, sf_dir):
    own = interactions(spark, sf_dir).select(F.col("item_id").alias("item_a"), ((F.col("item_id") * 7 + 3) % 100).alias("item_b"), F.when(F.col("rating") >= 3, "a").otherwise("b").alias("preferred"), F.col("rating").alias("strength"))
    return B.pairwise_wins(own)


@query("""SELECT user_id % 20 AS explanation_id, count(*) AS n, round(avg((event_id % 5 + event_id % 4 + event_id % 3) / 3), 6) AS score FROM events GROUP BY 1""")
def rated_explanations(spark, sf_dir):
    i = F.col("event_id")
    return rounded(B.rated_explanations(table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("explanation_id"), (i % 5).alias("helpfulness"), (i % 4).alias("clarity"), (i % 3).alias("accuracy"))))


@query(f"""WITH {INTERACTIONS}, f AS (SELECT user_id, count(*) AS n, least(1.0, count(*) / 100) AS a, 1 / (1 + coalesce(stddev_samp(rating), 0)) AS b, 0.5 AS c, 1 / (1 + count(DISTINCT interaction_type)) AS d FROM interactions GROUP BY 1), s AS (SELECT user_id, n, 0.3 * a + 0.3 * b + 0.2 * c + 0.2 * d AS score FROM f)
SELECT user_id, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.8 THEN 'very_high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'very_low' END AS level,
round(greatest(0, score - 1.96 * sqrt(score * (1 - score) / n)), 6)::DOUBLE AS low, round(least(1, score + 1.96 * sqrt(score * (1 - score) / n)), 6)::DOUBLE AS high FROM s""")
def confidence_score(spark, sf_dir):
    a = interactions(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("sd"), F.countDistinct("interaction_type").alias("k"))
    features = a.select("user_id", "n", F.least(F.lit(1.0), F.col("n") / 100).alias("reliability"), (1 / (1 + F.col("sd"))).alias("certainty"), F.lit(0.5).alias("recency"), (1 / (1 + F.col("k"))).alias("simplicity"))
    return rounded(B.confidence(features).select("user_id", "score", "level", "low", "high"))


#: Two detectors' results for each user, from its events.
DRIFTS = f"""{{with_}}dr AS (SELECT user_id, 'rating' AS detector, stddev_pop(rating) / 2 AS severity, least(1.0, count(*) / 100) AS confidence FROM interactions GROUP BY 1 UNION ALL SELECT user_id, 'value', stddev_pop(value) / 50, 0.6 FROM interactions GROUP BY 1)"""
DRIFT_SQL = f"WITH {INTERACTIONS}, " + DRIFTS.replace("{with_}", "") + ", se AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(confidence * severity, 9) DESC, detector) = 1)"


def drifts(spark, sf_dir):
    own = interactions(spark, sf_dir)
    a = own.groupBy("user_id").agg((F.stddev_pop("rating") / 2).alias("severity"), F.least(F.lit(1.0), F.count(F.lit(1)) / 100).alias("confidence")).withColumn("detector", F.lit("rating"))
    b = own.groupBy("user_id").agg((F.stddev_pop("value") / 50).alias("severity"), F.lit(0.6).alias("confidence")).withColumn("detector", F.lit("value"))
    return B.drift_selected(a.unionByName(b))


@query(f"{DRIFT_SQL} SELECT user_id, detector, round(severity, 6) AS severity, round(confidence, 6)::DOUBLE AS confidence FROM se")
def snapshot_drift_select(spark, sf_dir):
    return rounded(drifts(spark, sf_dir))


@query(f"""{DRIFT_SQL}, e AS (SELECT *, user_id % 4 AS earlier FROM se) SELECT user_id, CASE WHEN severity >= 0.7 AND confidence >= 0.7 THEN 'immediate' WHEN severity >= 0.4 THEN 'gradual' WHEN severity >= 0.2 THEN 'conservative' ELSE 'monitor' END AS strategy,
round(CASE WHEN severity >= 0.7 THEN 0.1 WHEN severity >= 0.4 THEN 0.05 ELSE 0.01 END / (1 + 0.1 * earlier), 6)::DOUBLE AS rate, CASE WHEN severity >= 0.7 THEN 1 WHEN severity >= 0.4 THEN 5 ELSE 10 END AS steps, round(least(100.0, 100 * (0.6 * severity + 0.4 * confidence)), 6)::DOUBLE AS priority FROM e""")
def adaptation_plan(spark, sf_dir):
    return rounded(B.adaptation_plan(drifts(spark, sf_dir).withColumn("earlier", F.col("user_id") % 4)).select("user_id", "strategy", "rate", "steps", "priority"))


@query(f"""WITH {INTERACTIONS}, m AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') / 50 AS b, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') / 50 AS a FROM interactions GROUP BY 1)
SELECT user_id, round(b, 6) AS before, round(a, 6) AS after, b - a > 0.05 OR a < 0.35 AS rollback FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def rollback_decision(spark, sf_dir):
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    m = interactions(spark, sf_dir).groupBy("user_id").agg((F.avg(F.when(~late, F.col("value"))) / 50).alias("before"), (F.avg(F.when(late, F.col("value"))) / 50).alias("after"))
    return rounded(B.rollback(m.filter("before is not null and after is not null")))


@query(f"WITH {INTERACTIONS}, a AS (SELECT interaction_type AS arm, count(*) AS n, avg(rating / 5) AS m FROM interactions GROUP BY 1) SELECT arm, n, round(m, 6) AS mean, round(exp(m) / sum(exp(m)) OVER (), 6) AS weight FROM a")
def bandit_weights(spark, sf_dir):
    return rounded(B.bandit_weights(interactions(spark, sf_dir).select(F.col("interaction_type").alias("arm"), (F.col("rating") / 5).alias("reward"))))


@query(f"""WITH {INTERACTIONS}, g AS (SELECT avg(rating) AS m FROM interactions), u AS (SELECT user_id, avg(rating) - m AS ub FROM interactions, g GROUP BY user_id, m), i AS (SELECT item_id, avg(rating) - m AS ib FROM interactions, g GROUP BY item_id, m),
p AS (SELECT DISTINCT user_id, item_id FROM interactions), f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT p.user_id, p.item_id, round(greatest(0.0, least(5.0, 2.5 + ub + ib + list_dot_product(a.v, b.v))), 6) AS score FROM p JOIN u USING (user_id) JOIN i USING (item_id) JOIN f a ON a.vec_id = p.user_id JOIN f b ON b.vec_id = p.item_id""")
def mf_predict(spark, sf_dir):
    own = interactions(spark, sf_dir)
    mean = own.agg(F.avg("rating").alias("m"))
    bias = lambda k, n: own.groupBy(k).agg(F.avg("rating").alias("r")).crossJoin(F.broadcast(mean)).select(k, (F.col("r") - F.col("m")).alias(n))
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    u = bias("user_id", "user_bias").join(v.select(F.col("vec_id").alias("user_id"), F.col("v").alias("user_factors")), "user_id")
    i = bias("item_id", "item_bias").join(v.select(F.col("vec_id").alias("item_id"), F.col("v").alias("item_factors")), "item_id")
    return rounded(B.factor_scores(u, i, own.select("user_id", "item_id").distinct(), 2.5))


@query(f"""WITH {PURCHASES}, {CONTENT}, e AS (SELECT user_id, ts, l_orderkey, l_linenumber, item_id, rating, (rating - 2.5) / 2.5 AS x, unnest(list_distinct(genres)) AS genre FROM purchases JOIN content ON item_id = content_id),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, genre ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, item_id DESC, rating DESC) - 1 AS k FROM e) SELECT user_id, genre, sum(CAST(round(x * (0.3 * pow(0.7, k)) * 1e9) AS BIGINT))::DOUBLE / 1e9 AS preference, count(*) AS n FROM k GROUP BY 1, 2""")
def online_content_profile(spark, sf_dir):
    out = B.online_profile(purchases(spark, sf_dir), content(spark, sf_dir), ["ts", "l_orderkey", "l_linenumber", "item_id", "rating"])
    return out.select("user_id", "genre", "preference", "n")


@query(f"""{GENRE_TOP} SELECT user_id, item_id, CASE WHEN item_id % 2 = 0 THEN 'You like ' || genres[1] || ': ' || title ELSE 'Popular: ' || title || ' (' || printf('%.2f', score) || ')' END AS text FROM g JOIN content ON item_id = content_id""")
def template_explanation(spark, sf_dir):
    lists = genre_lists(spark, sf_dir).join(content(spark, sf_dir).select(F.col("content_id").alias("item_id"), "title", F.col("genres")[0].alias("genre")), "item_id").withColumn("method", F.when(F.col("item_id") % 2 == 0, "genre").otherwise("popular"))
    return B.template_explanation(lists, {"default": "Popular: {title} ({score})", "genre": "You like {genre}: {title}"}).select("user_id", "item_id", "text")


@query("""SELECT d.doc_id, round((1 + CAST(lang <> '' AS INTEGER) + CAST(quality IS NOT NULL AS INTEGER) + CAST(toxic IS NOT NULL AS INTEGER)) / 4, 6) AS completeness FROM documents d LEFT JOIN labels USING (doc_id)""")
def explanation_completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(B.completeness(rows, ["doc_id", "lang", "quality", "toxic"]).select("doc_id", "completeness"))


@query(f"""{GENRE_TOP}, o AS (SELECT user_id, item_id FROM g WHERE rank <= 7), w AS (SELECT user_id, item_id FROM g WHERE rank >= 4), j AS (SELECT coalesce(o.user_id, w.user_id) AS user_id, o.item_id AS o, w.item_id AS n FROM o FULL JOIN w ON o.user_id = w.user_id AND o.item_id = w.item_id)
SELECT user_id, count(*) FILTER (o IS NULL) AS added, count(*) FILTER (n IS NULL) AS removed, count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) AS unchanged FROM j GROUP BY 1""")
def recommendation_diff(spark, sf_dir):
    lists = genre_lists(spark, sf_dir)
    return B.list_changes(lists.filter("rank <= 7"), lists.filter("rank >= 4"))


@query(f"{GROUPS}, a AS (SELECT group_id, item_id, avg(score) AS m, min(score) AS lo, max(score) AS hi FROM own GROUP BY 1, 2) SELECT group_id, item_id, round(m, 6) AS mean, round(lo, 6) AS lowest, round(hi, 6) AS highest, round(1 - (hi - lo), 6) AS agreement, CASE WHEN 1 - (hi - lo) >= 0.9 THEN 'consensus' WHEN 1 - (hi - lo) >= 0.7 THEN 'mostly' ELSE 'mixed' END AS label FROM a")
def group_explanation(spark, sf_dir):
    return rounded(B.group_explanation(genre_lists(spark, sf_dir), members(spark, sf_dir).select("group_id", "user_id")))


@query("""WITH p AS (SELECT o_custkey AS user_id, lower(replace(o_orderpriority, ' ', '')) || '_' || lower(o_orderstatus) AS feature, avg(CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END) AS value FROM orders GROUP BY 1, 2), t AS (SELECT *, list_distinct(string_split(feature, '_')) AS t FROM p)
SELECT a.user_id, a.feature AS a, b.feature AS b FROM t a JOIN t b ON a.user_id = b.user_id AND a.feature < b.feature AND a.value * b.value < -0.5 WHERE len(list_intersect(a.t, b.t)) > 0 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) > 0.3""")
def preference_contradictions(spark, sf_dir):
    feature = F.concat(F.lower(F.replace("o_orderpriority", F.lit(" "))), F.lit("_"), F.lower("o_orderstatus"))
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), feature.alias("feature")).agg(F.avg(F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0)).alias("value"))
    return B.preference_contradictions(p.withColumn("confidence", F.lit(1.0)), 0.3)


@query("""SELECT p_partkey AS content_id, CASE WHEN contains(lower(p_type), 'promo') OR contains(lower(p_type), 'economy') THEN 'price' WHEN contains(lower(p_type), 'large') OR contains(lower(p_type), 'small') THEN 'size' ELSE 'general' END AS category FROM part""")
def preference_category(spark, sf_dir):
    return content(spark, sf_dir).select("content_id", B.preference_category(F.col("content_type"), {"price": ["promo", "economy"], "size": ["large", "small"]}).alias("category"))


@query(f"""WITH {USERS} SELECT user_id, CASE WHEN income <= 0 THEN 'none' WHEN income <= 2500 THEN 'low' WHEN income <= 5000 THEN 'middle' WHEN income <= 7500 THEN 'upper' ELSE 'high' END AS income_band, region = 'AMERICA' AS is_american, substring(user_group, 1, 3) AS group_code FROM users""")
def demographic_features(spark, sf_dir):
    return B.demographics(users(spark, sf_dir)).select("user_id", "income_band", "is_american", "group_code")


@query(f"""WITH {INTERACTIONS}, a AS (SELECT user_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY 1), s AS (SELECT c_mktsegment AS group_value, count(*) AS n, avg(m) AS mean FROM a JOIN customer ON user_id = c_custkey GROUP BY 1)
SELECT group_value, n, round(mean, 6) AS mean, round(mean - (SELECT avg(m) FROM a JOIN customer ON user_id = c_custkey), 6) AS gap FROM s""")
def group_fairness_gap(spark, sf_dir):
    a = U.user_activity(interactions(spark, sf_dir)).join(users(spark, sf_dir).select("user_id", F.col("user_group").alias("group_value")), "user_id")
    whole = a.agg(F.avg("mean").alias("w"))
    return rounded(a.groupBy("group_value").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean")).crossJoin(F.broadcast(whole)).select("group_value", "n", "mean", (F.col("mean") - F.col("w")).alias("gap")))


@query(f"""WITH {INTERACTIONS}, s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, rating FROM interactions), g AS (SELECT count(*) FILTER (variant = 'a') AS na, count(*) FILTER (variant = 'b') AS nb, avg(rating) FILTER (variant = 'b') - avg(rating) FILTER (variant = 'a') AS d, sqrt((var_pop(rating) FILTER (variant = 'a') + var_pop(rating) FILTER (variant = 'b')) / 2) AS sd FROM s),
l AS (SELECT coalesce(CASE WHEN least(na, nb) >= 10 AND sd > 0 THEN d / (sd * sqrt(1 / na + 1 / nb)) END, 0) AS z, sd FROM g), e AS (SELECT z, coalesce(z * 0.1 / nullif(sd, 0), 0) AS evidence FROM l)
SELECT round(z, 6)::DOUBLE AS z, round(evidence, 6)::DOUBLE AS evidence, CASE WHEN evidence >= ln((1 - 0.2) / 0.05) THEN 'stop_treatment_wins' WHEN evidence <= ln(0.2 / (1 - 0.05)) THEN 'stop_control_wins' ELSE 'continue' END AS decision FROM e""")
def sprt(spark, sf_dir):
    own = interactions(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("variant"), "rating")
    return rounded(E.sprt(own, "variant", "rating", "a", "b"))
