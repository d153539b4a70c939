"""Registered queries of recommenders, blending, groups and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import kept
from ..operators import recommend as R
from ..operators import strips as S
from ..operators import users as U
from ..sources.views import CONTENT, INTERACTIONS, content, interactions, table
from .q_users import PAIRS, SESSIONS, rounded, sessions
from .registry import query


def popular_sql(n: int) -> str:
    return f"p AS (SELECT item_id, n, mean, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (SELECT item_id, count(*) AS n, avg(rating) AS mean, round(ln(1 + count(*)) * avg(rating), 9) AS score FROM interactions GROUP BY 1) QUALIFY rank <= {n})"


@query(f"WITH {INTERACTIONS}, {popular_sql(10)} SELECT item_id, n, round(mean, 6) AS mean, round(score, 6) AS score, rank FROM p")
def popular_items(spark, sf_dir):
    return rounded(R.popular_items(interactions(spark, sf_dir)))


def ranked_sql(step: float, n: int = 10) -> str:
    return f"SELECT item_id, CAST(row_number() OVER (ORDER BY o DESC, item_id) AS INTEGER) AS rank, round(1 - {step} * (row_number() OVER (ORDER BY o DESC, item_id) - 1), 6)::DOUBLE AS score FROM b QUALIFY rank <= {n}"


@query(f"WITH {INTERACTIONS}, b AS (SELECT item_id, round(count(*) * avg(rating), 6) AS o FROM interactions WHERE ts >= (SELECT max(ts) FROM interactions) - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 10) {ranked_sql(0.1)}")
def trending_items(spark, sf_dir):
    return rounded(R.trending_items(interactions(spark, sf_dir), least=10))


@query(f"WITH i AS (SELECT o_orderkey AS item_id, CAST(o_orderdate AS TIMESTAMP) AS o FROM orders), b AS (SELECT * FROM i WHERE o >= (SELECT max(o) FROM i) - INTERVAL 30 DAY) {ranked_sql(0.05)}")
def new_releases(spark, sf_dir):
    return rounded(R.new_releases(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))))


@query(f"WITH {INTERACTIONS}, b AS (SELECT item_id, round(avg(rating), 9) AS o FROM interactions GROUP BY 1 HAVING count(rating) >= 50 AND round(avg(rating), 9) >= 2.4) {ranked_sql(0.02)}")
def acclaimed_items(spark, sf_dir):
    return rounded(R.acclaimed_items(interactions(spark, sf_dir), 2.4))


COSINE = f"{PAIRS}, q AS (SELECT user_id, sum(r * r) AS q FROM m GROUP BY 1), s AS (SELECT a, b, dot / sqrt(x.q * y.q) AS sim FROM p JOIN q x ON a = x.user_id JOIN q y ON b = y.user_id), e AS (SELECT a AS user_id, b AS other, sim FROM s UNION ALL SELECT b, a, sim FROM s)"


@query(f"""{COSINE}, t AS (SELECT e.user_id, m.item_id, sum(sim * r) AS s, sum(abs(sim)) AS w FROM e JOIN m ON e.other = m.user_id GROUP BY ALL)
SELECT user_id, item_id, round(s / w, 6) AS score FROM t ANTI JOIN m USING (user_id, item_id)""")
def user_based_predict(spark, sf_dir):
    matrix = kept(U.user_item_matrix(interactions(spark, sf_dir)), "matrix")
    least = matrix.agg(F.min("rating")).first()[0]
    if least is None or least > 0:
        return rounded(S.unseen_scores(matrix))
    # similarities of both signs: pair by pair
    return rounded(R.user_based_scores(matrix, S.pairs(matrix)))


@query(f"""WITH {INTERACTIONS}, m AS (SELECT user_id, item_id, sum(rating) AS r FROM interactions GROUP BY ALL), p AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.r * y.r) AS dot FROM m x JOIN m y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY ALL),
q AS (SELECT item_id, sum(r * r) AS q FROM m GROUP BY 1), s AS (SELECT a, b, dot / sqrt(x.q * y.q) AS sim FROM p JOIN q x ON a = x.item_id JOIN q y ON b = y.item_id), e AS (SELECT a AS item_id, b AS rated, sim FROM s UNION ALL SELECT b, a, sim FROM s),
t AS (SELECT m.user_id, e.item_id, sum(sim * r) / sum(abs(sim)) AS score FROM e JOIN m ON e.rated = m.item_id GROUP BY ALL) SELECT user_id, item_id, round(score, 6) AS score FROM t ANTI JOIN m USING (user_id, item_id)""")
def item_based_predict(spark, sf_dir):
    matrix = U.user_item_matrix(interactions(spark, sf_dir))
    return rounded(R.item_based_scores(matrix, U.pairwise_similarity(matrix, "item_id", "user_id", common=False)))


@query(f"WITH {INTERACTIONS}, {popular_sql(5)}, u AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM interactions)) SELECT user_id, item_id, round(score, 6) AS score, rank FROM u, p")
def cold_start_fallback(spark, sf_dir):
    return rounded(R.cold_start(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), interactions(spark, sf_dir)))


GENRE_TOP = f"""WITH {INTERACTIONS}, {CONTENT}, i AS (SELECT content_id AS item_id, unnest(list_distinct(genres)) AS genre FROM content), gt AS (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS k FROM interactions JOIN i USING (item_id) GROUP BY 1, 2),
ga AS (SELECT item_id, round(0.4 * least(1.0, count(*) / 100) + 0.6 * avg(rating) / 5, 9) AS score FROM interactions GROUP BY 1), gof AS (SELECT DISTINCT user_id, item_id, score FROM gt JOIN i USING (genre) JOIN ga USING (item_id) WHERE k <= 3),
gn AS (SELECT * FROM gof ANTI JOIN interactions USING (user_id, item_id)), g AS (SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM gn QUALIFY rank <= 10)"""


@query(f"{GENRE_TOP} SELECT user_id, item_id, round(score, 6) AS score, rank FROM g")
def genre_popularity_recommend(spark, sf_dir):
    return rounded(genre_lists(spark, sf_dir))


def genre_lists(spark, sf_dir):
    return R.genre_popularity(interactions(spark, sf_dir), content(spark, sf_dir))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.v, i.v), 9) AS similarity FROM v q JOIN v i ON q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)
SELECT query_id, item_id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def exact_knn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(R.knn(vectors, vectors.filter("vec_id % 50 = 0")))


@query(f"""WITH {INTERACTIONS}, d AS (SELECT DISTINCT user_id, item_id FROM interactions), e AS (SELECT user_id, item_id, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM d JOIN embeddings ON item_id = vec_id),
m AS (SELECT user_id, pos, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT user_id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT user_id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS value FROM m JOIN n USING (user_id)""")
def user_profile_embedding(spark, sf_dir):
    return rounded(R.profile_embedding(interactions(spark, sf_dir), table(spark, sf_dir, "embeddings")))


@query(f"""{GENRE_TOP}, {popular_sql(10)}, u AS (SELECT DISTINCT user_id FROM interactions), z AS (SELECT user_id, item_id, score * 0.6 AS score, 'genre' AS c FROM g UNION ALL SELECT user_id, item_id, score * 0.1, 'popular' FROM u, p)
SELECT user_id, item_id, round(sum(score), 6) AS score, string_agg(DISTINCT c, ',' ORDER BY c) AS components FROM z GROUP BY ALL""")
def weighted_blend(spark, sf_dir):
    own = interactions(spark, sf_dir)
    popular = own.select("user_id").distinct().crossJoin(F.broadcast(R.popular_items(own).select("item_id", "score")))
    return rounded(R.weighted_blend({"genre": (genre_lists(spark, sf_dir), 0.6), "popular": (popular, 0.1)}))


@query(f"""{GENRE_TOP}, c AS (SELECT user_id, item_id, CASE WHEN content_type = 'PROMO' THEN score * 1.5 ELSE score END AS score, content_type AS category FROM g JOIN content ON item_id = content_id WHERE content_type <> 'ECONOMY')
SELECT user_id, item_id, category, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, item_id) AS INTEGER) AS category_rank FROM c QUALIFY category_rank <= 3""")
def rule_filter_boost_limit(spark, sf_dir):
    lists = genre_lists(spark, sf_dir).join(content(spark, sf_dir).select(F.col("content_id").alias("item_id"), F.col("content_type").alias("category")), "item_id")
    return rounded(R.category_limit(lists, ["ECONOMY"], ["PROMO"]).select("user_id", "item_id", "category", "score", "category_rank"))


#: Groups of users with the same id modulo 5, of weight 1 or 2, and their lists as SQL.
GROUPS = f"{GENRE_TOP}, mem AS (SELECT DISTINCT user_id % 5 AS group_id, user_id, CAST(1 + user_id % 2 AS DOUBLE) AS weight FROM interactions), siz AS (SELECT group_id, count(*) AS members FROM mem GROUP BY 1), own AS (SELECT group_id, user_id, weight, item_id, score FROM mem JOIN g USING (user_id))"
STATS = ", st AS (SELECT group_id, item_id, count(*) AS voters, sum(score * weight) / sum(weight) AS mean, min(score) AS low, max(score) AS high, stddev_pop(score) AS sd, sum(CASE WHEN score > 0.5 THEN weight ELSE 0 END) AS app, count(*) FILTER (score > 0.5) AS apps, sum(score * weight) AS total FROM own GROUP BY 1, 2)"


def members(spark, sf_dir):
    u = interactions(spark, sf_dir).select("user_id").distinct()
    return u.select((F.col("user_id") % 5).alias("group_id"), "user_id", (1 + F.col("user_id") % 2).cast("double").alias("weight"))


def grouped(strategy: str):
    def run(spark, sf_dir):
        return rounded(R.group_scores(genre_lists(spark, sf_dir), members(spark, sf_dir), strategy))

    return run


def _register(name: str, strategy: str, sql: str) -> None:
    f = grouped(strategy)
    f.__name__ = name
    query(sql)(f)


_register("group_average", "average", f"{GROUPS}{STATS} SELECT group_id, item_id, round(mean, 6) AS score, voters FROM st JOIN siz USING (group_id) WHERE voters >= 0.3 * members")
_register("group_least_misery", "least_misery", f"{GROUPS}{STATS} SELECT group_id, item_id, round(low, 6) AS score, voters FROM st WHERE voters >= 2")
_register("group_most_pleasure", "most_pleasure", f"{GROUPS}{STATS} SELECT group_id, item_id, round(high, 6) AS score, voters FROM st")
_register("group_fairness", "fairness", f"{GROUPS}{STATS} SELECT group_id, item_id, round(mean * (1 - sd * 0.3), 6) AS score, voters FROM st")
_register("group_approval", "approval", f"{GROUPS}{STATS} SELECT group_id, item_id, round(app, 6)::DOUBLE AS score, voters FROM st WHERE apps >= 2")
_register("group_borda", "borda", f"{GROUPS}, o2 AS (SELECT group_id, item_id, weight, count(*) OVER (PARTITION BY group_id, user_id) - row_number() OVER (PARTITION BY group_id, user_id ORDER BY score DESC, item_id) AS b FROM own) SELECT group_id, item_id, sum(b * weight) AS score, count(*) AS voters FROM o2 GROUP BY 1, 2 HAVING count(*) >= 2")

TOPN = f"{GROUPS}{STATS}, ch AS (SELECT group_id, item_id, round(mean, 9) AS score, voters, row_number() OVER (PARTITION BY group_id ORDER BY round(mean, 9) DESC, item_id) AS rank FROM st JOIN siz USING (group_id) WHERE voters >= 0.3 * members QUALIFY rank <= 10)"


@query(f"{TOPN} SELECT group_id, item_id, round(score, 6) AS score, voters, CAST(rank AS INTEGER) AS rank FROM ch")
def group_recommend_topn(spark, sf_dir):
    return rounded(R.group_topn(genre_lists(spark, sf_dir), members(spark, sf_dir)))


@query(f"""{GROUPS}{STATS}, ch AS (SELECT group_id, item_id, row_number() OVER (PARTITION BY group_id ORDER BY round(mean, 9) DESC, item_id) AS rank FROM st QUALIFY rank <= 10), ea AS (SELECT mem.group_id, mem.user_id, avg(coalesce(g.score, 0)) AS s FROM mem JOIN ch USING (group_id) LEFT JOIN g ON g.user_id = mem.user_id AND g.item_id = ch.item_id GROUP BY 1, 2)
SELECT group_id, round(avg(s), 6) AS mean, round(min(s), 6) AS lowest, round(max(s), 6) AS highest, round(stddev_pop(s), 6) AS deviation, count(*) FILTER (s > 0.1) AS satisfied, round(1 - coalesce(stddev_pop(s) / nullif(avg(s), 0), 0), 6) AS fairness FROM ea GROUP BY 1""")
def group_satisfaction(spark, sf_dir):
    lists, own = genre_lists(spark, sf_dir), members(spark, sf_dir)
    scored = R.group_scores(lists, own, "fairness").select("group_id", "item_id")
    plain = lists.join(own, "user_id").groupBy("group_id", "item_id").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score")).withColumn("score", F.round("score", 9)).join(scored, ["group_id", "item_id"], "left_semi")
    chosen = R.top(plain, ["group_id"], [F.desc("score"), F.col("item_id")], 10)
    return rounded(R.group_satisfaction(chosen, lists, own, 0.1))


@query(f"""{SESSIONS}, f AS (SELECT interaction_type AS current, lead(interaction_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS next FROM s), n AS (SELECT current, next, count(*) AS n FROM f WHERE next IS NOT NULL GROUP BY 1, 2)
SELECT current, next, n, round(n / sum(n) OVER (PARTITION BY current), 6) AS p FROM n""")
def transition_matrix(spark, sf_dir):
    return rounded(R.transition_matrix(sessions(spark, sf_dir), "interaction_type"))


@query(f"""{SESSIONS}, l AS (SELECT user_id, session, list(interaction_type ORDER BY ts, event_id) AS x FROM s GROUP BY 1, 2), r AS (SELECT DISTINCT user_id, session, array_to_string(x[i:i + k - 1], '>') AS sequence FROM l, LATERAL unnest(range(2, 11)) v(k), LATERAL unnest(range(1, greatest(1, len(x) - k + 2))) t(i)),
n AS (SELECT sequence, count(*) AS n FROM r GROUP BY 1) SELECT sequence, n, round(n / (SELECT count(*) FROM l), 6) AS support FROM n WHERE n >= 0.01 * (SELECT count(*) FROM l)""")
def sequence_mining(spark, sf_dir):
    return rounded(R.sequence_mining(sessions(spark, sf_dir), "interaction_type"))


#: Frequent runs of 1 to 10 items, and the rules they give, as SQL.
RULES = f"""{SESSIONS}, l AS (SELECT user_id, session, min(ts) AS start, list(interaction_type ORDER BY ts, event_id) AS x FROM s GROUP BY 1, 2), r AS (SELECT DISTINCT user_id, session, x[i:i + k - 1] AS run FROM l, LATERAL unnest(range(1, 11)) v(k), LATERAL unnest(range(1, greatest(1, len(x) - k + 2))) t(i)),
n AS (SELECT run, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT count(*) FROM l)), c AS (SELECT run[1:k] AS antecedent, run[k + 1:len(run)] AS consequent, n FROM n, LATERAL unnest(range(1, len(run))) v(k)),
rules AS (SELECT antecedent, consequent, c.n, c.n / n.n AS confidence FROM c JOIN n ON antecedent = run WHERE c.n / n.n >= 0.1)"""


@query(f"{RULES} SELECT array_to_string(antecedent, '>') AS antecedent, array_to_string(consequent, '>') AS consequent, n, round(confidence, 6) AS confidence FROM rules")
def sequential_rules(spark, sf_dir):
    out = R.sequential_rules(sessions(spark, sf_dir), "interaction_type")
    return rounded(out.select(F.array_join("antecedent", ">").alias("antecedent"), F.array_join("consequent", ">").alias("consequent"), "n", "confidence"))


@query(f"""{RULES}, f AS (SELECT interaction_type AS current, lead(interaction_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS next FROM s), m AS (SELECT current, next, count(*) / sum(count(*)) OVER (PARTITION BY current) AS p FROM f WHERE next IS NOT NULL GROUP BY 1, 2),
e AS (SELECT user_id, arg_max(x, (start, session)) AS x FROM l GROUP BY 1), z AS (SELECT user_id, next, 0.6 * p AS score FROM e JOIN m ON current = x[len(x)] UNION ALL SELECT user_id, unnest(consequent), 0.4 * confidence / len(consequent) FROM (SELECT user_id, x[len(x) - k + 1:len(x)] AS a FROM e, LATERAL unnest(range(1, least(9, len(x)) + 1)) v(k)) JOIN rules ON a = antecedent),
sc AS (SELECT user_id, next, round(sum(score), 9)::DOUBLE AS score FROM z GROUP BY 1, 2) SELECT user_id, next, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY sc.score DESC, next) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5""")
def next_item(spark, sf_dir):
    return rounded(R.next_items(sessions(spark, sf_dir), "interaction_type"))


@query()
def als_train_recommend(spark, sf_dir):
    return R.als(interactions(spark, sf_dir))
