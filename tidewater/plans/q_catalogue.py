"""Registered queries of rules, taxonomies and similarity across domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as K
from ..operators import recommend as R
from ..operators import strips as S
from ..operators import users as U
from ..sources.views import CONTENT, INTERACTIONS, content, interactions, purchases, PURCHASES, table
from .q_recommend import COSINE, GROUPS, genre_lists, members
from .q_users import rounded
from .registry import query


@query(f"WITH {CONTENT} SELECT content_id, content_type, creator FROM content WHERE content_type = 'PROMO' AND creator IN ('Brand#11', 'Brand#12', 'Brand#21')")
def attribute_filter(spark, sf_dir):
    return K.attribute_filter(content(spark, sf_dir), {"content_type": "PROMO", "creator": ["Brand#11", "Brand#12", "Brand#21"]}).select("content_id", "content_type", "creator")


#: Each genre in two of three moods, by its first letter.
MOODS = "mo AS (SELECT DISTINCT genre, CASE WHEN genre < 'g' THEN 'calm' WHEN genre < 'p' THEN 'lively' ELSE 'dark' END AS rule, CAST(length(genre) AS DOUBLE) AS weight FROM (SELECT unnest(genres) AS genre FROM content))"


def moods(spark, sf_dir):
    g = content(spark, sf_dir).select(F.explode("genres").alias("genre")).distinct()
    return g.select("genre", F.when(F.col("genre") < "g", "calm").when(F.col("genre") < "p", "lively").otherwise("dark").alias("rule"), F.length("genre").cast("double").alias("weight"))


@query(f"""WITH {CONTENT}, {MOODS}, e AS (SELECT content_id AS item_id, popularity_score, unnest(list_distinct(genres)) AS genre FROM content), a AS (SELECT rule, item_id, avg(weight) AS score, any_value(popularity_score) AS p FROM e JOIN mo USING (genre) GROUP BY 1, 2)
SELECT rule, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY rule ORDER BY score DESC, p DESC, item_id) AS INTEGER) AS rank FROM a QUALIFY rank <= 10""")
def mood_items(spark, sf_dir):
    return rounded(K.rule_items(content(spark, sf_dir), moods(spark, sf_dir)))


@query(f"""WITH {CONTENT}, e AS (SELECT content_id, content_type, unnest(list_distinct(genres)) AS genre FROM content), m AS (SELECT *, CASE WHEN genre IN ('bolt', 'nut', 'gear') THEN 'hardware' WHEN genre IN ('widget', 'gizmo') THEN 'device' ELSE 'other' END AS meta_genre FROM e)
SELECT meta_genre, count(DISTINCT genre) AS genres, count(DISTINCT content_id) AS items, string_agg(DISTINCT content_type, ',' ORDER BY content_type) AS domains FROM m GROUP BY 1""")
def genre_taxonomy(spark, sf_dir):
    return K.taxonomy(content(spark, sf_dir), {"hardware": ["bolt", "nut", "gear"], "device": ["widget", "gizmo"]})


@query(f"""WITH {CONTENT}, w AS (SELECT content_id, list_sort(list_distinct(string_split(lower(title), ' '))) AS w FROM content), c AS (SELECT w, min(content_id) AS class_id FROM w GROUP BY 1),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM c a JOIN c b ON a.class_id <> b.class_id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.5), l AS (SELECT a, count(*) AS links FROM p GROUP BY 1)
SELECT content_id, class_id, coalesce(links, 0) AS links FROM w JOIN c USING (w) LEFT JOIN l ON class_id = a""")
def title_similarity_join(spark, sf_dir):
    # titles have few words: at a similarity of a half there are links between different ones
    return K.title_links(content(spark, sf_dir), 0.5)


@query(f"""WITH {CONTENT}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.v, i.v), 9) AS similarity FROM v q JOIN v i ON q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS k FROM s QUALIFY k <= 10) SELECT query_id, item_id, round(similarity, 6) AS similarity, b.content_type FROM r JOIN content a ON query_id = a.content_id JOIN content b ON item_id = b.content_id WHERE a.content_type <> b.content_type""")
def cross_domain_recommend(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return rounded(K.cross_domain(R.knn(v, v.filter("vec_id % 50 = 0")).select("query_id", "item_id", "similarity"), content(spark, sf_dir)))


@query(f"WITH {PURCHASES}, {CONTENT}, a AS (SELECT user_id, content_type, avg(rating) AS m, count(*) AS n FROM purchases JOIN content ON item_id = content_id GROUP BY 1, 2) SELECT user_id, content_type, n, round(m * ln(n + 1), 6) AS strength FROM a")
def cross_domain_preferences(spark, sf_dir):
    return rounded(K.cross_domain_preferences(purchases(spark, sf_dir), content(spark, sf_dir)))


@query(f"{COSINE}, r AS (SELECT user_id, other, round(sim, 9) AS similarity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 9) DESC, other) AS INTEGER) AS rank FROM e QUALIFY rank <= 10) SELECT user_id, other, round(similarity, 6) AS similarity, rank FROM r")
def similar_users(spark, sf_dir):
    near = S.nearest(U.user_item_matrix(interactions(spark, sf_dir)), 10, digits=9)
    return rounded(near.select(F.col("id").alias("user_id"), "other", "similarity", "rank"))


@query(f"""{GROUPS}, s AS (SELECT group_id, user_id, list(DISTINCT item_id) AS x FROM own GROUP BY 1, 2), p AS (SELECT a.group_id, len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) AS j FROM s a JOIN s b ON a.group_id = b.group_id AND a.user_id < b.user_id)
SELECT group_id, count(*) AS pairs, round(avg(j), 6) AS similarity, CASE WHEN avg(j) >= 0.6 THEN 'average' WHEN avg(j) >= 0.3 THEN 'fairness' ELSE 'least_misery' END AS advice FROM p GROUP BY 1""")
def group_dynamics(spark, sf_dir):
    return rounded(K.group_dynamics(genre_lists(spark, sf_dir), members(spark, sf_dir)))


@query(f"""WITH {CONTENT}, w AS (SELECT avg(duration) AS md, stddev_pop(duration) AS sd, avg(popularity_score) AS mp, stddev_pop(popularity_score) AS sp FROM content),
k AS (SELECT content_id, list_distinct(list_concat(list_transform(genres, lambda g: 'genre:' || g), ['type:' || content_type, 'by:' || creator])) AS k, coalesce((duration - md) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0) AS d, coalesce((popularity_score - mp) / CASE WHEN sp > 0 THEN sp ELSE 1 END, 0) AS p, CAST(embedding AS DOUBLE[]) AS v
  FROM content CROSS JOIN w LEFT JOIN embeddings ON vec_id = content_id), n AS (SELECT *, sqrt(len(k) + d * d + p * p) AS n FROM k),
s AS (SELECT a.content_id AS query_id, b.content_id AS item_id, coalesce((len(list_intersect(a.k, b.k)) + a.d * b.d + a.p * b.p) / nullif(a.n * b.n, 0), 0) AS s, list_cosine_similarity(a.v, b.v) AS c FROM n a JOIN n b ON a.content_id % 50 = 0 AND a.content_id <> b.content_id)
SELECT query_id, item_id, round(s, 6) AS similarity, round(0.7 * c + 0.3 * s, 6) AS blended FROM s""")
def metadata_similarity(spark, sf_dir):
    items = content(spark, sf_dir)
    return rounded(K.metadata_pairs(items, items.filter("content_id % 50 = 0").select("content_id"), table(spark, sf_dir, "embeddings")))


@query(f"WITH {INTERACTIONS} SELECT item_id, arg_max(interaction_type, (ts, event_id)) AS interaction_type, max(ts) AS ts FROM interactions GROUP BY 1")
def latest_per_entity(spark, sf_dir):
    a = interactions(spark, sf_dir).groupBy("item_id").agg(F.max(F.struct("ts", "event_id", "interaction_type")).alias("x"))
    return a.select("item_id", "x.interaction_type", "x.ts")


@query()
def user_clusters(spark, sf_dir):
    return K.user_clusters(table(spark, sf_dir, "embeddings"))


@query()
def approx_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return K.approx_knn(v, v.filter("vec_id % 50 = 0"))


@query()
def explicit_mf_rmse(spark, sf_dir):
    return K.explicit_mf(interactions(spark, sf_dir))


#: Fixed meta genres of the queries.
META = {"hardware": ["bolt", "nut", "gear"], "device": ["widget", "gizmo"], "shape": ["ring", "plate"], "warm": ["red", "hot"]}
_METAS = ", ".join(f"CASE WHEN list_has_any(genres, {words}) THEN '{name}' END" for name, words in META.items())
_JACCARD = "(CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END)"


@query(f"""WITH {CONTENT}, i AS (SELECT content_id, content_type, list_filter([{_METAS}], lambda x: x IS NOT NULL) AS g, list_distinct(list_filter(string_split(lower(title), ' '), lambda x: x <> '')) AS t, CASE WHEN content_id % 4 <> 0 THEN 1950 + duration END AS y, CAST(embedding AS DOUBLE[]) AS v FROM content LEFT JOIN embeddings ON vec_id = content_id),
p AS (SELECT a.content_id AS a, b.content_id AS b, 0.3 * CASE WHEN len(a.g) > 0 AND len(b.g) > 0 THEN {_JACCARD.format("a.g", "b.g")} ELSE 0 END + 0.2 * {_JACCARD.format("a.t", "b.t")} AS k, greatest(0, 1 - abs(a.y - b.y) / 50) AS y, list_cosine_similarity(a.v, b.v) AS c
  FROM i a JOIN i b ON a.content_type = 'PROMO' AND b.content_type = 'ECONOMY' AND (list_has_any(a.g, b.g) OR list_has_any(a.t, b.t))),
s AS (SELECT a, b, round((k + coalesce(0.1 * y, 0) + coalesce(0.4 * c, 0)) / (0.5 + CASE WHEN y IS NULL THEN 0 ELSE 0.1 END + CASE WHEN c IS NULL THEN 0 ELSE 0.4 END), 9) AS similarity FROM p)
SELECT a, b, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a ORDER BY s.similarity DESC, b) AS INTEGER) AS rank FROM s WHERE s.similarity > 0.4 QUALIFY rank <= 3""")
def cross_domain_similarity(spark, sf_dir):
    own = content(spark, sf_dir).withColumn("year", F.when(F.col("content_id") % 4 != 0, 1950 + F.col("duration")))
    own = own.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("content_id"), "embedding"), "content_id", "left")
    return rounded(K.domain_similarity(own.filter("content_type = 'PROMO'"), own.filter("content_type = 'ECONOMY'"), META))
