"""Registered queries of neighbours, forests, clusters, networks, robust trends and weights chosen by a grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..functions.tables import kept
from ..operators import donors as D
from ..operators import isolation as I
from ..operators import models as M
from ..operators import networks as N
from ..sources.views import CONTENT, INTERACTIONS, content, interactions, table
from .registry import query

#: Orders with totals over their lines, in whole numbers; every seventh lacks its price and every fifth its delay.
LINED = """lined AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(any_value(o_totalprice) AS DOUBLE) END AS price, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(CAST(sum(l_discount) AS DOUBLE) * 100) AS discount,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS DOUBLE) END AS delay FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"""


def lined(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    own = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("quantity"), F.round(F.sum("l_discount").cast("double") * 100).alias("discount"), F.max("l_shipdate").alias("shipped")).join(orders, "o_orderkey")
    price, delay = F.col("o_totalprice").cast("double"), F.datediff("shipped", "o_orderdate").cast("double")
    return own.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, price).alias("price"), "quantity", "discount", F.when(F.col("o_orderkey") % 5 != 0, delay).alias("delay"))


@query(f"""WITH {LINED}, p AS (SELECT a.o_orderkey AS id, b.o_orderkey AS donor, b.price, coalesce((a.quantity - b.quantity) * (a.quantity - b.quantity), 0) + coalesce((a.discount - b.discount) * (a.discount - b.discount), 0) + coalesce((a.delay - b.delay) * (a.delay - b.delay), 0) AS d,
  2 + CASE WHEN a.delay IS NOT NULL AND b.delay IS NOT NULL THEN 1 ELSE 0 END AS c FROM lined a JOIN lined b ON a.price IS NULL AND b.price IS NOT NULL),
k AS (SELECT id, price FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt(d * 3 / c), donor) <= 5), m AS (SELECT id, avg(price) AS price, count(*) AS n FROM k GROUP BY 1)
SELECT o_orderkey, round(coalesce(lined.price, m.price), 6) AS price, m.n AS donors FROM lined LEFT JOIN m ON lined.price IS NULL AND o_orderkey = id""")
def impute_knn(spark, sf_dir):
    return D.impute_knn(lined(spark, sf_dir), "o_orderkey", "price", ["quantity", "discount", "delay"]).withColumn("price", r6("price"))


@query()
def outlier_isolation_forest(spark, sf_dir):
    return I.isolation_forest(table(spark, sf_dir, "events"), "event_id", "value").withColumn("score", r6("score"))


#: The types whose values make a state.
TYPES = ["purchase", "click", "view"]
_NEAR = "".join(
    f", last_value(CASE WHEN interaction_type = '{t}' THEN {{'ts': ts, 'v': rating / 5}} END IGNORE NULLS) OVER b AS a{i}, first_value(CASE WHEN interaction_type = '{t}' THEN {{'ts': ts, 'v': rating / 5}} END IGNORE NULLS) OVER f AS z{i}"
    for i, t in enumerate(TYPES)
)
_VALUES = ", ".join(f"CASE WHEN a{i} IS NOT NULL AND (z{i} IS NULL OR ts - a{i}.ts <= z{i}.ts - ts) THEN a{i}.v ELSE z{i}.v END AS x{i}" for i in range(3))


@query(f"""WITH RECURSIVE {INTERACTIONS}, w AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place{_NEAR} FROM interactions
  WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT user_id, event_id, ts, {_VALUES} FROM w WHERE place <= 100),
s AS (SELECT * FROM v WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY user_id) >= 5),
n AS MATERIALIZED (SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM s a JOIN s b USING (user_id) WHERE (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2 <= 0.3 * 0.3),
c AS MATERIALIZED (SELECT a AS p FROM n GROUP BY 1 HAVING count(*) >= 3),
e AS MATERIALIZED (SELECT n.a, n.b FROM n JOIN c x ON n.a = x.p JOIN c y ON n.b = y.p),
r(p, l) USING KEY (p) AS (SELECT p, p FROM c UNION SELECT e.b, min(r.l) FROM r JOIN e ON e.a = r.p JOIN recurring.r AS o ON o.p = e.b GROUP BY e.b, o.l HAVING min(r.l) < o.l),
g AS (SELECT n.user_id, n.a AS event_id, min(r.l) AS first FROM n JOIN r ON r.p = n.b GROUP BY 1, 2),
k AS (SELECT g.user_id, dense_rank() OVER (PARTITION BY g.user_id ORDER BY first) - 1 AS cluster, s.ts, x0, x1, x2 FROM g JOIN s USING (event_id)), t AS (SELECT max(ts) AS t FROM interactions)
SELECT user_id, CAST(cluster AS INTEGER) AS cluster, count(*) AS size, [round(avg(x0), 6), round(avg(x1), 6), round(avg(x2), 6)] AS centroid, round(epoch_us(max(ts) - min(ts)) / 3.6e9, 6) AS span_hours, round(epoch_us(any_value(t) - max(ts)) / 3.6e9, 6) AS recency_hours, round(stddev_pop(x0), 6) AS stability
FROM k, t GROUP BY 1, 2 HAVING count(*) >= 2""")
def preference_dbscan(spark, sf_dir):
    own = interactions(spark, sf_dir)
    states = kept(N.preference_states(own, TYPES), "states")
    latest = own.agg(F.max("ts").alias("as_of"))  # one row
    out = N.cluster_profiles(N.density_clusters(states, ["user_id"]), states.crossJoin(F.broadcast(latest)), ["user_id"])
    return out.select("user_id", "cluster", "size", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"), *[r6(c).alias(c) for c in ("span_hours", "recency_hours", "stability")])


@query()
def similarity_network(spark, sf_dir):
    return N.vector_communities(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def robust_trend(spark, sf_dir):
    own = interactions(spark, sf_dir)
    series = own.select("user_id", F.col("interaction_type").alias("feature"), "ts", (F.col("rating") / 5).alias("value"))
    out = M.robust_trend(series, ["user_id", "feature"], F.lit("2024-01-31").cast("timestamp"))
    return out.select("user_id", "feature", "n", *[F.round(c, 9).alias(c) for c in ("slope", "intercept", "r2", "p")], "trend", F.round("strength", 9).alias("strength"), F.round("confidence", 9).alias("confidence"), "forecast")


@query()
def seasonal_forecast(spark, sf_dir):
    """Seven hours ahead for each type of event, by the hourly means of the whole table."""
    own = interactions(spark, sf_dir)
    hourly = own.groupBy(F.col("interaction_type").alias("feature"), F.date_trunc("hour", "ts").alias("ts")).agg((F.avg("rating") / 5).alias("value"))
    return M.seasonal_forecast(hourly, ["feature"], F.lit("2024-01-31").cast("timestamp"))


FEATURES = ["hour", "weekday", "value", "item_events", "user_events"]


def rated(spark, sf_dir):
    own = interactions(spark, sf_dir)
    counted = own
    for k in ("item", "user"):
        n = own.groupBy(f"{k}_id").agg(F.count(F.lit(1)).alias(f"{k}_events"))
        counted = counted.join(n, f"{k}_id")
    return counted.select("rating", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), "value", "item_events", "user_events")


_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, rating AS y FROM rated" for f in FEATURES)


@query(f"""WITH {INTERACTIONS}, rated AS (SELECT rating, hour(ts) AS hour, isodow(ts) - 1 AS weekday, coalesce(value, 0) AS value, count(*) OVER (PARTITION BY item_id) AS item_events, count(*) OVER (PARTITION BY user_id) AS user_events FROM interactions WHERE item_id IS NOT NULL AND user_id IS NOT NULL),
l AS (SELECT * FROM ({_LONG}) WHERE y IS NOT NULL),
b AS (SELECT feature, x, y, floor((rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 10 / count(*) OVER (PARTITION BY feature)) AS bx, floor((rank() OVER (PARTITION BY feature ORDER BY y) - 1) * 10 / count(*) OVER (PARTITION BY feature)) AS bb FROM l),
c AS (SELECT feature, bx, bb, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT feature, n / sum(n) OVER f AS p, sum(n) OVER (PARTITION BY feature, bx) / sum(n) OVER f AS px, sum(n) OVER (PARTITION BY feature, bb) / sum(n) OVER f AS py FROM c WINDOW f AS (PARTITION BY feature)),
m AS (SELECT feature, round(sum(p * ln(p / px / py)), 9) AS mutual_information FROM p GROUP BY 1), k AS (SELECT feature, abs(corr(x, y)) AS correlation FROM l GROUP BY 1)
SELECT feature, round(correlation, 6) AS correlation, round(mutual_information, 6) AS mutual_information, CAST(row_number() OVER (ORDER BY m.mutual_information DESC, feature) AS INTEGER) AS rank FROM m JOIN k USING (feature)""")
def feature_importance_model(spark, sf_dir):
    out = M.feature_importance(rated(spark, sf_dir), FEATURES, "rating")
    return out.select("feature", r6("correlation").alias("correlation"), r6("mutual_information").alias("mutual_information"), "rank")


@query()
def feature_importance_forest(spark, sf_dir):
    return M.forest_importance(rated(spark, sf_dir), FEATURES, "rating")


#: Events before and from this time.
CUT = "2024-01-24"


@query(f"""WITH {INTERACTIONS}, {CONTENT}, tr AS (SELECT * FROM interactions WHERE ts < TIMESTAMP '{CUT}'), rel AS (SELECT DISTINCT user_id, item_id FROM interactions WHERE ts >= TIMESTAMP '{CUT}'),
i AS (SELECT item_id, count(*) AS c, avg(rating) / 5 AS knowledge FROM tr GROUP BY 1), pop AS (SELECT item_id, c / max(c) OVER () AS collaborative, knowledge FROM i QUALIFY row_number() OVER (ORDER BY c DESC, item_id) <= 50),
g AS (SELECT content_id AS item_id, unnest(list_distinct(genres)) AS genre FROM content), t AS (SELECT user_id, genre, count(*) AS n FROM tr JOIN g USING (item_id) GROUP BY 1, 2), ts AS (SELECT user_id, genre, n / sum(n) OVER (PARTITION BY user_id) AS share FROM t),
u AS (SELECT DISTINCT user_id FROM tr), cs AS (SELECT user_id, item_id, sum(share) AS content FROM pop JOIN g USING (item_id) JOIN ts USING (genre) GROUP BY 1, 2),
c AS (SELECT user_id, item_id, collaborative, coalesce(content, 0) AS content, knowledge FROM u CROSS JOIN pop LEFT JOIN cs USING (user_id, item_id)),
w AS (SELECT i AS combination, ws FROM (SELECT unnest({[list(c) for c in M.weight_combinations()]}) AS ws, generate_subscripts({[list(c) for c in M.weight_combinations()]}, 1) - 1 AS i)),
d AS (SELECT combination, user_id, item_id, round(ws[1] * collaborative + ws[2] * content + ws[3] * knowledge, 9) AS score FROM c, w WHERE user_id IN (SELECT user_id FROM rel)),
r AS (SELECT combination, user_id, item_id, row_number() OVER (PARTITION BY combination, user_id ORDER BY score DESC, item_id) AS k FROM d QUALIFY k <= 10),
a AS (SELECT user_id, sum(1 / log2(k + 1)) AS ideal FROM (SELECT user_id, unnest(range(1, least(count(*), 10) + 1)) AS k FROM rel GROUP BY user_id) GROUP BY 1),
s AS (SELECT combination, user_id, sum(CASE WHEN rel.item_id IS NULL THEN 0 ELSE 1 / log2(k + 1) END) AS dcg FROM r LEFT JOIN rel USING (user_id, item_id) GROUP BY 1, 2),
o AS (SELECT combination, round(sum(dcg / ideal) / (SELECT count(*) FROM a), 9) AS ndcg FROM s JOIN a USING (user_id) GROUP BY 1)
SELECT CAST(combination AS INTEGER) AS combination, ws AS weights, round(ndcg, 6) AS ndcg, (SELECT count(*) FROM a) AS users, row_number() OVER (ORDER BY o.ndcg DESC, combination) = 1 AS best FROM o JOIN w USING (combination)""")
def weight_grid_search(spark, sf_dir):
    """Popularity, taste in genres and mean rating over the 50 most popular items, judged on the events after the cut."""
    own, items = interactions(spark, sf_dir), content(spark, sf_dir)
    new = F.col("ts") >= F.lit(CUT).cast("timestamp")
    train = own.filter(~new)
    relevance = own.filter(new).select("user_id", "item_id").distinct().withColumn("relevance", F.lit(1.0))
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"), (F.avg("rating") / 5).alias("knowledge"))
    # 50 rows
    popular = counts.orderBy(F.desc("c"), "item_id").limit(50)
    popular = kept(popular.crossJoin(F.broadcast(popular.agg(F.max("c").alias("most")))).select("item_id", (F.col("c") / F.col("most")).alias("collaborative"), "knowledge"), "popular")
    genres = items.select(F.col("content_id").alias("item_id"), F.explode(F.array_distinct("genres")).alias("genre"))
    taste = train.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n")).join(genres.hint("merge"), "item_id").groupBy("user_id", "genre").agg(F.sum("n").alias("n"))
    taste = taste.join(taste.groupBy("user_id").agg(F.sum("n").alias("all")).hint("merge"), "user_id").select("user_id", "genre", (F.col("n") / F.col("all")).alias("share"))
    shares = taste.join(F.broadcast(genres.join(F.broadcast(popular.select("item_id")), "item_id")), "genre").groupBy("user_id", "item_id").agg(F.sum("share").alias("content"))
    candidates = train.select("user_id").distinct().crossJoin(F.broadcast(popular)).join(shares.hint("merge"), ["user_id", "item_id"], "left")
    out = M.weight_grid(candidates, relevance, ["collaborative", "content", "knowledge"], M.weight_combinations())
    return out.withColumn("ndcg", r6("ndcg"))
