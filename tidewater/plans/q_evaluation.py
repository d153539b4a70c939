"""Registered queries of metrics, fairness, experiments and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.views import INTERACTIONS, content, interactions, table, users
from .q_recommend import GENRE_TOP, genre_lists
from .q_users import rounded
from .registry import query

RELEVANCE = "rel AS (SELECT user_id, item_id, max(value) AS relevance FROM (SELECT user_id, (item_id * 7 + user_id) % 100 AS item_id, value FROM interactions) GROUP BY 1, 2)"


def relevance(spark, sf_dir):
    """A fixed permutation of the items, so that lists of unseen items have relevant ones among them."""
    own = interactions(spark, sf_dir).select("user_id", ((F.col("item_id") * 7 + F.col("user_id")) % 100).alias("item_id"), "value")
    return own.groupBy("user_id", "item_id").agg(F.max("value").alias("relevance"))


@query(f"""{GENRE_TOP}, {RELEVANCE}, d AS (SELECT g.user_id, sum(coalesce(relevance, 0) / log2(rank + 1)) AS dcg FROM g LEFT JOIN rel USING (user_id, item_id) GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, item_id) AS i FROM rel),
b AS (SELECT user_id, sum(relevance / log2(i + 1)) AS ideal FROM r WHERE i <= 10 GROUP BY 1) SELECT user_id, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM d LEFT JOIN b USING (user_id)""")
def ndcg_at_k(spark, sf_dir):
    return rounded(E.ndcg(genre_lists(spark, sf_dir), relevance(spark, sf_dir)))


@query(f"""{GENRE_TOP}, {RELEVANCE}, q AS (SELECT user_id, item_id FROM rel WHERE relevance >= 40), t AS (SELECT user_id, count(*) AS relevant FROM q GROUP BY 1), a AS (SELECT g.user_id, count(*) AS n, count(q.item_id) AS hits, min(rank) FILTER (q.item_id IS NOT NULL) AS first FROM g LEFT JOIN q ON g.user_id = q.user_id AND g.item_id = q.item_id GROUP BY 1),
p AS (SELECT user_id, hits / n AS p, coalesce(hits / relevant, 0) AS r, first, hits FROM a LEFT JOIN t USING (user_id)) SELECT user_id, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, hits > 0 AS hit FROM p""")
def precision_recall_f1(spark, sf_dir):
    return rounded(E.precision_recall(genre_lists(spark, sf_dir), relevance(spark, sf_dir), least=40))


@query(f"WITH {INTERACTIONS}, s AS (SELECT rating AS actual, avg(rating) OVER (PARTITION BY item_id) AS predicted FROM interactions) SELECT round(avg(abs(predicted - actual)), 6) AS mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse, count(*) AS n FROM s")
def mae_rmse(spark, sf_dir):
    own = interactions(spark, sf_dir)
    means = own.groupBy("item_id").agg(F.avg("rating").alias("predicted"))
    return rounded(E.prediction_error(own.join(means, "item_id").select("predicted", F.col("rating").alias("actual"))))


@query(f"{GENRE_TOP} SELECT count(DISTINCT item_id) AS recommended, (SELECT count(*) FROM content) AS items, round(count(DISTINCT item_id) / (SELECT count(*) FROM content), 6) AS coverage FROM g")
def catalog_coverage(spark, sf_dir):
    return rounded(E.catalog_coverage(genre_lists(spark, sf_dir), content(spark, sf_dir)))


@query(f"""{GENRE_TOP}, o AS (SELECT user_id, rank, genres FROM g JOIN content ON item_id = content_id), p AS (SELECT x.user_id, len(list_distinct(list_intersect(x.genres, y.genres))) / len(list_distinct(list_concat(x.genres, y.genres))) AS j FROM o x JOIN o y ON x.user_id = y.user_id AND x.rank < y.rank)
SELECT user_id, round(avg(1 - j), 6) AS diversity FROM p GROUP BY 1""")
def intra_list_diversity(spark, sf_dir):
    return rounded(E.intra_list_diversity(genre_lists(spark, sf_dir), content(spark, sf_dir)))


@query(f"""{GENRE_TOP}, n2 AS (SELECT item_id, count(DISTINCT user_id) AS n FROM interactions GROUP BY 1), p AS (SELECT item_id, n / (SELECT count(DISTINCT user_id) FROM interactions) AS p, row_number() OVER (ORDER BY n DESC, item_id) / count(*) OVER () > 0.2 AS tail FROM n2)
SELECT user_id, round(avg(1 - p), 6) AS novelty, round(avg(-log2(p)), 6) AS information, round(avg(CAST(tail AS DOUBLE)), 6) AS long_tail FROM g JOIN p USING (item_id) GROUP BY 1""")
def novelty(spark, sf_dir):
    return rounded(E.novelty(genre_lists(spark, sf_dir), interactions(spark, sf_dir)))


@query(f"""{GENRE_TOP}, kn AS (SELECT user_id, list_distinct(flatten(list(genres))) AS known FROM interactions JOIN content ON item_id = content_id GROUP BY 1)
SELECT user_id, round(avg(len(list_filter(list_distinct(genres), lambda x: NOT list_contains(known, x))) / len(list_distinct(genres))), 6) AS serendipity FROM g JOIN content ON item_id = content_id JOIN kn USING (user_id) GROUP BY 1""")
def serendipity(spark, sf_dir):
    return rounded(E.serendipity(genre_lists(spark, sf_dir), interactions(spark, sf_dir), content(spark, sf_dir)))


@query(f"""{GENRE_TOP}, l AS (SELECT user_id, list(DISTINCT item_id) AS x FROM g GROUP BY 1), p AS (SELECT len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) AS j FROM l a JOIN l b ON a.user_id < b.user_id)
SELECT (SELECT count(*) FROM l) AS users, round(avg(1 - j), 6) AS personalization FROM p""")
def personalization(spark, sf_dir):
    return rounded(E.personalization(genre_lists(spark, sf_dir)))


@query(f"""{GENRE_TOP}, c AS (SELECT content_type, count(*) AS n FROM g JOIN content ON item_id = content_id GROUP BY 1), w AS (SELECT n, n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n, content_type) AS i FROM c)
SELECT round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6)::DOUBLE AS gini, count(*) AS n_values FROM w""")
def attribute_fairness(spark, sf_dir):
    lists = genre_lists(spark, sf_dir).join(content(spark, sf_dir).select(F.col("content_id").alias("item_id"), "content_type"), "item_id")
    return rounded(E.attribute_fairness(lists, "content_type"))


@query(f"""{GENRE_TOP}, s AS (SELECT c_mktsegment AS group_value, score FROM g JOIN customer ON user_id = c_custkey), a AS (SELECT group_value, count(*) AS n, avg(CAST(score >= 0.4 AS DOUBLE)) AS rate FROM s GROUP BY 1), r AS (SELECT *, coalesce(rate / nullif(max(rate) OVER (), 0), 1) AS parity FROM a)
SELECT group_value, n, round(rate, 6) AS rate, round(parity, 6) AS parity, CASE WHEN parity < 0.6 THEN 'severe' WHEN parity < 0.8 THEN 'violation' ELSE 'ok' END AS severity FROM r""")
def demographic_parity(spark, sf_dir):
    scores = genre_lists(spark, sf_dir).join(users(spark, sf_dir).select("user_id", "user_group"), "user_id")
    return rounded(E.demographic_parity(scores, "user_group", 0.4))


@query(f"""{GENRE_TOP}, n2 AS (SELECT c_mktsegment AS grp, content_type AS value, count(*) AS n FROM g JOIN customer ON user_id = c_custkey JOIN content ON item_id = content_id GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY grp) AS share FROM n2),
a AS (SELECT value, CASE WHEN count(*) = (SELECT count(DISTINCT grp) FROM n2) THEN min(share) ELSE 0 END AS low, max(share) AS high FROM s GROUP BY 1) SELECT value, round(low, 6)::DOUBLE AS lowest, round(high, 6) AS highest, round(high - low, 6)::DOUBLE AS gap FROM a""")
def representation_gap(spark, sf_dir):
    lists = genre_lists(spark, sf_dir).join(users(spark, sf_dir).select("user_id", "user_group"), "user_id").join(content(spark, sf_dir).select(F.col("content_id").alias("item_id"), "content_type"), "item_id")
    return rounded(E.representation_gap(lists, "user_group", "content_type"))


#: Outcomes of labelled documents with a score from their length, by language.
OUTCOMES = "o AS (SELECT lang, least(1.0, n_chars / 8000.0)::DOUBLE AS score, quality AS actual, CAST(n_chars > 1500 AS INTEGER) AS predicted FROM documents JOIN labels USING (doc_id))"


def outcomes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("lang", F.least(F.lit(1.0), F.col("n_chars") / 8000).alias("score"), F.col("quality").alias("actual"), (F.col("n_chars") > 1500).cast("int").alias("predicted"))


@query(f"WITH {OUTCOMES} SELECT lang AS group_value, round(avg(CAST(predicted AS DOUBLE)) FILTER (actual = 1), 6) AS tpr, round(avg(CAST(predicted AS DOUBLE)) FILTER (actual = 0), 6) AS fpr, count(*) AS n FROM o GROUP BY 1")
def equalized_odds(spark, sf_dir):
    return rounded(E.equalized_odds(outcomes(spark, sf_dir), "lang"))


@query(f"WITH {OUTCOMES}, b AS (SELECT lang, greatest(1, CAST(ceil(score * 10) AS INTEGER)) AS bin, count(*) AS n, avg(score) AS s, avg(CAST(actual AS DOUBLE)) AS a FROM o GROUP BY 1, 2) SELECT lang, bin, n, round(s, 6) AS score, round(a, 6) AS outcome, round(abs(s - a), 6) AS gap FROM b")
def group_calibration(spark, sf_dir):
    return rounded(E.calibration(outcomes(spark, sf_dir), group=["lang"]))


@query(f"WITH {OUTCOMES}, b AS (SELECT greatest(1, CAST(ceil(score * 10) AS INTEGER)) AS bin, count(*) AS n, abs(avg(score) - avg(CAST(actual AS DOUBLE))) AS gap FROM o GROUP BY 1) SELECT round(sum(gap * n) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n, sum(gap * n) / sum(n) < 0.1 AS accurate FROM b")
def calibration_ece(spark, sf_dir):
    return rounded(E.expected_calibration_error(outcomes(spark, sf_dir)))


@query("""WITH h AS (SELECT c_custkey AS user_id, md5(c_custkey || ':exp1') AS d FROM customer), b AS (SELECT user_id, ((CAST('0x' || substring(d, 1, 16) AS UBIGINT) % 10000) * 1616 + CAST('0x' || substring(d, 17, 16) AS UBIGINT) % 10000) % 10000 / 10000 AS bucket FROM h)
SELECT user_id, round(CAST(bucket AS DOUBLE), 6) AS bucket, CASE WHEN bucket < 0.5 THEN 'control' WHEN bucket < 0.9 THEN 'treatment' END AS variant FROM b""")
def ab_assignment(spark, sf_dir):
    return rounded(E.ab_assignment(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "exp1", {"control": 0.5, "treatment": 0.4}))


#: Events of users of even and odd id as two variants.
VARIANTS = "v AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, value, event_type = 'purchase' AS converted FROM events)"


def two_sided(z: str) -> str:
    """SQL of the share of the standard normal at least as far from 0 as z."""
    x = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{x} * {x}))"


def variants(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("variant"), "value", (F.col("event_type") == "purchase").alias("converted"))


@query(f"""WITH {VARIANTS}, s AS (SELECT count(*) FILTER (variant = 'a') AS na, count(*) FILTER (variant = 'b') AS nb, avg(value) FILTER (variant = 'a') AS ma, avg(value) FILTER (variant = 'b') AS mb, var_samp(value) FILTER (variant = 'a') AS va, var_samp(value) FILTER (variant = 'b') AS vb, var_pop(value) FILTER (variant = 'a') AS pa, var_pop(value) FILTER (variant = 'b') AS pb FROM v),
t AS (SELECT *, (mb - ma) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS f, least(na, nb) - 1 AS d FROM s),
z AS (SELECT *, (8 * f + 1) / (8 * f + 3) * sqrt(f * ln(1 + t * t / f)) AS z, sqrt(d * (exp(pow(1.959963984540054 * (8 * d + 3) / (8 * d + 1), 2) / d) - 1)) * sqrt(pa / na + pb / nb) AS h FROM t)
SELECT na AS n_a, nb AS n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(mb - ma, 6) AS difference, round(t, 6) AS t, round(f, 4) AS dof, round((mb - ma) / sqrt((pa + pb) / 2), 6) AS effect, round({two_sided("z")}, 6) AS p, round(mb - ma - h, 6) AS low, round(mb - ma + h, 6) AS high FROM z""")
def welch_t_test(spark, sf_dir):
    return rounded(E.welch(variants(spark, sf_dir), "variant", "value", "a", "b").withColumn("dof", F.round("dof", 4)))


@query(f"""WITH {VARIANTS}, r AS (SELECT variant, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rank FROM v), t AS (SELECT sum(pow(c, 3) - c) AS ties, sum(c) AS n FROM (SELECT count(*) AS c FROM v GROUP BY value)),
s AS (SELECT count(*) FILTER (variant = 'a') AS na, count(*) FILTER (variant = 'b') AS nb, sum(rank) FILTER (variant = 'a') AS ra FROM r), u AS (SELECT na, nb, ra - na * (na + 1) / 2 AS u, sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sd FROM s, t) SELECT na AS n_a, nb AS n_b, round(u, 6) AS u, round((u - na * nb / 2) / sd, 6) AS z, round({two_sided('(greatest(0, abs(u - na * nb / 2) - 0.5) / sd)')}, 6)::DOUBLE AS p FROM u""")
def mann_whitney(spark, sf_dir):
    return rounded(E.mann_whitney(variants(spark, sf_dir), "variant", "value", "a", "b").withColumns({"n_a": F.col("n_a").cast("long"), "n_b": F.col("n_b").cast("long")}))


@query(f"""WITH {VARIANTS}, s AS (SELECT CAST(count(*) FILTER (variant = 'a' AND converted) AS DOUBLE) AS a, CAST(count(*) FILTER (variant = 'a' AND NOT converted) AS DOUBLE) AS b, CAST(count(*) FILTER (variant = 'b' AND converted) AS DOUBLE) AS c, CAST(count(*) FILTER (variant = 'b' AND NOT converted) AS DOUBLE) AS d FROM v), x AS (SELECT *, (a + b + c + d) * pow(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi FROM s)
SELECT round(a / (a + b), 6) AS rate_a, round(c / (c + d), 6) AS rate_b, round((c / (c + d) - a / (a + b)) / (a / (a + b)), 6) AS lift, round(chi, 6) AS chi_square, round({two_sided('sqrt(chi)')}, 6) AS p FROM x""")
def chi_square_2x2(spark, sf_dir):
    return rounded(E.chi_square(variants(spark, sf_dir), "variant", "converted", "a", "b"))


@query("""WITH a AS (SELECT count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS b, sum(value) FILTER (event_type = 'purchase') AS r, count(DISTINCT user_id) AS u FROM events)
SELECT round(c / s, 6) AS ctr, round(b / c, 6) AS conversion, round(r / u, 6) AS revenue_per_user, u AS users FROM a""")
def business_kpis(spark, sf_dir):
    return rounded(E.business_kpis(table(spark, sf_dir, "events")))


@query("""WITH a AS (SELECT user_id, count(*) FILTER (ts < TIMESTAMP '2024-01-15') > 0 AS b, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') > 0 AS f FROM events GROUP BY 1)
SELECT count(*) FILTER (b) AS first, count(*) FILTER (f) AS second, count(*) FILTER (b AND f) AS retained, round(count(*) FILTER (b AND f) / count(*) FILTER (b), 6) AS retention FROM a""")
def retention(spark, sf_dir):
    return rounded(E.retention(table(spark, sf_dir, "events"), "2024-01-15"))


@query("""WITH a AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, count(*) AS n, avg(value) AS mean, max(value) AS highest, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1)
SELECT start_ts, n, round(mean, 6) AS mean, round(highest, 6) AS highest, round(p95, 6) AS p95, round(p99, 6) AS p99, CASE WHEN p95 < 50 THEN 'A' WHEN p95 < 100 THEN 'B' WHEN p95 < 200 THEN 'C' WHEN p95 < 500 THEN 'D' ELSE 'F' END AS grade FROM a""")
def metric_rollup(spark, sf_dir):
    return rounded(E.metric_rollup(table(spark, sf_dir, "events")))


#: Hourly means of the events' values by type, as metric series.
SERIES = "s AS (SELECT event_type AS metric, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"


def series(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.window("ts", "1 hour")["start"].alias("ts")).agg(F.avg("value").alias("value"))


@query(f"""WITH {SERIES}, w AS (SELECT *, avg(value) OVER b AS m, stddev_samp(value) OVER b AS d FROM s WINDOW b AS (PARTITION BY metric ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), z AS (SELECT *, CASE WHEN d <> 0 THEN (value - m) / d END AS z FROM w)
SELECT metric, ts, round(value + 1e-9, 6) AS value, round(m + 1e-9, 6) AS mean, round(d + 1e-9, 6) AS deviation, round(z + 1e-9, 6) AS z, CASE WHEN z > 3 THEN 'high' WHEN z < -3 THEN 'low' END AS reason FROM z""")
def metric_anomaly(spark, sf_dir):
    return rounded(E.metric_anomaly(series(spark, sf_dir)), 1e-9)


@query(f"""WITH {SERIES}, i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC) AS i FROM s), a AS (SELECT metric, regr_slope(value, -i) AS slope, arg_max(value, i) AS first, arg_min(value, i) AS current FROM i WHERE i <= 60 GROUP BY 1)
SELECT metric, round(slope, 6) AS slope, round(first, 6) AS first, round(current, 6) AS current, round((current - first) / nullif(abs(first), 0), 6) AS change FROM a""")
def metric_trends(spark, sf_dir):
    return rounded(E.metric_trends(series(spark, sf_dir)))


@query()
def alert_rules(spark, sf_dir):
    own = series(spark, sf_dir)
    # a rule for each metric: above twice its mean over all hours
    rules = own.groupBy("metric").agg((2 * F.avg("value")).alias("threshold")).select(F.concat(F.lit("high_"), F.col("metric")).alias("rule"), "metric", F.lit(">").alias("op"), "threshold", F.lit("warning").alias("severity"))
    return rounded(E.alert_rules(own, rules, 180))
