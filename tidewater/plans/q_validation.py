"""Registered queries of the table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import validation as V
from ..sources.views import CONTENT, INTERACTIONS, content, interactions, table
from .registry import query


@query("""SELECT * FROM (VALUES ('event_id'), ('user_id'), ('props'), ('absent')) f(field) CROSS JOIN LATERAL (
  SELECT CASE f.field WHEN 'event_id' THEN count(*) FILTER (event_id IS NULL) WHEN 'user_id' THEN count(*) FILTER (user_id IS NULL)
    WHEN 'props' THEN count(*) FILTER (props IS NULL) ELSE count(*) END AS nulls FROM events) a
  CROSS JOIN LATERAL (SELECT round(a.nulls / (SELECT count(*) FROM events), 6) AS share,
    CASE WHEN f.field = 'absent' THEN 'CRITICAL' WHEN a.nulls / (SELECT count(*) FROM events) > 0.1 THEN 'CRITICAL' WHEN a.nulls > 0 THEN 'ERROR' ELSE 'OK' END AS level) b""")
def required_field_check(spark, sf_dir):
    return V.required_field_check(table(spark, sf_dir, "events"), ["event_id", "user_id", "props", "absent"]).withColumn("share", r6("share"))


@query(f"""WITH {INTERACTIONS}, k AS (SELECT user_id, item_id, count(*) AS n FROM interactions GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM k""")
def duplicate_key_check(spark, sf_dir):
    return V.duplicate_key_check(interactions(spark, sf_dir), ["user_id", "item_id"])


@query(f"""WITH {INTERACTIONS} SELECT 'rating' AS field, count(*) FILTER (rating < 2) AS below, count(*) FILTER (rating > 4) AS above, min(rating) AS lowest, max(rating) AS highest FROM interactions
UNION ALL SELECT 'value', count(*) FILTER (value < 0), count(*) FILTER (value > 100), min(value), max(value) FROM interactions""")
def range_check(spark, sf_dir):
    return V.range_check(interactions(spark, sf_dir), {"rating": (2, 4), "value": (0, 100)})


@query("""WITH bad AS (SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_bad, count(*) AS n_values, (SELECT coalesce(string_agg(event_type, ',' ORDER BY event_type), '') FROM (SELECT event_type FROM bad ORDER BY 1 LIMIT 5)) AS offenders FROM bad""")
def domain_check(spark, sf_dir):
    return V.domain_check(table(spark, sf_dir, "events"), "event_type", ["click", "view"])


@query("""SELECT count(*) FILTER (event_type IS NOT NULL AND try_cast(ts AS TIMESTAMP) IS NULL) AS unparseable, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS future,
  count(*) FILTER (ts < TIMESTAMP '2024-01-05') AS too_early, count(*) FILTER (ts IS NULL) AS missing FROM events""")
def date_check(spark, sf_dir):
    return V.date_check(table(spark, sf_dir, "events"), "ts", "2024-01-20", "2024-01-05")


@query("""SELECT count(*) FILTER (props IS NOT NULL) - count(*) FILTER (json_type(props) = 'ARRAY') AS invalid, count(*) FILTER (json_type(props) = 'ARRAY') AS valid FROM events""")
def json_array_check(spark, sf_dir):
    return V.json_array_check(table(spark, sf_dir, "events"), "props")


@query("""WITH b AS (SELECT user_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events),
u AS (SELECT user_id, count(*) FILTER (back) AS n FROM b GROUP BY 1)
SELECT count(*) FILTER (n > 0) AS users_out_of_order, CAST(coalesce(sum(n), 0) AS BIGINT) AS events_out_of_order, count(*) AS users FROM u""")
def temporal_consistency(spark, sf_dir):
    return V.temporal_consistency(table(spark, sf_dir, "events"))


@query(f"""WITH {INTERACTIONS}, r AS (SELECT count(*) AS n, count(*) FILTER (user_id IS NULL) + count(*) FILTER (item_id IS NULL) + count(*) FILTER (rating IS NULL) AS nulls,
  count(*) FILTER (user_id IS NOT NULL AND item_id IS NOT NULL AND rating IS NOT NULL) AS whole, 3 * count(*) FILTER (rating > 5) + 1 * count(*) FILTER (rating = 1) AS issues FROM interactions),
d AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM interactions GROUP BY user_id, item_id)),
p AS (SELECT n, 1 - nulls / (n * 3) AS completeness, greatest(0, 1 - issues / (n * 0.1)) AS validity, (whole - dup) / n AS consistency FROM r, d)
SELECT n, round(completeness, 6) AS completeness, round(CAST(validity AS DOUBLE), 6) AS validity, round(consistency, 6) AS consistency, round(CAST(0.3 * completeness + 0.4 * validity + 0.3 * consistency AS DOUBLE), 6) AS score FROM p""")
def table_quality_score(spark, sf_dir):
    df = interactions(spark, sf_dir).select("user_id", "item_id", "rating")
    out = V.table_quality_score(df, {"critical:rating": F.col("rating") > 5, "warning:rating": F.col("rating") == 1}, ["user_id", "item_id"])
    return out.select("n", *[r6(c).alias(c) for c in ("completeness", "validity", "consistency", "score")])


@query("""WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)), a AS (SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS q, count(*) FILTER (toxic IS NULL) AS t, count(*) FILTER (doc_id IS NULL) AS d FROM j),
u AS (SELECT 'quality' AS field, q AS nulls, 100.0 * q / n AS pct FROM a UNION ALL SELECT 'toxic', t, 100.0 * t / n FROM a UNION ALL SELECT 'doc_id', d, 100.0 * d / n FROM a)
SELECT field, nulls, round(CAST(pct AS DOUBLE), 6) AS percent, CASE WHEN pct > 80 THEN 'drop' WHEN pct > 50 THEN 'consider_drop' WHEN pct > 20 THEN 'model' WHEN pct > 10 THEN 'impute' ELSE 'fill' END AS advice FROM u""")
def missing_profile(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return V.missing_profile(docs.join(labels, "doc_id", "left"), ["quality", "toxic", "doc_id"]).withColumn("percent", r6("percent"))


@query("""SELECT concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS pattern, count(*) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def missing_patterns(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return V.missing_patterns(docs.join(labels, "doc_id", "left"), ["quality", "toxic"])


@query(f"""WITH {INTERACTIONS}, {CONTENT}, s AS (SELECT count(DISTINCT user_id) AS au, count(DISTINCT item_id) AS ai, count(*) AS n, count(rating) AS rated, avg(rating) AS m, stddev_samp(rating) AS sd, min(rating) AS lo, max(rating) AS hi FROM interactions),
c AS (SELECT count(*) AS items, count(*) FILTER (len(genres) > 0) AS g FROM content), u AS (SELECT count(*) AS users FROM customer),
p AS (SELECT au / users AS uc, ai / items AS cc, rated / n AS rc, g / items AS gc, m, sd, lo, hi FROM s, c, u), q AS (SELECT *, (uc + cc + rc + gc) / 4 AS score FROM p)
SELECT round(uc, 6) AS user_coverage, round(cc, 6) AS content_coverage, round(rc, 6) AS rating_completeness, round(gc, 6) AS genre_completeness, round(m, 6) AS rating_mean, round(sd, 6) AS rating_std, lo AS rating_min, hi AS rating_max,
  round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.6 THEN 'C' WHEN score >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM q""")
def pipeline_coverage_report(spark, sf_dir):
    out = V.coverage_report(interactions(spark, sf_dir), content(spark, sf_dir), table(spark, sf_dir, "customer"))
    return out.select(*[c if c in ("grade", "rating_min", "rating_max") else r6(c).alias(c) for c in out.columns])
