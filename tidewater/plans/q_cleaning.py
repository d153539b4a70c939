"""Registered queries of cleaning, outliers, scaling and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import cleaning as C
from ..sources.views import INTERACTIONS, interactions, table
from .registry import query

#: Order totals of which every seventh key lacks its price, as a column with gaps.
GAPS = "gaps AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS price FROM orders)"


def gaps(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", price.alias("price"))


@query(f"""WITH {GAPS}, a AS (SELECT count(*) AS n, count(*) FILTER (price IS NULL) AS np, skewness(price) AS sk, count(*) FILTER (o_orderpriority IS NULL) AS nt FROM gaps)
SELECT 'price' AS field, round(np / n, 6) AS null_share, CASE WHEN np / n > 0.5 THEN 'drop' WHEN abs(sk) > 1 THEN 'median' ELSE 'mean' END AS strategy FROM a
UNION ALL SELECT 'o_orderpriority', round(nt / n, 6), CASE WHEN nt / n > 0.5 THEN 'drop' ELSE 'mode' END FROM a""")
def impute_default_strategy(spark, sf_dir):
    return C.impute_default_strategy(gaps(spark, sf_dir), ["price"], ["o_orderpriority"]).withColumn("null_share", r6("null_share"))


@query(f"WITH {GAPS} SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM gaps)), 6) AS price FROM gaps")
def impute_stat(spark, sf_dir):
    return C.impute_stat(gaps(spark, sf_dir), "price", "median").select("o_orderkey", r6("price").alias("price"))


@query(f"WITH {GAPS} SELECT o_orderkey, last_value(price IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS price FROM gaps")
def impute_fill_direction(spark, sf_dir):
    return C.impute_fill(gaps(spark, sf_dir), "price", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "price")


@query(f"""WITH {GAPS}, i AS (SELECT *, row_number() OVER w AS i FROM gaps WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
k AS (SELECT *, last_value(price IGNORE NULLS) OVER b AS a, first_value(price IGNORE NULLS) OVER f AS z, last_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, first_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER f AS iz
  FROM i WINDOW b AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT o_orderkey, round(coalesce(price, a + (z - a) * (i - ia) / nullif(iz - ia, 0), CASE WHEN z IS NULL THEN a END), 6) AS price FROM k""")
def impute_interpolate(spark, sf_dir):
    return C.impute_interpolate(gaps(spark, sf_dir), "price", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", r6("price").alias("price"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), o AS (SELECT event_id, value, greatest(a - value, value - b) AS off, b - a AS d FROM events, q)
SELECT event_id, coalesce(off > 1.5 * d, false) AS is_outlier, CASE WHEN off > 3 * d THEN 'high' WHEN off > 1.5 * d THEN 'medium' END AS severity FROM o""")
def outlier_iqr(spark, sf_dir):
    return C.outlier_iqr(table(spark, sf_dir, "events"), "value").select("event_id", "is_outlier", "severity")


@query("""WITH q AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - m) / s, 6) AS z, abs((value - m) / s) > 3 AS is_outlier FROM events, q""")
def outlier_zscore(spark, sf_dir):
    return C.outlier_zscore(table(spark, sf_dir, "events"), "value").select("event_id", r6("z").alias("z"), "is_outlier")


@query(f"WITH {INTERACTIONS} SELECT count(*) FILTER (rating NOT BETWEEN 0 AND 10) AS n_outliers, count(*) AS n FROM interactions")
def outlier_domain(spark, sf_dir):
    return C.outlier_domain(interactions(spark, sf_dir), "rating").agg(F.count_if("is_outlier").alias("n_outliers"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {INTERACTIONS}, q AS (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b, avg(value) m, stddev_pop(value) s, quantile_cont(rating, 0.25) ra, quantile_cont(rating, 0.75) rb, avg(rating) rm, stddev_pop(rating) rs FROM interactions),
c AS (SELECT count(*) n, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) vi, count(*) FILTER (abs(value - m) > 3 * s) vz, count(*) FILTER (rating < ra - 1.5 * (rb - ra) OR rating > rb + 1.5 * (rb - ra)) ri, count(*) FILTER (abs(rating - rm) > 3 * rs) rz FROM interactions, q)
SELECT 'value' AS field, 'iqr' AS method, vi AS outliers, round(vi * 100.0 / n, 6)::DOUBLE AS percent FROM c UNION ALL SELECT 'value', 'zscore', vz, round(vz * 100.0 / n, 6)::DOUBLE FROM c
UNION ALL SELECT 'rating', 'iqr', ri, round(ri * 100.0 / n, 6)::DOUBLE FROM c UNION ALL SELECT 'rating', 'zscore', rz, round(rz * 100.0 / n, 6)::DOUBLE FROM c""")
def outlier_report(spark, sf_dir):
    return C.outlier_report(interactions(spark, sf_dir), ["value", "rating"]).withColumn("percent", r6("percent"))


@query("WITH q AS (SELECT quantile_cont(value, 0.05) a, quantile_cont(value, 0.95) b FROM events) SELECT event_id, round(greatest(a, least(b, value)), 6) AS value FROM events, q")
def outlier_cap(spark, sf_dir):
    return C.outlier_cap(table(spark, sf_dir, "events"), "value").select("event_id", r6("value").alias("value"))


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
e AS (SELECT min(value) FILTER (i > floor(n * 0.05)) AS lo, max(value) FILTER (i <= n - floor(n * 0.05)) AS hi FROM r) SELECT event_id, greatest(lo, least(hi, value)) AS value FROM events, e""")
def outlier_winsorize(spark, sf_dir):
    return C.outlier_winsorize(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@query("WITH m AS (SELECT min(c_acctbal) AS m FROM customer) SELECT c_custkey, round(ln(CAST(c_acctbal AS DOUBLE) + CASE WHEN m <= 0 THEN abs(m) + 1 ELSE 0 END), 6) AS log_balance FROM customer, m")
def transform_log(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return C.transform_log(df, "c_acctbal", "log_balance").select("c_custkey", r6("log_balance").alias("log_balance"))


def likeliest(name: str, before: str, step: float, reach: int) -> str:
    """SQL of the Box-Cox exponent of the largest likelihood among those around the one before."""
    return f"""{name}_g AS (SELECT round((SELECT l FROM {before}) + i * {step}, 4) AS l FROM range(-{reach}, {reach + 1}) t(i)), {name}_f AS (SELECT l, (l - 1) * sum(ln(x)) - count(x) / 2 * ln(var_pop(CASE WHEN abs(l) < 1e-9 THEN ln(x) ELSE (pow(x, l) - 1) / l END)) AS f FROM xs, {name}_g GROUP BY l), {name} AS (SELECT l FROM {name}_f ORDER BY f DESC, l LIMIT 1)"""


@query(f"""WITH m AS (SELECT min(value) AS m FROM events), xs AS (SELECT event_id, value + CASE WHEN m <= 0 THEN abs(m) + 1 ELSE 0 END AS x FROM events, m), b0 AS (SELECT 0.0::DOUBLE AS l), {likeliest("b1", "b0", 0.25, 8)}, {likeliest("b2", "b1", 0.025, 10)}, {likeliest("b3", "b2", 0.0025, 10)}
SELECT event_id, l AS value_lambda, round(CASE WHEN abs(l) < 1e-9 THEN ln(x) ELSE (pow(x, l) - 1) / l END, 6) AS value FROM xs, b3""")
def transform_boxcox(spark, sf_dir):
    out = C.transform_boxcox(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x")), "x", "value")
    return out.select("event_id", "value_lambda", r6("value").alias("value"))


@query("""WITH s AS (SELECT event_id, greatest(1e-7, least(1 - 1e-7, (rank() OVER (ORDER BY value) - 1 + (count(*) OVER (PARTITION BY value) - 1) / 2) / greatest(count(*) OVER () - 1, 1))) AS p FROM events WHERE value IS NOT NULL),
q AS (SELECT event_id, p, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM s),
z AS (SELECT event_id, CASE WHEN abs(q) <= 0.47575 THEN (((((-39.69683028665376 * r + 220.9460984245205) * r - 275.9285104469687) * r + 138.357751867269) * r - 30.66479806614716) * r + 2.506628277459239) * q / (((((-54.47609879822406 * r + 161.5858368580409) * r - 155.6989798598866) * r + 66.80131188771972) * r - 13.28068155288572) * r + 1)
ELSE sign(-q) * (((((-0.007784894002430293 * t - 0.3223964580411365) * t - 2.400758277161838) * t - 2.549732539343734) * t + 4.374664141464968) * t + 2.938163982698783) / ((((0.007784695709041462 * t + 0.3224671290700398) * t + 2.445134137142996) * t + 3.754408661907416) * t + 1) END AS z FROM q)
SELECT event_id, round(z, 5) AS normal FROM events LEFT JOIN z USING (event_id)""")
def transform_quantile_normal(spark, sf_dir):
    out = C.transform_quantile_normal(table(spark, sf_dir, "events"), "value", "normal")
    return out.select("event_id", F.round("normal", 5).alias("normal"))


@query(f"""WITH {INTERACTIONS}, q AS (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b, quantile_cont(rating, 0.25) ra, quantile_cont(rating, 0.75) rb FROM interactions),
c AS (SELECT 100.0 * count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*) AS v, 100.0 * count(*) FILTER (rating < ra - 1.5 * (rb - ra) OR rating > rb + 1.5 * (rb - ra)) / count(*) AS r, skewness(value) AS sv, skewness(rating) AS sr FROM interactions, q),
u AS (SELECT 'value' AS field, v AS percent, sv AS skew FROM c UNION ALL SELECT 'rating', r, sr FROM c)
SELECT field, round(CAST(percent AS DOUBLE), 6) AS percent, round(skew, 6) AS skew, CASE WHEN percent > 20 THEN 'cap' WHEN percent > 10 THEN 'winsorize' WHEN field LIKE '%rating%' THEN 'cap' WHEN abs(skew) > 2 THEN 'log' ELSE 'cap' END AS treatment FROM u""")
def outlier_default_treatment(spark, sf_dir):
    out = C.outlier_default_treatment(interactions(spark, sf_dir), ["value", "rating"])
    return out.select("field", r6("percent").alias("percent"), r6("skew").alias("skew"), "treatment")


@query(f"WITH {INTERACTIONS}, m AS (SELECT min(rating) a, max(rating) b FROM interactions) SELECT event_id, round(CASE WHEN a = b THEN 0.5 ELSE (rating - a) / (b - a) END, 6) AS rating, rating AS original_rating, 'min-max' AS rating_scale FROM interactions, m")
def rating_minmax(spark, sf_dir):
    return C.rating_minmax(interactions(spark, sf_dir)).select("event_id", r6("rating").alias("rating"), "original_rating", "rating_scale")


@query(f"""WITH {INTERACTIONS}, m AS (SELECT quantile_cont(value, 0.5) m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) s, quantile_cont(rating, 0.5) rm, quantile_cont(rating, 0.75) - quantile_cont(rating, 0.25) rs FROM interactions)
SELECT event_id, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value_scaled, round((rating - rm) / CASE WHEN rs = 0 THEN 1 ELSE rs END, 6) AS rating_scaled FROM interactions, m""")
def scale_features(spark, sf_dir):
    out = C.scale_features(interactions(spark, sf_dir), ["value", "rating"], "robust")
    return out.select("event_id", r6("value_scaled").alias("value_scaled"), r6("rating_scaled").alias("rating_scaled"))


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type_encoded FROM events")
def encode_label(spark, sf_dir):
    return C.encode_label(table(spark, sf_dir, "events"), "event_type").select("event_id", "event_type_encoded")


@query("""SELECT user_id, CAST(max(CAST(event_type = 'click' AS INTEGER)) AS INTEGER) AS event_type_click, CAST(max(CAST(event_type = 'view' AS INTEGER)) AS INTEGER) AS event_type_view FROM events GROUP BY 1""")
def encode_onehot(spark, sf_dir):
    return C.encode_onehot(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view"])


@query(f"WITH {INTERACTIONS} SELECT event_id, round(avg(rating) OVER (PARTITION BY interaction_type), 6) AS interaction_type_target FROM interactions")
def encode_target(spark, sf_dir):
    return C.encode_target(interactions(spark, sf_dir), "interaction_type", "rating").select("event_id", r6("interaction_type_target").alias("interaction_type_target"))


@query("""WITH m AS (SELECT max(ts) AS last FROM events), p AS (SELECT event_id, hour(ts) AS h, isodow(ts) - 1 AS d, month(ts) AS mo, year(ts) AS y, floor((epoch(date_trunc('second', last)) - epoch(date_trunc('second', ts))) / 86400) AS days FROM events, m)
SELECT event_id, CAST(h AS INTEGER) AS hour, CAST(d AS INTEGER) AS day_of_week, CAST(mo AS INTEGER) AS month, CAST(y AS INTEGER) AS year, d >= 5 AS is_weekend, round(sin(2 * pi() * h / 24), 6) AS hour_sin, round(cos(2 * pi() * d / 7), 6) AS day_cos,
  CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day, CAST(days AS BIGINT) AS days_since, round(1 / (1 + days), 6) AS recency FROM p""")
def temporal_features(spark, sf_dir):
    out = C.temporal_features(table(spark, sf_dir, "events"))
    return out.select("event_id", "hour", "day_of_week", "month", "year", "is_weekend", r6("hour_sin").alias("hour_sin"), r6("day_cos").alias("day_cos"), "time_of_day", "days_since", r6("recency").alias("recency"))


@query()
def preprocess_pipeline(spark, sf_dir):
    df = interactions(spark, sf_dir).select("event_id", "interaction_type", "value", "rating", "ts")
    return C.preprocess(df, ["value", "rating"], ["interaction_type"], "ts")
