"""Registered queries of profiles over periods and of drift between snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evolution as V
from ..operators import profile as P
from ..sources.views import CONTENT, INTERACTIONS, content, interactions, purchases
from .q_evaluation import two_sided
from .q_evolution import DAY, PERIOD_METRICS, SNAPS, daily_snapshots
from .q_users import rounded
from .registry import query

#: Periods with their start in days and stability to nine digits, trends, scores, stages and risks of purchases, as SQL.
METRICS = PERIOD_METRICS + f""", st AS (SELECT user_id, period, epoch_us(min(ts)) / {DAY} AS start FROM cut GROUP BY 1, 2), pr AS (SELECT user_id, period, start, level, round(stability, 9)::DOUBLE AS stability FROM pm JOIN st USING (user_id, period))"""
TRENDS = METRICS + """, tr0 AS (SELECT user_id, period, start, 'stability_change' AS kind, stability AS value FROM pr UNION ALL SELECT user_id, period, start, 'activity_change', CASE level WHEN 'low' THEN 1.0 WHEN 'high' THEN 3.0 ELSE 2.0 END::DOUBLE FROM pr),
tr1 AS (SELECT user_id, kind, count(*) AS n, round(regr_slope(value, start), 9) AS slope, round(CASE WHEN stddev_pop(value) > 0 AND stddev_pop(start) > 0 THEN corr(start, value) ELSE 0 END, 9)::DOUBLE AS r, arg_max(value, period) AS last, max(start) - min(start) AS span FROM tr0 GROUP BY 1, 2),
tr AS (SELECT user_id, kind, slope, last, span, abs(r) AS strength, round(r * r, 9) AS confidence, CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM tr1 WHERE n >= 3 AND slope IS NOT NULL)"""
SCORES = TRENDS + """, s0 AS (SELECT *, abs(stability - lag(stability) OVER (PARTITION BY user_id ORDER BY period)) AS d FROM pr), s1 AS (SELECT user_id, count(*) AS periods, avg(stability) AS m, var_pop(stability) AS v, avg(d) AS c FROM s0 GROUP BY 1), s2 AS (SELECT user_id, least(1.0, avg(confidence) + 0.2 * avg(CAST(strength >= 0.5 AS DOUBLE))) AS p FROM tr GROUP BY 1),
sc AS (SELECT user_id, periods, CASE WHEN periods < 2 THEN 0.5 ELSE greatest(0.0, m - least(0.3, v)) END::DOUBLE AS stability, coalesce(c, 0)::DOUBLE AS velocity, coalesce(p, 0.5)::DOUBLE AS predictability FROM s1 LEFT JOIN s2 USING (user_id))"""
STAGES = SCORES + f""", {CONTENT}, g0 AS (SELECT user_id, count(*) AS n, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / {DAY}) + 1 AS days, count(*) FILTER (ts >= (SELECT max(ts) FROM purchases) - INTERVAL 30 DAY) AS recent, count(DISTINCT content_type) AS types FROM purchases LEFT JOIN content ON item_id = content_id GROUP BY 1),
g1 AS (SELECT user_id, count(*) AS periods, avg(stability) FILTER (k <= 2) AS late FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS k FROM pr) GROUP BY 1),
sg AS (SELECT user_id, n, CAST(days AS BIGINT) AS days, recent, CASE WHEN days <= 30 AND n <= 20 THEN 'onboarding' WHEN days <= 90 AND types >= 2 THEN 'exploration' WHEN days > 90 AND n >= 50 AND recent >= 5 THEN CASE WHEN periods >= 2 AND late < 0.7 THEN 'exploration' ELSE 'established' END WHEN days > 180 AND n >= 100 THEN 'mature' WHEN recent = 0 AND days > 60 THEN 'declining' ELSE 'undefined' END AS stage,
least(1.0, n / 50) * CASE WHEN days >= 30 THEN 0.8 + 0.2 * least(1.0, days / 90) ELSE 1.0 END AS confidence FROM g0 JOIN g1 USING (user_id))"""
FACTORS = ", ".join(f"('{s}', '{f}')" for s, names in P.RISKS.items() for f in names)
ALL_RISKS = STAGES + f""", ri AS (SELECT user_id, 'engagement_decline' AS risk, '' AS detail, CASE WHEN strength >= 0.7 THEN 'high' ELSE 'medium' END AS severity FROM tr WHERE direction = 'decreasing' AND kind = 'stability_change' AND strength >= 0.3
UNION ALL SELECT user_id, 'activity_decline', '', CASE WHEN strength >= 0.8 THEN 'high' ELSE 'medium' END FROM tr WHERE direction = 'decreasing' AND kind = 'activity_change' AND strength >= 0.4 UNION ALL SELECT user_id, 'profile_instability', '', 'medium' FROM sc WHERE stability < 0.3 AND velocity > 0.7
UNION ALL SELECT user_id, 'lifecycle_risk', f, 'low' FROM sg JOIN (VALUES {FACTORS}) x(stage, f) USING (stage) UNION ALL SELECT user_id, 'profile_stagnation', '', 'low' FROM sc WHERE periods >= 3 AND user_id NOT IN (SELECT user_id FROM tr WHERE direction <> 'stable' AND span <= 60))"""


def metrics(spark, sf_dir):
    cut = V.periods(purchases(spark, sf_dir))
    start = cut.groupBy("user_id", "period").agg((F.unix_micros(F.min("ts")) / DAY).alias("start"))
    return V.period_metrics(cut).join(start, ["user_id", "period"]).withColumn("stability", F.round("stability", 9))


def trends(m):
    return P.period_trends(m).withColumns({c: F.round(c, 9) for c in ("slope", "strength", "confidence")})


def stages(spark, sf_dir, m):
    return P.life_stage(purchases(spark, sf_dir), m, content(spark, sf_dir))


@query(f"{STAGES} SELECT user_id, n, days, recent, stage, round(confidence + 1e-9, 6)::DOUBLE AS confidence FROM sg")
def lifecycle_period_stage(spark, sf_dir):
    return rounded(stages(spark, sf_dir, metrics(spark, sf_dir)), 1e-9)


@query(f"{ALL_RISKS} SELECT * FROM ri")
def risk_indicators(spark, sf_dir):
    m = metrics(spark, sf_dir)
    t = trends(m)
    return P.risk_indicators(stages(spark, sf_dir, m), t, P.profile_scores(m, t))


STEPS = ", ".join(f"('{s}', '{','.join(n)}')" for s, n in P.NEXT.items())


@query(f"""{STAGES}, ah AS (SELECT user_id, last, greatest(0.0, least(1.0, last + slope * 30)) AS predicted FROM tr WHERE kind = 'stability_change' AND direction <> 'stable' AND confidence >= 0.5)
SELECT user_id, round(predictability + 1e-9, 6) AS confidence, coalesce(stage, 'unknown') AS stage, coalesce(f, '') AS next_stages, round(last + 1e-9, 6) AS current, round(predicted + 1e-9, 6)::DOUBLE AS predicted, round(predicted - last + 1e-9, 6)::DOUBLE AS change FROM sc LEFT JOIN sg USING (user_id) LEFT JOIN ah USING (user_id) LEFT JOIN (VALUES {STEPS}) x(stage, f) USING (stage)""")
def behavior_forecast(spark, sf_dir):
    m = metrics(spark, sf_dir)
    t = trends(m)
    return rounded(P.behaviour_forecast(stages(spark, sf_dir, m), t, P.profile_scores(m, t)), 1e-9)


@query(f"""{ALL_RISKS}, tl AS (SELECT user_id, string_agg(kind || ':' || direction, ',' ORDER BY kind || ':' || direction) AS trends FROM tr GROUP BY 1), rc AS (SELECT user_id, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM ri GROUP BY 1)
SELECT user_id, coalesce(stage, 'unknown') AS stage, round(coalesce(confidence, 0) + 1e-9, 6)::DOUBLE AS stage_confidence, periods, round(stability + 1e-9, 6) AS stability, round(velocity + 1e-9, 6) AS velocity, round(predictability + 1e-9, 6) AS predictability, coalesce(trends, '') AS trends, coalesce(h, 0) AS high_risks, coalesce(rc.m, 0) AS medium_risks, coalesce(l, 0) AS low_risks
FROM sc LEFT JOIN sg USING (user_id) LEFT JOIN tl USING (user_id) LEFT JOIN rc USING (user_id)""")
def evolution_summary(spark, sf_dir):
    m = metrics(spark, sf_dir)
    t = trends(m)
    s, g = P.profile_scores(m, t), stages(spark, sf_dir, m)
    return rounded(P.evolution_summary(g, t, s, P.risk_indicators(g, t, s)), 1e-9)


#: Snapshots of bands of 12 days; tables of a month have no two bands of 15.
@query(f"""{SNAPS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY snapshot DESC) AS k FROM sn), o AS (SELECT *, k <= 12 AS second, max(k) OVER (PARTITION BY user_id) AS n FROM k WHERE k <= 24), b AS (SELECT * FROM o WHERE n >= 22),
v AS (SELECT user_id, key, coalesce(sum(value) FILTER (second), 0) / 12 AS b, coalesce(sum(value) FILTER (NOT second), 0) / (max(n) - 12) AS a, max(n) - 12 AS older FROM b GROUP BY 1, 2), c AS (SELECT user_id, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 9)::DOUBLE AS magnitude, max(older) AS older FROM v GROUP BY 1),
m AS (SELECT user_id, snapshot, second, round(avg(value), 9) AS mean FROM b GROUP BY 1, 2, 3), mc AS (SELECT user_id, mean, count(*) FILTER (NOT second) AS a, count(*) FILTER (second) AS b FROM m GROUP BY 1, 2), g AS (SELECT user_id, abs(sum(a) OVER x / sum(a) OVER w - sum(b) OVER x / sum(b) OVER w) AS d FROM mc WINDOW w AS (PARTITION BY user_id), x AS (PARTITION BY user_id ORDER BY mean ROWS UNBOUNDED PRECEDING)),
h AS (SELECT user_id, max(d) AS ks FROM g GROUP BY 1), f AS (SELECT user_id, magnitude, ks, ks > 1.358 * sqrt((older + 12) / (older * 12)) AS ks_drift FROM c JOIN h USING (user_id))
SELECT user_id, round(magnitude, 6) AS magnitude, round(ks + 1e-9, 6) AS ks, ks_drift, magnitude > 0.3 OR ks_drift AS drifted, CASE WHEN magnitude > 0.6 THEN 'sudden' WHEN magnitude > 0.3 OR ks_drift THEN 'concept' END AS type, round(CASE WHEN magnitude > 0.3 OR ks_drift THEN least(1.0, magnitude + CASE WHEN ks_drift THEN 0.3 ELSE 0 END) END, 6)::DOUBLE AS confidence FROM f""")
def snapshot_statistical_drift(spark, sf_dir):
    out = P.statistical_drift(daily_snapshots(spark, sf_dir), 12, 10)
    return rounded(out.withColumn("ks", F.col("ks") + 1e-9))


@query(f"""WITH {INTERACTIONS}, d AS (SELECT user_id, ts::DATE AS snapshot, count(*) AS n, count(*) / (count(*) + 5) AS confidence, count(DISTINCT interaction_type) AS breadth FROM interactions GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY snapshot DESC) AS k FROM d QUALIFY k <= 20), o AS (SELECT *, k <= 10 AS second, max(k) OVER (PARTITION BY user_id) AS m FROM k),
a AS (SELECT user_id, count(*) FILTER (second) AS k2, count(*) FILTER (NOT second) AS k1, avg(n) FILTER (second) AS n2, avg(n) FILTER (NOT second) AS n1, var_samp(n) FILTER (second) AS v2, var_samp(n) FILTER (NOT second) AS v1, abs(avg(confidence) FILTER (second) - avg(confidence) FILTER (NOT second)) AS cc, abs(avg(breadth) FILTER (second) - avg(breadth) FILTER (NOT second)) AS bc FROM o WHERE m >= 15 GROUP BY 1),
b AS (SELECT *, k1 + k2 - 2 AS f, ((k1 - 1) * v1 + (k2 - 1) * v2) / (k1 + k2 - 2) AS p FROM a), t AS (SELECT *, CASE WHEN p > 0 THEN (n2 - n1) / sqrt(p * (1 / k1 + 1 / k2)) END AS t FROM b), z AS (SELECT *, (8 * f + 1) / (8 * f + 3) * sqrt(f * ln(1 + t * t / f)) AS z FROM t),
s AS (SELECT *, coalesce({two_sided("z")} < 0.05, false) AS sig FROM z), q AS (SELECT *, CASE WHEN sig THEN 4 ELSE 0 END + CASE WHEN cc > 0.3 THEN 4 ELSE 0 END + CASE WHEN bc > 2 THEN 2 ELSE 0 END AS points FROM s)
SELECT user_id, round(t + 1e-9, 6) AS t, round(cc + 1e-9, 6) AS confidence_change, round(bc + 1e-9, 6) AS breadth_change, points / 10 AS confidence, points > 0 AS drifted, round(CASE WHEN points > 0 THEN least(1.0, greatest(CASE WHEN sig THEN abs(t) / 10 ELSE 0 END, cc, bc / 5)) END + 1e-9, 6)::DOUBLE AS severity FROM q""")
def snapshot_behavioral_drift(spark, sf_dir):
    own = interactions(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("snapshot")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("interaction_type").alias("breadth"))
    return rounded(P.behavioural_drift(own.withColumn("confidence", F.col("n") / (F.col("n") + 5))), 1e-9)


@query(f"""{SNAPS}, o AS (SELECT *, x + 0.0 AS i FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY snapshot) - 1 AS x FROM sn)), b AS (SELECT * FROM (SELECT *, max(x) OVER (PARTITION BY user_id) + 1 AS n FROM o) WHERE n >= 20),
s AS (SELECT user_id, key, max(n)::DOUBLE AS n, sum(value) AS y, sum(value * value) AS yy, sum(x * value) AS xy FROM b GROUP BY 1, 2), l AS (SELECT user_id, key, n, n * (n * n - 1) / 12 AS sxx, xy - (n - 1) / 2 * y AS sxy, yy - y * y / n AS syy FROM s),
r AS (SELECT user_id, n - 2 AS f, round(sxy / sxx, 9) AS slope, sxy * sxy / nullif(sxx * syy, 0) AS r2 FROM l), t AS (SELECT *, r2 * f / greatest(1 - r2, 1e-12) AS tt FROM r), z AS (SELECT *, (8 * f + 1) / (8 * f + 3) * sqrt(f * ln(1 + tt / f)) AS z FROM t), p AS (SELECT *, {two_sided("z")} AS p FROM z),
a AS (SELECT user_id, count(*) AS keys, count(*) FILTER (abs(slope) > 0.05 AND p < 0.05) AS significant, avg(abs(slope)) FILTER (abs(slope) > 0.01 AND p < 0.1) AS m FROM p GROUP BY 1),
w AS (SELECT user_id, isodow(snapshot) AS d, avg(m) AS m FROM (SELECT user_id, snapshot, avg(value) AS m FROM b WHERE n >= 28 GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*) >= 3), e AS (SELECT user_id, count(*) >= 5 AND stddev_pop(m) / avg(m) > 0.1 AS seasonal FROM w GROUP BY 1),
h AS (SELECT user_id, keys, significant, coalesce(seasonal, false) AS seasonal, significant >= 2 OR coalesce(seasonal, false) AS drifted, m FROM a LEFT JOIN e USING (user_id))
SELECT user_id, keys, significant, seasonal, drifted, CASE WHEN seasonal THEN 'seasonal' WHEN drifted THEN 'gradual' END AS type, round(CASE WHEN drifted THEN least(1.0, significant / keys + CASE WHEN seasonal THEN 0.3 ELSE 0 END) END + 1e-9, 6)::DOUBLE AS confidence, round(CASE WHEN drifted THEN least(1.0, coalesce(m, 0)) END + 1e-9, 6)::DOUBLE AS severity FROM h""")
def snapshot_temporal_drift(spark, sf_dir):
    return rounded(P.temporal_drift(daily_snapshots(spark, sf_dir)), 1e-9)
