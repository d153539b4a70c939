"""Trends, stages, risks and forecasts of a user's periods, and drift between a user's snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import as_of, normal_two_sided, ratio, student_as_normal
from .preferences import ks

#: Fixed risk factors and possible next stages of the stages of a user's life.
RISKS = {
    "onboarding": ["early_abandonment", "overwhelming_choice"],
    "exploration": ["preference_confusion", "decision_fatigue"],
    "established": ["boredom", "routine_staleness"],
    "mature": ["platform_fatigue", "reduced_exploration"],
    "declining": ["churn_risk", "platform_abandonment"],
}
NEXT = {
    "onboarding": ["exploration", "declining"],
    "exploration": ["established", "declining"],
    "established": ["mature", "declining"],
    "mature": ["declining"],
    "declining": ["mature"],
}


def life_stage(interactions: DataFrame, metrics: DataFrame, content: DataFrame, steady: float = 0.7, when: str | None = None) -> DataFrame:
    """user_id, n, days, recent, stage, confidence.

    onboarding up to 30 days and 20 events; exploration up to 90 days with two content types;
    established beyond 90 days with 50 events, 5 of them in the last 30 days, where the last
    two periods' stability reaches `steady` on the mean (exploration where it does not, and
    established for a single period); mature beyond 180 days and 100 events; declining beyond
    60 days without recent events; else undefined. metrics has user_id, period, stability;
    users without a period are left out.
    """
    types = content.select(F.col("content_id").alias("item_id"), "content_type")
    own = as_of(interactions, when).join(types, "item_id", "left")
    recent = F.count_if(F.col("ts") >= F.col("as_of") - F.expr("interval 30 days"))
    a = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000) + 1).alias("days"), recent.alias("recent"), F.countDistinct("content_type").alias("types"))
    late = metrics.withColumn("_k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("period"))))
    p = late.groupBy("user_id").agg(F.count(F.lit(1)).alias("periods"), F.avg(F.when(F.col("_k") <= 2, F.col("stability"))).alias("late"))
    n, days = F.col("n"), F.col("days")
    settled = F.when((F.col("periods") >= 2) & (F.col("late") < steady), "exploration").otherwise("established")
    stage = (
        F.when((days <= 30) & (n <= 20), "onboarding")
        .when((days <= 90) & (F.col("types") >= 2), "exploration")
        .when((days > 90) & (n >= 50) & (F.col("recent") >= 5), settled)
        .when((days > 180) & (n >= 100), "mature")
        .when((F.col("recent") == 0) & (days > 60), "declining")
        .otherwise("undefined")
    )
    confidence = F.least(F.lit(1.0), n / 50) * F.when(days >= 30, 0.8 + 0.2 * F.least(F.lit(1.0), days / 90)).otherwise(1.0)
    return a.join(p, "user_id").select("user_id", "n", "days", "recent", stage.alias("stage"), confidence.alias("confidence"))


def period_trends(metrics: DataFrame, least: int = 3) -> DataFrame:
    """user_id, kind, slope, first, last, strength, confidence, direction of a line through a user's periods, for stability_change and activity_change (levels as 1 to 3).

    Strength is the absolute correlation, confidence r squared, and a direction below 0.001 a
    day is stable. metrics has user_id, period, start (days), stability, level.
    """
    level = F.when(F.col("level") == "low", 1.0).when(F.col("level") == "high", 3.0).otherwise(2.0)
    kinds = F.array(F.struct(F.lit("stability_change").alias("kind"), F.col("stability").alias("value")), F.struct(F.lit("activity_change").alias("kind"), level.alias("value")))
    rows = metrics.select("user_id", "period", "start", F.inline(kinds))
    r = ratio(F.covar_pop("start", "value"), F.stddev_pop("start") * F.stddev_pop("value"), 0.0)
    a = rows.groupBy("user_id", "kind").agg(F.count("value").alias("n"), F.regr_slope("value", "start").alias("slope"), r.alias("r"), F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), (F.max("start") - F.min("start")).alias("span"))
    direction = F.when(F.abs("slope") < 0.001, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return a.filter((F.col("n") >= least) & F.col("slope").isNotNull()).select("user_id", "kind", "slope", "first", "last", "span", F.abs("r").alias("strength"), (F.col("r") * F.col("r")).alias("confidence"), direction.alias("direction"))


def profile_scores(metrics: DataFrame, trends: DataFrame) -> DataFrame:
    """user_id, periods, stability (mean less its variance, 0.3 at most; 0.5 for one period), velocity (mean absolute change of stability), predictability (mean confidence of trends and 0.2 of the share of strong ones, 1 at most; 0.5 without trends)."""
    w = W.partitionBy("user_id").orderBy("period")
    own = metrics.withColumn("_d", F.abs(F.col("stability") - F.lag("stability").over(w)))
    a = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("periods"), F.avg("stability").alias("_m"), F.var_pop("stability").alias("_v"), F.avg("_d").alias("_c"))
    stability = F.when(F.col("periods") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), F.col("_m") - F.least(F.lit(0.3), F.col("_v"))))
    t = trends.groupBy("user_id").agg(F.least(F.lit(1.0), F.avg("confidence") + 0.2 * F.avg((F.col("strength") >= 0.5).cast("double"))).alias("_p"))
    return a.join(t, "user_id", "left").select("user_id", "periods", stability.alias("stability"), F.coalesce("_c", F.lit(0.0)).alias("velocity"), F.coalesce("_p", F.lit(0.5)).alias("predictability"))


def risk_indicators(stages: DataFrame, trends: DataFrame, scores: DataFrame) -> DataFrame:
    """user_id, risk, detail, severity: falling trends of strength 0.3 (stability) or 0.4 (activity) on, high from 0.7 and 0.8; an unstable profile (stability below 0.3, velocity above 0.7); the factors of the stage; three periods on without a moving trend of 60 days or less."""
    down = F.col("direction") == "decreasing"
    s, kind = F.col("strength"), F.col("kind")
    engagement = trends.filter(down & (kind == "stability_change") & (s >= 0.3)).select("user_id", F.lit("engagement_decline").alias("risk"), F.lit("").alias("detail"), F.when(s >= 0.7, "high").otherwise("medium").alias("severity"))
    activity = trends.filter(down & (kind == "activity_change") & (s >= 0.4)).select("user_id", F.lit("activity_decline").alias("risk"), F.lit("").alias("detail"), F.when(s >= 0.8, "high").otherwise("medium").alias("severity"))
    unstable = scores.filter("stability < 0.3 and velocity > 0.7").select("user_id", F.lit("profile_instability").alias("risk"), F.lit("").alias("detail"), F.lit("medium").alias("severity"))
    factors = F.lit(None).cast("array<string>")
    for name, names in RISKS.items():
        factors = F.when(F.col("stage") == name, F.array(*map(F.lit, names))).otherwise(factors)
    life = stages.select("user_id", F.lit("lifecycle_risk").alias("risk"), F.explode(factors).alias("detail"), F.lit("low").alias("severity"))
    moving = trends.filter("direction <> 'stable' and span <= 60").select("user_id")
    still = scores.filter("periods >= 3").join(moving, "user_id", "left_anti").select("user_id", F.lit("profile_stagnation").alias("risk"), F.lit("").alias("detail"), F.lit("low").alias("severity"))
    return engagement.unionByName(activity).unionByName(unstable).unionByName(life).unionByName(still)


def behaviour_forecast(stages: DataFrame, trends: DataFrame, scores: DataFrame, days: int = 30, least: float = 0.5) -> DataFrame:
    """user_id, confidence (predictability), stage, next_stages, current, predicted, change: the last stability moved by its slope over `days`, between 0 and 1, for moving trends of confidence `least` on; null for others."""
    sure = trends.filter((F.col("kind") == "stability_change") & (F.col("direction") != "stable") & (F.col("confidence") >= least))
    ahead = sure.select("user_id", F.col("last").alias("current"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("last") + F.col("slope") * days)).alias("predicted"))
    follow = F.lit("")
    for name, names in NEXT.items():
        follow = F.when(F.col("stage") == name, ",".join(names)).otherwise(follow)
    out = scores.join(stages.select("user_id", "stage"), "user_id", "left").join(ahead, "user_id", "left")
    return out.select("user_id", F.col("predictability").alias("confidence"), F.coalesce("stage", F.lit("unknown")).alias("stage"), follow.alias("next_stages"), "current", "predicted", (F.col("predicted") - F.col("current")).alias("change"))


def evolution_summary(stages: DataFrame, trends: DataFrame, scores: DataFrame, risks: DataFrame) -> DataFrame:
    """user_id, stage and its confidence, the profile's scores, trends as kind:direction joined by name, and the risks of each severity."""
    t = trends.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "direction"))), ",").alias("trends"))
    r = risks.groupBy("user_id").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_risks") for s in ("high", "medium", "low")])
    out = scores.join(stages.select("user_id", "stage", F.col("confidence").alias("stage_confidence")), "user_id", "left").join(t, "user_id", "left").join(r, "user_id", "left")
    zero = [F.coalesce(f"{s}_risks", F.lit(0)).cast("long").alias(f"{s}_risks") for s in ("high", "medium", "low")]
    return out.select("user_id", F.coalesce("stage", F.lit("unknown")).alias("stage"), F.coalesce("stage_confidence", F.lit(0.0)).alias("stage_confidence"), "periods", "stability", "velocity", "predictability", F.coalesce("trends", F.lit("")).alias("trends"), *zero)


def _bands(snaps: DataFrame, size: int, least: int) -> DataFrame:
    """Snapshots with second (true for the user's last `size`, false for the `size` before), for users with `least` of the earlier ones."""
    k = F.dense_rank().over(W.partitionBy("user_id").orderBy(F.desc("snapshot")))
    own = snaps.withColumn("_k", k).filter(F.col("_k") <= 2 * size)
    own = own.withColumn("_n", F.max("_k").over(W.partitionBy("user_id"))).filter(F.col("_n") >= size + least)
    return own.withColumn("second", F.col("_k") <= size)


def statistical_drift(snaps: DataFrame, size: int = 15, least: int = 10) -> DataFrame:
    """user_id, magnitude (1 less the cosine of the mean vectors of both bands, absent keys count 0), ks of the snapshots' mean values, ks_drift, drifted, type, confidence.

    ks_drift compares ks with the asymptotic point of 5 %, 1.358 * sqrt((a + b) / (a * b)).
    Drift is a magnitude above 0.3 or ks_drift; it is sudden above 0.6, else concept; the
    windowed mean test is adwin_split. snaps has user_id, snapshot, key, value.
    """
    own = _bands(snaps, size, least)
    v = own.groupBy("user_id", "key").agg((F.coalesce(F.sum(F.when(F.col("second"), F.col("value"))), F.lit(0.0)) / size).alias("b"), (F.coalesce(F.sum(F.when(~F.col("second"), F.col("value"))), F.lit(0.0)) / (F.max("_n") - size)).alias("a"), F.max("_n").alias("n"))
    a = v.groupBy("user_id").agg(ratio(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))), 0.0).alias("cosine"), (F.max("n") - size).alias("older"))
    means = own.groupBy("user_id", "snapshot", "second").agg(F.round(F.avg("value"), 9).alias("mean"))
    out = a.join(ks(means, ["user_id"], "mean", "second"), "user_id")
    point = 1.358 * F.sqrt((F.col("older") + size) / (F.col("older") * size))
    out = out.select("user_id", F.round(1 - F.col("cosine"), 9).alias("magnitude"), "ks", (F.col("ks") > point).alias("ks_drift"))
    hit = (F.col("magnitude") > 0.3) | F.col("ks_drift")
    kind = F.when(F.col("magnitude") > 0.6, "sudden").otherwise("concept")
    return out.select("*", hit.alias("drifted"), F.when(hit, kind).alias("type"), F.when(hit, F.least(F.lit(1.0), F.col("magnitude") + F.when(F.col("ks_drift"), 0.3).otherwise(0.0))).alias("confidence"))


def behavioural_drift(daily: DataFrame, size: int = 10, least: int = 5) -> DataFrame:
    """user_id, t (of the counts of both bands, equal variances), confidence_change, breadth_change, drifted, confidence (0.4 for a t of p < 0.05, 0.4 for a change of confidence above 0.3, 0.2 for one of breadth above 2), severity. daily has user_id, snapshot, n, confidence, breadth; counts that do not vary give no t."""
    own = _bands(daily, size, least)
    part = lambda f, c, second: f(F.when(F.col("second") == F.lit(second), F.col(c)))
    aggs = [F.count_if(F.col("second")).alias("n2"), F.count_if(~F.col("second")).alias("n1")]
    for c in ("n", "confidence", "breadth"):
        aggs += [part(F.avg, c, True).alias(f"{c}2"), part(F.avg, c, False).alias(f"{c}1")]
    a = own.groupBy("user_id").agg(*aggs, part(F.var_samp, "n", True).alias("v2"), part(F.var_samp, "n", False).alias("v1"))
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = F.when(pooled > 0, (F.col("n2_") - F.col("n1_")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    # the mean counts share their names with the numbers of snapshots
    out = a.toDF("user_id", "n2", "n1", "n2_", "n1_", "c2", "c1", "b2", "b1", "v2", "v1").withColumn("t", t).withColumn("_p", normal_two_sided(student_as_normal(F.col("t"), dof)))
    out = out.select("user_id", "t", F.abs(F.col("c2") - F.col("c1")).alias("confidence_change"), F.abs(F.col("b2") - F.col("b1")).alias("breadth_change"), F.coalesce(F.col("_p") < 0.05, F.lit(False)).alias("_t"))
    points = F.when(F.col("_t"), 4).otherwise(0) + F.when(F.col("confidence_change") > 0.3, 4).otherwise(0) + F.when(F.col("breadth_change") > 2, 2).otherwise(0)
    severity = F.least(F.lit(1.0), F.greatest(F.when(F.col("_t"), F.abs("t") / 10).otherwise(0.0), F.col("confidence_change"), F.col("breadth_change") / 5))
    return out.withColumn("confidence", points / 10).withColumn("drifted", points > 0).withColumn("severity", F.when(F.col("drifted"), severity)).drop("_t")


def temporal_drift(snaps: DataFrame, least: int = 20, weeks: int = 28) -> DataFrame:
    """user_id, keys, significant (slopes above 0.05 a snapshot with p < 0.05), seasonal, drifted, type, confidence, severity (mean slope of trends above 0.01 with p < 0.1).

    Lines run over the user's snapshots in order, absent keys count 0. Seasonal: from `weeks`
    snapshots on, five weekdays of three snapshots or more whose mean values vary by more
    than a tenth. Drift is two significant slopes or a season. snaps has user_id, snapshot (a date), key, value.
    """
    w = W.partitionBy("user_id")
    own = snaps.withColumn("_x", F.dense_rank().over(w.orderBy("snapshot")) - 1).withColumn("_n", F.max("_x").over(w) + 1).filter(F.col("_n") >= least)
    n = F.col("n").cast("double")
    s = own.groupBy("user_id", "key").agg(F.max("_n").alias("n"), F.sum("value").alias("y"), F.sum(F.col("value") * F.col("value")).alias("yy"), F.sum(F.col("_x") * F.col("value")).alias("xy"))
    sxx = n * (n * n - 1) / 12
    sxy, syy = F.col("xy") - (n - 1) / 2 * F.col("y"), F.col("yy") - F.col("y") * F.col("y") / n
    line = s.select("user_id", "key", "n", F.round(sxy / sxx, 9).alias("slope"), ratio(sxy * sxy, sxx * syy).alias("r2"))
    t = F.sqrt(F.col("r2") * (n - 2) / F.greatest(1 - F.col("r2"), F.lit(1e-12)))
    line = line.withColumn("p", F.when(F.col("r2").isNotNull(), normal_two_sided(student_as_normal(t, n - 2))))
    rising = (F.abs("slope") > 0.01) & (F.col("p") < 0.1)
    a = line.groupBy("user_id").agg(F.count(F.lit(1)).alias("keys"), F.count_if((F.abs("slope") > 0.05) & (F.col("p") < 0.05)).alias("significant"), F.avg(F.when(rising, F.abs("slope"))).alias("mean"))
    means = own.filter(F.col("_n") >= weeks).groupBy("user_id", "snapshot").agg(F.avg("value").alias("m"))
    days = means.groupBy("user_id", F.weekday("snapshot").alias("day")).agg(F.avg("m").alias("m"), F.count(F.lit(1)).alias("c")).filter("c >= 3")
    season = days.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"), ratio(F.stddev_pop("m"), F.avg("m"), 0.0).alias("cv")).select("user_id", ((F.col("c") >= 5) & (F.col("cv") > 0.1)).alias("seasonal"))
    out = a.join(season, "user_id", "left").withColumn("seasonal", F.coalesce("seasonal", F.lit(False)))
    hit = (F.col("significant") >= 2) | F.col("seasonal")
    out = out.withColumn("drifted", hit).withColumn("type", F.when(hit, F.when(F.col("seasonal"), "seasonal").otherwise("gradual")))
    confidence = F.least(F.lit(1.0), F.col("significant") / F.col("keys") + F.when(F.col("seasonal"), 0.3).otherwise(0.0))
    return out.select("user_id", "keys", "significant", "seasonal", "drifted", "type", F.when(hit, confidence).alias("confidence"), F.when(hit, F.least(F.lit(1.0), F.coalesce("mean", F.lit(0.0)))).alias("severity"))
