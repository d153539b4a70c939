"""Engagement, periods, snapshots and drift of users over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio, top
from .preferences import ks


def session_quality(sessions: DataFrame, least: int = 2) -> DataFrame:
    """user_id, session and the four parts of its quality with their mean: density (events a minute over 2, 1 at most), share of distinct items, share of rated events, length (best from 20 to 60 minutes)."""
    a = sessions.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.count("rating").alias("rated"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 6e7).alias("minutes"))
    m = F.col("minutes")
    a = a.filter(F.col("n") >= least).select(
        "user_id", "session",
        F.least(F.lit(1.0), F.when(m > 0, F.col("n") / m / 2).otherwise(1.0)).alias("density"),
        (F.col("items") / F.col("n")).alias("distinct_share"),
        (F.col("rated") / F.col("n")).alias("rated_share"),
        F.when(m < 20, m / 20).when(m <= 60, 1.0).otherwise(60 / m).alias("length"),
    )
    return a.withColumn("quality", (F.col("density") + F.col("distinct_share") + F.col("rated_share") + F.col("length")) / 4)


def engagement(metrics: DataFrame, interactions: DataFrame) -> DataFrame:
    """user_id, engagement: the mean of session quality, weekly frequency (1 at most), share of distinct items, share of rated events, and regularity of the whole days between sessions (left out for one session)."""
    gap = F.floor((F.unix_micros("start_ts") - F.unix_micros(F.lag("end_ts").over(W.partitionBy("user_id").orderBy("start_ts", "session")))) / 86_400_000_000)
    days = F.datediff(F.max("end_ts"), F.min("start_ts")) + 1
    s = metrics.withColumn("gap", gap).groupBy("user_id").agg(F.avg("quality").alias("quality"), F.least(F.lit(1.0), 7 * F.count(F.lit(1)) / days).alias("frequency"), (1 / (1 + F.stddev_pop("gap") / 7)).alias("regularity"))
    i = interactions.groupBy("user_id").agg((F.countDistinct("item_id") / F.count(F.lit(1))).alias("diversity"), F.avg((F.coalesce("rating", F.lit(0.0)) > 0).cast("double")).alias("rated"))
    parts = F.filter(F.array("quality", "frequency", "diversity", "rated", "regularity"), lambda x: x.isNotNull())
    return s.join(i, "user_id").select("user_id", (F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).alias("engagement"))


def periods(interactions: DataFrame, least: int = 5) -> DataFrame:
    """Interactions with period and length: each user's history cut into periods of 30 days where it spans 90 at most, of 60 up to 365, else of 90. A period ends with its last whole day, and those of fewer than `least` events are left out."""
    w = W.partitionBy("user_id")
    own = interactions.withColumn("_first", F.min("ts").over(w)).withColumn("_span", F.floor((F.unix_micros(F.max("ts").over(w)) - F.unix_micros("_first")) / 86_400_000_000))
    own = own.withColumn("length", F.when(F.col("_span") <= 90, 30).when(F.col("_span") <= 365, 60).otherwise(90))
    # the next period starts a day after the last one's end
    own = own.withColumn("period", F.floor((F.unix_micros("ts") - F.unix_micros("_first")) / (86_400_000_000 * (F.col("length") + 1))).cast("int"))
    return own.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("user_id", "period"))).filter(F.col("_n") >= least).drop("_first", "_span", "_n")


def period_metrics(cut: DataFrame) -> DataFrame:
    """user_id, period, n, items, mean, deviation, hour_deviation, level (low to 10 events, medium to 50, high), stability: the mean of 1 less the variation of ratings and 1 less the deviation of hours over 12, both 0 at least."""
    a = cut.groupBy("user_id", "period").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("deviation"), F.stddev_pop(F.hour("ts")).alias("hour_deviation"))
    level = F.when(F.col("n") <= 10, "low").when(F.col("n") <= 50, "medium").otherwise("high")
    low = lambda x: F.greatest(F.lit(0.0), 1 - x)
    return a.withColumn("level", level).withColumn("stability", (low(F.col("deviation") / F.col("mean")) + low(F.col("hour_deviation") / 12)) / 2)


def period_changes(metrics: DataFrame, engagement: str = "stability", shift: float = 0.2) -> DataFrame:
    """user_id, period, changes: against the user's previous period, shifts of engagement above 0.2 and changes of level; `initial_period` and `stable_period` where there is nothing to name."""
    w = W.partitionBy("user_id").orderBy("period")
    number = F.when(F.col("level") == "low", 1).when(F.col("level") == "high", 3).otherwise(2)
    m = metrics.withColumn("_d", F.col(engagement) - F.lag(engagement).over(w)).withColumn("_l", number).withColumn("_up", F.col("_l") - F.lag("_l").over(w)).withColumn("_i", F.row_number().over(w))
    named = F.filter(F.array(F.when(F.col("_d") > shift, "engagement_shift").when(F.col("_d") < -shift, "engagement_decline"), F.when(F.col("_up") > 0, "activity_increase").when(F.col("_up") < 0, "activity_decrease")), lambda x: x.isNotNull())
    return m.select("user_id", "period", F.when(F.col("_i") == 1, "initial_period").when(F.size(named) == 0, "stable_period").otherwise(F.array_join(named, ",")).alias("changes"))


def signed_preferences(interactions: DataFrame, content: DataFrame, least: int = 2) -> DataFrame:
    """user_id, kind (genre or type), value, preference (mean of (rating - 2.5) / 2.5), n; those of fewer than `least` events are left out."""
    own = interactions.select("user_id", F.col("item_id").alias("content_id"), ((F.col("rating") - 2.5) / 2.5).alias("x")).join(content.select("content_id", "genres", "content_type"), "content_id")
    names = F.concat(F.transform("genres", lambda g: F.struct(F.lit("genre").alias("kind"), F.lower(F.trim(g)).alias("value"))), F.array(F.struct(F.lit("type").alias("kind"), F.col("content_type").alias("value"))))
    rows = own.select("user_id", "x", F.inline(names)).filter("value is not null and value <> ''")
    return rows.groupBy("user_id", "kind", "value").agg(F.avg("x").alias("preference"), F.count("x").alias("n")).filter(F.col("n") >= least)


def preference_confidence(prefs: DataFrame, enough: int = 5) -> DataFrame:
    """prefs with confidence: 0.7 of the count over `enough`, 0.3 of the strength, each 1 at most."""
    return prefs.withColumn("confidence", 0.7 * F.least(F.lit(1.0), F.col("n") / enough) + 0.3 * F.least(F.lit(1.0), F.abs("preference")))


def preference_growth(snaps: DataFrame, last: int = 5, least: float = 0.1) -> DataFrame:
    """user_id, key, change, direction: the mean over the user's last `last` snapshots less that over the ones before (absent keys count 0), where it exceeds `least`. snaps has user_id, snapshot, key, value."""
    order = F.dense_rank().over(W.partitionBy("user_id").orderBy(F.desc("snapshot")))
    s = snaps.withColumn("_k", order).filter(F.col("_k") <= 2 * last)
    counts = s.groupBy("user_id").agg(F.max("_k").alias("_n"))
    sums = s.groupBy("user_id", "key").agg(F.coalesce(F.sum(F.when(F.col("_k") <= last, F.col("value"))), F.lit(0.0)).alias("new"), F.coalesce(F.sum(F.when(F.col("_k") > last, F.col("value"))), F.lit(0.0)).alias("old"))
    out = sums.join(counts, "user_id").filter(F.col("_n") > last)
    out = out.withColumn("change", F.col("new") / last - F.col("old") / (F.col("_n") - last)).filter(F.abs("change") > least)
    return out.select("user_id", "key", "change", F.when(F.col("change") > 0, "growing").otherwise("declining").alias("direction"))


def context_preferences(interactions: DataFrame, contexts: dict[str, Column]) -> DataFrame:
    """user_id, context, value, weight: the sum of rating / 5 (1 where there is no rating) for each value of each context."""
    named = F.array(*[F.struct(F.lit(k).alias("context"), v.cast("string").alias("value")) for k, v in contexts.items()])
    rows = interactions.select("user_id", F.coalesce(F.col("rating") / 5, F.lit(1.0)).alias("w"), F.inline(named)).filter("value is not null")
    return rows.groupBy("user_id", "context", "value").agg(F.sum("w").alias("weight"))


def confidence_trend(scores: DataFrame, key: str, order: list[str], last: int = 100, least: int = 10) -> DataFrame:
    """key, n, mean, slope and trend (beyond 0.01 a step) of the last scores; `insufficient_data` below `least`."""
    w = W.partitionBy(key)
    own = scores.withColumn("_k", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).filter(F.col("_k") <= last)
    a = own.groupBy(key).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), (-F.regr_slope("score", F.col("_k").cast("double"))).alias("slope"))
    trend = F.when(F.col("n") < least, "insufficient_data").when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable")
    return a.withColumn("trend", trend)


def behaviour_drift(interactions: DataFrame, order: list[str], least: int = 10) -> DataFrame:
    """user_id, ks, frequency_change, confidence: the KS distance of the seconds between events in both halves of a history, and the change of events a day; confidence is the larger, 1 at most. Shorter histories are left out."""
    w = W.partitionBy("user_id").orderBy(*order)
    all_ = W.partitionBy("user_id")
    own = interactions.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(all_)).filter(F.col("_n") >= least)
    own = own.withColumn("second", F.col("_i") > F.floor(F.col("_n") / 2)).withColumn("gap", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6)
    # the first event of each half has no gap inside it
    gaps = own.filter((F.col("_i") != 1) & (F.col("_i") != F.floor(F.col("_n") / 2) + 1))
    a = own.groupBy("user_id", "second").agg((F.count(F.lit(1)) / (F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000) + 1)).alias("f"))
    f = a.groupBy("user_id").agg(F.max(F.when(~F.col("second"), F.col("f"))).alias("f1"), F.max(F.when(F.col("second"), F.col("f"))).alias("f2"))
    change = F.abs(F.col("f2") - F.col("f1")) / (F.greatest("f1", "f2") + 1e-8)
    out = ks(gaps, ["user_id"], "gap", "second").join(f.select("user_id", change.alias("frequency_change")), "user_id")
    return out.select("user_id", "ks", "frequency_change", F.least(F.lit(1.0), F.greatest("ks", "frequency_change")).alias("confidence"))


def combined_drift(detections: DataFrame, limit: float = 0.3) -> DataFrame:
    """user_id, confidence (the largest), kind (of it, the smallest name of equals), drifted, from rows of user_id, kind, confidence."""
    a = detections.groupBy("user_id").agg(F.max("confidence").alias("confidence"), F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("x"))
    return a.select("user_id", "confidence", F.col("x.kind").alias("kind"), (F.col("confidence") > limit).alias("drifted"))


def drift_history(drifts: DataFrame) -> DataFrame:
    """user_id, frequency, mean_hours between drifts, pattern: single_drift, rapid_drift under a day, frequent_drift under a week, else gradual_drift."""
    a = drifts.groupBy("user_id").agg(F.count(F.lit(1)).alias("frequency"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span"))
    hours = F.when(F.col("frequency") > 1, F.col("span") / 3.6e9 / (F.col("frequency") - 1))
    pattern = F.when(F.col("frequency") == 1, "single_drift").when(F.col("mean_hours") < 24, "rapid_drift").when(F.col("mean_hours") < 168, "frequent_drift").otherwise("gradual_drift")
    return a.withColumn("mean_hours", hours).select("user_id", "frequency", "mean_hours", pattern.alias("pattern"))


def adaptation_statistics(history: DataFrame, as_of: Column) -> DataFrame:
    """user_id, kind, action, n, and for the user: total, initiated_percentage, hours_since_last."""
    user = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), (100 * F.avg(F.col("user_initiated").cast("double"))).alias("initiated_percentage"), ((F.unix_micros(as_of) - F.unix_micros(F.max("ts"))) / 3.6e9).alias("hours_since_last"))
    return history.groupBy("user_id", "kind", "action").agg(F.count(F.lit(1)).alias("n")).join(user, "user_id")


def confidence_drift(scores: DataFrame, order: list[str], last: int = 20) -> DataFrame:
    """user_id, slope, r, severity (ten times the slope, 1 at most), drifted: a slope beyond 0.01 that is significant at 5 % over the last `last` values.

    Significance compares r * r * (n - 2) / (1 - r * r) with 4.414, the square of the 97.5 % point of Student's t for 18 degrees of freedom, so only full windows are judged.
    """
    own = scores.withColumn("_k", F.row_number().over(W.partitionBy("user_id").orderBy(*[F.desc(c) for c in order]))).filter(F.col("_k") <= last).withColumn("_k", -F.col("_k").cast("double"))
    a = own.groupBy("user_id").agg(F.count("score").alias("n"), F.regr_slope("score", "_k").alias("slope"), ratio(F.covar_pop("score", "_k"), F.stddev_pop("score") * F.stddev_pop("_k")).alias("r")).filter(F.col("n") == last)
    t2 = F.col("r") * F.col("r") * (last - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-12))
    return a.select("user_id", "slope", "r", F.least(F.lit(1.0), 10 * F.abs("slope")).alias("severity"), F.coalesce((F.abs("slope") > 0.01) & (t2 > 4.414), F.lit(False)).alias("drifted"))


def preference_change_trends(changes: DataFrame, as_of: Column, days: int = 30, n: int = 5, least: float = 0.2) -> DataFrame:
    """user_id, total_changes, n_new, n_removed, trending_up, trending_down, change_frequency of changes (user_id, feature, old_value, new_value, ts, id) in the last days.

    A change without an old value is new, else one without a new value is
    removed; others trend if they move by more than `least`. The lists hold the
    features of the n largest moves, comma-joined, ties to the earlier change.
    """
    own = changes.filter(F.col("ts") > as_of - F.expr(f"interval {days} days"))
    move = F.round(F.col("new_value") - F.col("old_value"), 9)
    kind = F.when(F.col("old_value").isNull(), "new").when(F.col("new_value").isNull(), "removed").when(move > least, "up").when(move < -least, "down")
    own = own.withColumn("kind", kind).withColumn("size", F.abs(move))
    totals = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_changes"), F.count_if(F.col("kind") == "new").alias("n_new"), F.count_if(F.col("kind") == "removed").alias("n_removed"))
    first = top(own.filter("kind in ('up', 'down')"), ["user_id", "kind"], [F.desc("size"), F.col("ts"), F.col("id")], n)
    # n rows a list
    lists = first.groupBy("user_id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "feature")))), lambda x: x["feature"]), ",").alias(f"trending_{k}") for k in ("up", "down")])
    out = totals.join(lists.hint("merge"), "user_id", "left")
    return out.select("user_id", "total_changes", "n_new", "n_removed", *[F.coalesce(f"trending_{k}", F.lit("")).alias(f"trending_{k}") for k in ("up", "down")], (F.col("total_changes") / days).alias("change_frequency"))


def evolution_state(history: DataFrame, trends: DataFrame, n: int = 5) -> DataFrame:
    """user_id, stability, exploration, velocity, dominant, emerging, declining from histories (user_id, feature, ts, id, value) and trends (user_id, feature, trend, slope, confidence, strength).

    Stability is the mean over features with more than ten values of 1 less the
    deviation, 1 at most, of the last ten; exploration, for users of several
    features, the deviation of their last values, 1 at most; velocity the mean
    absolute slope. The lists hold the first n features by name.
    """
    own = history.withColumn("all", F.count(F.lit(1)).over(W.partitionBy("user_id", "feature")))
    last = top(own, ["user_id", "feature"], [F.desc("ts"), F.desc("id")], 10)
    each = last.groupBy("user_id", "feature").agg((1 - F.least(F.stddev_pop("value"), F.lit(1.0))).alias("s"), F.first("all").alias("all"), F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("v"))
    state = each.groupBy("user_id").agg(F.avg(F.when(F.col("all") > 10, F.col("s"))).alias("stability"), F.when(F.count(F.lit(1)) > 1, F.least(F.stddev_pop("v"), F.lit(1.0))).alias("exploration"))
    speed = trends.groupBy("user_id").agg(F.avg(F.abs("slope")).alias("velocity"))
    tests = {"dominant": (F.col("confidence") > 0.7) & (F.col("strength") > 0.5), "emerging": (F.col("trend") == "increasing") & (F.col("confidence") > 0.6), "declining": (F.col("trend") == "decreasing") & (F.col("confidence") > 0.6)}
    out = state.join(speed.hint("merge"), "user_id", "left")
    for name, test in tests.items():
        names = top(trends.filter(test), ["user_id"], [F.col("feature")], n).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias(name))
        out = out.join(names.hint("merge"), "user_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def explanation_components(adaptations: DataFrame, least: float = 0.1, n: int = 5) -> DataFrame:
    """user_id, type, importance, confidence, evidence, rank: what explains an adaptation, the n most important of `least` or more, ties in the order of the rules.

    Adaptations have user_id and, each null where not known, importance and
    changes (maps from feature to number), temporal (a pattern's name), drift
    and collaborative (booleans), exploration (a number). Evidence names the
    three most important features, or the changed ones by name.
    """
    entries = lambda c: F.map_entries(F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))
    ranked = F.slice(F.array_sort(F.transform(entries("importance"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k")))), 1, 3)
    strongest = F.array_join(F.transform(ranked, lambda x: x["k"]), ",")
    changed = F.array_join(F.array_sort(F.transform(F.filter(entries("changes"), lambda e: F.abs(e["value"]) > 0.2), lambda e: e["key"])), ",")
    # fixed values: type, importance, confidence, evidence, condition
    rules = [
        ("feature_importance", F.lit(0.8), 0.9, strongest, strongest != ""),
        ("preference_change", F.lit(0.9), 0.85, changed, changed != ""),
        ("temporal_pattern", F.lit(0.6), 0.7, F.col("temporal"), F.col("temporal").isNotNull()),
        ("drift_adaptation", F.lit(0.7), 0.8, F.lit("drift"), F.coalesce("drift", F.lit(False))),
        ("collaborative_signal", F.lit(0.5), 0.6, F.lit("similar users"), F.coalesce("collaborative", F.lit(False))),
        ("exploration_exploitation", F.col("exploration"), 0.7, F.lit("exploration"), F.coalesce(F.col("exploration") > 0.3, F.lit(False))),
    ]
    parts = [F.when(test, F.struct(F.lit(k).alias("place"), F.lit(name).alias("type"), importance.cast("double").alias("importance"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))) for k, (name, importance, confidence, evidence, test) in enumerate(rules)]
    each = adaptations.select("user_id", F.inline(F.array_compact(F.array(*parts)))).filter(F.col("importance") >= least)
    return top(each, ["user_id"], [F.desc("importance"), F.col("place")], n).drop("place")


def behavior_compare(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, engagement_similarity, consistency_similarity, pattern_overlap, activity_similarity, overall_similarity, shared, only_a, only_b for pairs (a, b) of users with profiles (user_id, engagement, consistency, level, patterns).

    Scores are compared by 1 less their difference, patterns by their Jaccard
    similarity (0 without any), levels by 1 if equal, else 0.5; null scores and
    patterns count as 0 and none. Lists of patterns are sorted and comma-joined.
    """
    def side(x: str) -> DataFrame:
        patterns = F.array_distinct(F.coalesce("patterns", F.array().cast("array<string>")))
        return profiles.select(F.col("user_id").alias(x), F.coalesce("engagement", F.lit(0.0)).alias(f"e{x}"), F.coalesce("consistency", F.lit(0.0)).alias(f"c{x}"), F.col("level").alias(f"l{x}"), patterns.alias(f"p{x}"))

    own = pairs.select("a", "b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    names = lambda c: F.array_join(F.array_sort(c), ",")
    out = own.select(
        "a", "b",
        (1 - F.abs(F.col("ea") - F.col("eb"))).alias("engagement_similarity"),
        (1 - F.abs(F.col("ca") - F.col("cb"))).alias("consistency_similarity"),
        ratio(F.size(F.array_intersect("pa", "pb")), F.size(F.array_union("pa", "pb")), 0.0).alias("pattern_overlap"),
        F.when(F.col("la").eqNullSafe(F.col("lb")), 1.0).otherwise(0.5).alias("activity_similarity"),
        names(F.array_intersect("pa", "pb")).alias("shared"), names(F.array_except("pa", "pb")).alias("only_a"), names(F.array_except("pb", "pa")).alias("only_b"),
    )
    parts = [F.col(c) for c in ("engagement_similarity", "consistency_similarity", "pattern_overlap", "activity_similarity")]
    return out.withColumn("overall_similarity", sum(parts[1:], parts[0]) / 4)
