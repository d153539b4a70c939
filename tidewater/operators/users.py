"""Features of users and of their interactions, sessions and behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import as_of, ratio, top, with_percentile


def user_activity(interactions: DataFrame) -> DataFrame:
    """user_id, n, mean and deviation of ratings, span in days, events a day, level (10, 50, 200), generous and harsh raters, consistency 1 / (1 + deviation)."""
    a = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("deviation"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days"))
    level = F.when(F.col("n") <= 10, "low").when(F.col("n") <= 50, "medium").when(F.col("n") <= 200, "high").otherwise("very_high")
    return a.select("user_id", "n", "mean", "deviation", "days", (F.col("n") / F.col("days")).alias("per_day"), level.alias("level"), (F.col("mean") >= 4).alias("generous"), (F.col("mean") <= 2).alias("harsh"), (1 / (1 + F.col("deviation"))).alias("consistency"))


def user_content_preferences(interactions: DataFrame, content: DataFrame, n: int = 3) -> DataFrame:
    """user_id, genres (the n most frequent, by count then name), genre_count, mean_duration, high_share (ratings of 4 or more)."""
    both = interactions.join(content.select(F.col("content_id").alias("item_id"), "genres", "duration"), "item_id")
    each = both.select("user_id", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("c"))
    first = top(each, ["user_id"], [F.desc("c"), F.col("genre")], n).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "genre"))), lambda x: x["genre"]), ",").alias("genres"))
    counts = each.groupBy("user_id").agg(F.count(F.lit(1)).alias("genre_count"))
    means = both.groupBy("user_id").agg(F.avg("duration").alias("mean_duration"), F.avg((F.col("rating") >= 4).cast("double")).alias("high_share"))
    return first.join(counts, "user_id").join(means, "user_id")


def user_temporal_behavior(interactions: DataFrame) -> DataFrame:
    """user_id, modal hour and day (smallest on ties), shares of morning, evening, night and weekend, regularity 1 / (1 + deviation of daily counts)."""
    own = interactions.select("user_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("day"), F.to_date("ts").alias("date"))
    modal = []
    for c in ("hour", "day"):
        n = own.groupBy("user_id", c).agg(F.count(F.lit(1)).alias("n"))
        modal.append(n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), c)).alias("m")).select("user_id", F.col(f"m.{c}").alias(f"modal_{c}")))
    share = lambda c: F.avg(c.cast("double"))
    h = F.col("hour")
    shares = own.groupBy("user_id").agg(share((h >= 6) & (h < 12)).alias("morning"), share((h >= 18) & (h < 23)).alias("evening"), share((h >= 23) | (h < 6)).alias("night"), share(F.col("day") >= 5).alias("weekend"))
    daily = own.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg((1 / (1 + F.coalesce(F.stddev_samp("n"), F.lit(0.0)))).alias("regularity"))
    return modal[0].join(modal[1], "user_id").join(shares, "user_id").join(daily, "user_id")


def interaction_sequence(interactions: DataFrame) -> DataFrame:
    """event_id, its number among the user's events, hours since the last one, the rating before and the change."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("rating").over(w)
    hours = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 3.6e9
    return interactions.select("event_id", "user_id", F.row_number().over(w).alias("number"), hours.alias("hours_since"), before.alias("previous_rating"), (F.col("rating") - before).alias("rating_change"))


def user_item_history(interactions: DataFrame, new: int = 5) -> DataFrame:
    """event_id with user and item count and mean, rating less these means, popularity and activity percentiles, new user or item (`new` events at most)."""
    u = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_n"), F.avg("rating").alias("user_mean"), F.countDistinct("item_id").alias("user_items"))
    i = interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_n"), F.avg("rating").alias("item_mean"), F.countDistinct("user_id").alias("item_users"))
    u, i = with_percentile(u, "user_n", "activity"), with_percentile(i, "item_n", "popularity")
    both = interactions.select("event_id", "user_id", "item_id", "rating").join(u, "user_id", "left").join(i, "item_id", "left")
    return both.select("event_id", "user_n", "user_items", "item_n", "item_users", (F.col("rating") - F.col("user_mean")).alias("user_bias"), (F.col("rating") - F.col("item_mean")).alias("item_bias"), "activity", "popularity", (F.col("user_n") <= new).alias("new_user"), (F.col("item_n") <= new).alias("new_item"))


def user_item_matrix(interactions: DataFrame) -> DataFrame:
    """user_id, item_id, rating: ratings of a pair are summed."""
    return interactions.groupBy("user_id", "item_id").agg(F.sum("rating").alias("rating"))


def pairwise_similarity(matrix: DataFrame, entity: str = "user_id", over: str = "item_id", common: bool = True) -> DataFrame:
    """a, b, similarity: cosine of two entities' ratings over what both rated, or over all ratings where common is False; a < b.

    An inverted-index join: only entities that share a key meet.
    """
    x = matrix.select(F.col(entity).alias("a"), F.col(over).alias("k"), F.col("rating").alias("x"))
    y = matrix.select(F.col(entity).alias("b"), F.col(over).alias("k"), F.col("rating").alias("y"))
    dots = x.join(y, "k").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("shared"))
    if not common:
        norm = matrix.groupBy(entity).agg(F.sum(F.col("rating") * F.col("rating")).alias("q"))
        dots = dots.drop("xx", "yy").join(norm.select(F.col(entity).alias("a"), F.col("q").alias("xx")), "a").join(norm.select(F.col(entity).alias("b"), F.col("q").alias("yy")), "b")
    return dots.select("a", "b", "shared", ratio(F.col("dot"), F.sqrt(F.col("xx") * F.col("yy")), 0.0).alias("similarity"))


def similarity_features(pairs: DataFrame, n: int = 50) -> DataFrame:
    """id, the largest and the mean similarity and the number of its n most similar others."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    return top(both, ["id"], [F.desc("similarity"), F.col("other")], n).groupBy("id").agg(F.max("similarity").alias("highest"), F.avg("similarity").alias("mean"), F.count(F.lit(1)).alias("n"))


def feature_sets_union(interactions: DataFrame, sets: list[tuple[str, DataFrame]]) -> DataFrame:
    """Interactions with each feature set joined on its key; missing numbers become 0, missing texts 'unknown'."""
    out = interactions
    for key, features in sets:
        out = out.join(features, key, "left")
    numbers = [f.name for f in out.schema if f.dataType.typeName() in ("integer", "long", "double")]
    return out.fillna(0, numbers).fillna("unknown", [f.name for f in out.schema if f.dataType.typeName() == "string"])


def feature_correlation(df: DataFrame, target: str, columns: list[str], n: int = 20) -> DataFrame:
    """feature, correlation: those most correlated with the target, by absolute value."""
    one = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns])))
    return rows.filter(F.col("correlation").isNotNull()).orderBy(F.desc(F.abs("correlation")), "feature").limit(n)


def user_distribution(interactions: DataFrame) -> DataFrame:
    """activity (50, 10, 1), taste (mean of 4, 3), users."""
    a = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("m"))
    activity = F.when(F.col("n") >= 50, "high").when(F.col("n") >= 10, "medium").otherwise("low")
    taste = F.when(F.col("m") >= 4, "positive").when(F.col("m") >= 3, "neutral").otherwise("critical")
    return a.groupBy(activity.alias("activity"), taste.alias("taste")).agg(F.count(F.lit(1)).alias("users"))


def user_profile_summary(interactions: DataFrame, n: int = 3) -> DataFrame:
    """user_id, totals, distinct items, first and last time, top interaction types, diversity (distinct items over events)."""
    a = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("rating").alias("mean"))
    kinds = interactions.groupBy("user_id", "interaction_type").agg(F.count(F.lit(1)).alias("c"))
    best = top(kinds, ["user_id"], [F.desc("c"), F.col("interaction_type")], n).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "interaction_type"))), lambda x: x["interaction_type"]), ",").alias("types"))
    return a.join(best, "user_id").withColumn("diversity", F.col("items") / F.col("n"))


def sessionize(interactions: DataFrame, minutes: int = 30) -> DataFrame:
    """Adds session, the number of the user's session: a gap of more than the minutes starts a new one."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    start = F.when(gap > minutes * 60_000_000, 1).otherwise(0)
    return interactions.withColumn("_start", start).withColumn("session", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_start")


def session_metrics(sessions: DataFrame, least: int = 2) -> DataFrame:
    """user_id, session, start, end, minutes, n, items, types, mean rating, quality; sessions of fewer than `least` events are left out.

    quality is the mean of events a minute over 2 (1 at most), the share of
    distinct items, the share of rated events, and a length score that is best
    from 20 to 60 minutes.
    """
    a = sessions.groupBy("user_id", "session").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.countDistinct("interaction_type").alias("types"), F.avg("rating").alias("mean"), F.count("rating").alias("rated"))
    a = a.filter(F.col("n") >= least).withColumn("minutes", (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 6e7)
    m = F.col("minutes")
    density = F.least(F.lit(1.0), F.when(m > 0, F.col("n") / m / 2).otherwise(1.0))
    length = F.when(m < 20, m / 20).when(m <= 60, 1.0).otherwise(60 / m)
    return a.select("user_id", "session", "start_ts", "end_ts", "minutes", "n", "items", "types", "mean", ((density + F.col("items") / F.col("n") + F.col("rated") / F.col("n") + length) / 4).alias("quality"))


def session_frequency(metrics: DataFrame) -> DataFrame:
    """user_id, sessions, per_day over the span, mean minutes, level."""
    a = metrics.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), (F.datediff(F.max("end_ts"), F.min("start_ts")) + 1).alias("days"), F.avg("minutes").alias("mean_minutes"))
    per_day = F.col("sessions") / F.col("days")
    level = F.when((per_day >= 1) & (F.col("sessions") >= 10), "very_high").when(per_day >= 0.5, "high").when(per_day >= 0.2, "medium").otherwise("low")
    return a.select("user_id", "sessions", per_day.alias("per_day"), "mean_minutes", level.alias("level"))


def consistency(metrics: DataFrame, least: int = 3) -> DataFrame:
    """user_id, consistency: the mean of 1 less the variation of minutes and counts (0 at least) and 1 less the deviation of start hours over 12; 0.5 for fewer sessions."""
    a = metrics.groupBy("user_id").agg(F.count(F.lit(1)).alias("s"), F.avg("minutes").alias("mm"), F.stddev_pop("minutes").alias("sm"), F.avg("n").alias("mn"), F.stddev_pop("n").alias("sn"), F.stddev_pop(F.hour("start_ts")).alias("sh"))
    part = lambda s, m: F.greatest(F.lit(0.0), 1 - ratio(F.col(s), F.col(m), 0.0))
    score = (part("sm", "mm") + part("sn", "mn") + F.greatest(F.lit(0.0), 1 - F.col("sh") / 12)) / 3
    return a.select("user_id", F.when(F.col("s") < least, 0.5).otherwise(score).alias("consistency"))


def behavior_patterns(sessions: DataFrame) -> DataFrame:
    """user_id, pattern, frequency, confidence: binge (5 events or more), quick (2 or fewer), weekend, evening sessions, and explorers (sessions of all distinct items).

    A pattern is reported from 2 sessions and a fifth of all on.
    """
    s = sessions.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.min("ts").alias("start_ts"))
    rules = {"binge": F.col("n") >= 5, "quick": F.col("n") <= 2, "weekend": F.weekday("start_ts") >= 5, "evening": F.hour("start_ts") >= 18, "explorer": (F.col("items") == F.col("n")) & (F.col("n") >= 2)}
    a = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in rules.items()])
    rows = a.select("user_id", "total", F.inline(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(k).alias("frequency")) for k in rules])))
    return rows.filter((F.col("frequency") >= F.greatest(F.lit(2.0), 0.2 * F.col("total")))).select("user_id", "pattern", "frequency", (F.col("frequency") / F.col("total")).alias("confidence"))


def unusual_hours(interactions: DataFrame, share: float = 0.1, least: int = 10) -> DataFrame:
    """user_id, hour, n: hours that hold a tenth of the user's events or less, for users with enough events."""
    n = interactions.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("user_id"))
    return n.withColumn("total", total).filter((F.col("total") >= least) & (F.col("n") <= share * F.col("total"))).select("user_id", "hour", "n")


def genre_preference_profile(interactions: DataFrame, content: DataFrame, when: str | None = None, least: int = 2) -> DataFrame:
    """user_id, genre, score (mean of (rating - 1) / 4 weighted by exp(-0.1 * years)), confidence n / (n + 5), n."""
    own = as_of(interactions, when).join(content.select(F.col("content_id").alias("item_id"), "genres"), "item_id")
    each = own.select("user_id", "rating", F.exp(-0.1 * F.datediff("as_of", "ts") / 365).alias("w"), F.explode(F.array_distinct("genres")).alias("genre"))
    a = each.groupBy("user_id", "genre").agg((F.sum(F.col("w") * (F.col("rating") - 1) / 4) / F.sum("w")).alias("score"), F.count(F.lit(1)).alias("n"))
    return a.filter(F.col("n") >= least).select("user_id", "genre", "score", (F.col("n") / (F.col("n") + 5)).alias("confidence"), "n")


def preference_trend(interactions: DataFrame, days: int = 90, when: str | None = None) -> DataFrame:
    """user_id, recent and older mean rating, trend: increasing or decreasing if they differ by more than 0.5."""
    own = as_of(interactions, when).withColumn("new", F.col("ts") >= F.col("as_of") - F.expr(f"interval {days} days"))
    a = own.groupBy("user_id").agg(F.avg(F.when(F.col("new"), F.col("rating"))).alias("recent"), F.avg(F.when(~F.col("new"), F.col("rating"))).alias("older"))
    d = F.col("recent") - F.col("older")
    return a.select("user_id", "recent", "older", F.when(d.isNull(), "unknown").when(d > 0.5, "increasing").when(d < -0.5, "decreasing").otherwise("stable").alias("trend"))


def rating_tendencies(interactions: DataFrame) -> DataFrame:
    """user_id, mean, deviation, range, harshness (5 - mean) / 4, consistency, shares of high (4 on) and low (to 2) ratings."""
    a = interactions.groupBy("user_id").agg(F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("deviation"), (F.max("rating") - F.min("rating")).alias("range"), F.avg((F.col("rating") >= 4).cast("double")).alias("high"), F.avg((F.col("rating") <= 2).cast("double")).alias("low"))
    return a.withColumn("harshness", (5 - F.col("mean")) / 4).withColumn("consistency", 1 / (1 + F.col("deviation")))


def type_preferences(interactions: DataFrame, content: DataFrame, least: int = 2) -> DataFrame:
    """user_id, content_type, score: (mean - 1) / 4 times n / 10, 1 at most."""
    a = interactions.join(content.select(F.col("content_id").alias("item_id"), "content_type"), "item_id").groupBy("user_id", "content_type").agg(F.avg("rating").alias("m"), F.count(F.lit(1)).alias("n"))
    return a.filter(F.col("n") >= least).select("user_id", "content_type", "n", ((F.col("m") - 1) / 4 * F.least(F.lit(1.0), F.col("n") / 10)).alias("score"))


def activity_calendar(interactions: DataFrame, n: int = 3) -> DataFrame:
    """user_id, hours (the n most active, by count then hour), daily mean and largest count, active days."""
    hours = interactions.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    best = top(hours, ["user_id"], [F.desc("c"), F.col("hour")], n).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hour"))), lambda x: x["hour"].cast("string")), ",").alias("hours"))
    days = interactions.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("c")).groupBy("user_id").agg(F.avg("c").alias("daily_mean"), F.max("c").alias("daily_max"), F.count(F.lit(1)).alias("active_days"))
    return best.join(days, "user_id")


def diversity_exploration(interactions: DataFrame, content: DataFrame) -> DataFrame:
    """user_id, diversity (distinct genres over events, 1 at most), exploration (share of events with a genre not seen before, doubled, 1 at most)."""
    own = interactions.join(content.select(F.col("content_id").alias("item_id"), "genres"), "item_id").select("user_id", "event_id", "ts", F.explode("genres").alias("genre"))
    first = own.groupBy("user_id", "genre").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    new = first.groupBy("user_id").agg(F.count(F.lit(1)).alias("genres"), F.countDistinct("f").alias("new"))
    total = own.groupBy("user_id").agg(F.countDistinct("event_id").alias("events"))
    both = new.join(total, "user_id")
    return both.select("user_id", F.least(F.lit(1.0), F.col("genres") / F.col("events")).alias("diversity"), F.least(F.lit(1.0), 2 * F.col("new") / F.col("events")).alias("exploration"))
