"""Feedback signals, confidence, adaptation decisions and explanation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import as_of, clip, ratio, top


def normalised_rating(value: Column, scale: Column) -> Column:
    """A rating of a named scale between 0 and 1; null for unknown scales."""
    return F.when(scale == "1-5", clip((value - 1) / 4, 0.0, 1.0)).when(scale == "1-10", clip((value - 1) / 9, 0.0, 1.0)).when(scale == "0-100", clip(value / 100, 0.0, 1.0)).when(scale == "thumbs", F.when(value > 0, 1.0).otherwise(0.0))


def implicit_rating(signals: DataFrame) -> DataFrame:
    """Adds implicit_rating: 0.5, plus 0.3 of (completion - 0.5) and 0.2 of (watched over whole time - 0.5), 0.1 for each positive and -0.2 for each negative signal, between 0 and 1."""
    part = lambda c, w: F.coalesce((c - 0.5) * w, F.lit(0.0))
    score = 0.5 + part(F.col("completion"), 0.3) + part(F.least(F.lit(1.0), ratio(F.col("watched"), F.col("duration"))), 0.2) + 0.1 * F.coalesce(F.col("positives"), F.lit(0)) - 0.2 * F.coalesce(F.col("negatives"), F.lit(0))
    return signals.withColumn("implicit_rating", clip(score, 0.0, 1.0))


def valence(feedback: DataFrame) -> DataFrame:
    """Adds valence (-2 to 2) by kind and value (0 to 1), and confidence by kind."""
    v = F.when(F.col("value") >= 0.8, 2).when(F.col("value") >= 0.6, 1).when(F.col("value") > 0.4, 0).when(F.col("value") > 0.2, -1).otherwise(-2)
    own = F.when(F.col("kind") == "skip", -1).when(F.col("kind") == "like", 1).when(F.col("value").isNotNull(), v).otherwise(0)
    sure = F.when(F.col("kind") == "rating", 1.0).when(F.col("kind") == "like", 0.9).when(F.col("kind") == "skip", 0.6).otherwise(0.5)
    return feedback.withColumns({"valence": own, "confidence": sure})


def implicit_classes(signals: DataFrame) -> DataFrame:
    """Adds class (skip, view, click or search) and confidence, the mean of those of the signals that are there."""
    kind = F.when(F.col("query").isNotNull(), "search").when(F.col("completion") < 0.1, "skip").when(F.col("completion").isNotNull(), "view").otherwise("click")
    sure = F.array_compact(F.array(F.when(F.col("completion").isNotNull(), 0.8), F.when(F.col("watched").isNotNull(), 0.7), F.when(F.col("query").isNotNull(), 0.6)))
    return signals.withColumns({"class": kind, "confidence": F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure)).otherwise(0.5)})


def validated(signals: DataFrame) -> DataFrame:
    """Adds reject: bad_rating (0 to 5), bad_duration (0 to a day), bad_completion (0 to 1), no_user, or null."""
    bad = lambda c, low, high: ~F.col(c).between(low, high)
    return signals.withColumn("reject", F.when(F.col("user_id").isNull(), "no_user").when(bad("rating", 0, 5), "bad_rating").when(bad("duration", 0, 86_400), "bad_duration").when(bad("completion", 0, 1), "bad_completion"))


def context_signals(events: DataFrame, groups: list[str]) -> DataFrame:
    """event_id, signal, value: a row for each column of the groups that is there."""
    return events.select("event_id", F.explode(F.array(*[F.struct(F.lit(g).alias("signal"), F.col(g).cast("string").alias("value")) for g in groups])).alias("x")).select("event_id", "x.*").filter("value is not null")


def feedback_summary(feedback: DataFrame, days: int = 30, when: str | None = None) -> DataFrame:
    """user_id, n, mean (weighted by confidence), positives, negatives, trend of the newer against the older half (0.3)."""
    own = as_of(feedback, when).filter(F.col("ts") >= F.col("as_of") - F.expr(f"interval {days} days"))
    w = W.partitionBy("user_id")
    newer = F.row_number().over(w.orderBy("ts", "event_id")) > F.floor(F.count(F.lit(1)).over(w) / 2)
    a = own.withColumn("newer", newer).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("valence") * F.col("confidence")) / F.sum("confidence")).alias("mean"), F.count_if(F.col("valence") > 0).alias("positives"), F.count_if(F.col("valence") < 0).alias("negatives"), (F.avg(F.when(F.col("newer"), F.col("valence"))) - F.avg(F.when(~F.col("newer"), F.col("valence")))).alias("d"))
    return a.select("user_id", "n", "mean", "positives", "negatives", F.when(F.col("d") > 0.3, "improving").when(F.col("d") < -0.3, "declining").otherwise("stable").alias("trend"))


def feedback_insights(feedback: DataFrame) -> DataFrame:
    """kind, n, mean confidence, share of positives, busiest hour (smallest on ties)."""
    hours = feedback.groupBy("kind", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    busy = hours.groupBy("kind").agg(F.min(F.struct((-F.col("c")).alias("c"), "hour")).alias("x")).select("kind", F.col("x.hour").alias("peak_hour"))
    a = feedback.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg((F.col("valence") > 0).cast("double")).alias("positive_share"))
    return a.join(busy, "kind")


def pairwise_wins(comparisons: DataFrame) -> DataFrame:
    """item_id, wins, losses, score (strength won less strength lost) of comparisons (item_a, item_b, preferred a or b, strength)."""
    won = F.when(F.col("preferred") == "a", 1).otherwise(-1)
    a = comparisons.select(F.col("item_a").alias("item_id"), won.alias("w"), "strength")
    b = comparisons.select(F.col("item_b").alias("item_id"), (-won).alias("w"), "strength")
    return a.unionByName(b).groupBy("item_id").agg(F.count_if(F.col("w") > 0).alias("wins"), F.count_if(F.col("w") < 0).alias("losses"), F.sum(F.col("w") * F.col("strength")).alias("score"))


def rated_explanations(ratings: DataFrame) -> DataFrame:
    """explanation_id, n, score: the mean of helpfulness, clarity and accuracy."""
    return ratings.groupBy("explanation_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("helpfulness") + F.col("clarity") + F.col("accuracy")) / 3).alias("score"))


def confidence(features: DataFrame) -> DataFrame:
    """Adds score 0.3 reliability + 0.3 certainty + 0.2 recency + 0.2 simplicity, its level, and its interval by 1.96 * sqrt(s (1 - s) / n)."""
    s = 0.3 * F.col("reliability") + 0.3 * F.col("certainty") + 0.2 * F.col("recency") + 0.2 * F.col("simplicity")
    out = features.withColumn("score", s)
    level = F.when(F.col("score") >= 0.8, "very_high").when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.4, "medium").when(F.col("score") >= 0.2, "low").otherwise("very_low")
    half = 1.96 * F.sqrt(F.greatest(F.lit(0.0), F.col("score") * (1 - F.col("score"))) / F.greatest(F.col("n"), F.lit(1)))
    return out.withColumns({"level": level, "low": clip(F.col("score") - half, 0.0, 1.0), "high": clip(F.col("score") + half, 0.0, 1.0)})


def drift_selected(results: DataFrame) -> DataFrame:
    """user_id, detector, severity, confidence: each user's detector result of the largest confidence times severity, ties to the first name."""
    return top(results.withColumn("by", F.round(F.col("confidence") * F.col("severity"), 9)), ["user_id"], [F.desc("by"), F.col("detector")], 1).select("user_id", "detector", "severity", "confidence")


def adaptation_plan(drifts: DataFrame) -> DataFrame:
    """Adds strategy, rate, steps and priority (0 to 100) by severity, confidence and the number of the user's earlier adaptations."""
    s = F.col("severity")
    strategy = F.when((s >= 0.7) & (F.col("confidence") >= 0.7), "immediate").when(s >= 0.4, "gradual").when(s >= 0.2, "conservative").otherwise("monitor")
    rate = F.when(s >= 0.7, 0.1).when(s >= 0.4, 0.05).otherwise(0.01) / (1 + 0.1 * F.coalesce(F.col("earlier"), F.lit(0)))
    steps = F.when(s >= 0.7, 1).when(s >= 0.4, 5).otherwise(10)
    return drifts.withColumns({"strategy": strategy, "rate": rate, "steps": steps, "priority": F.least(F.lit(100.0), 100 * (0.6 * s + 0.4 * F.col("confidence")))})


def rollback(metrics: DataFrame, drop: float = 0.05, least: float = 0.35) -> DataFrame:
    """Adds rollback: the ndcg after falls by more than `drop` from that before, or lies under `least`."""
    return metrics.withColumn("rollback", (F.col("before") - F.col("after") > drop) | (F.col("after") < least))


def bandit_weights(rewards: DataFrame, temperature: float = 1.0) -> DataFrame:
    """arm, n, mean reward, softmax weight."""
    a = rewards.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean"))
    e = F.exp(F.col("mean") / temperature)
    return a.withColumn("e", e).select("arm", "n", "mean", (F.col("e") / F.sum("e").over(W.partitionBy())).alias("weight"))


def factor_scores(users: DataFrame, items: DataFrame, pairs: DataFrame, mean: float) -> DataFrame:
    """user_id, item_id, score: the mean rating plus both biases and the dot product of the factors, between 0 and 5."""
    both = pairs.join(users, "user_id").join(items, "item_id")
    dot = F.aggregate(F.zip_with("user_factors", "item_factors", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("user_id", "item_id", clip(mean + F.col("user_bias") + F.col("item_bias") + dot, 0.0, 5.0).alias("score"))


def online_profile(interactions: DataFrame, content: DataFrame, order: list[str], alpha: float = 0.3) -> DataFrame:
    """user_id, genre, preference: the exponentially moving mean of (rating - 2.5) / 2.5 over the user's events of the genre, by closed-form weights of the event's place from the last. Terms are summed as whole billionths, so that their order does not matter."""
    own = interactions.join(content.select(F.col("content_id").alias("item_id"), "genres"), "item_id").select("user_id", *order, ((F.col("rating") - 2.5) / 2.5).alias("x"), F.explode(F.array_distinct("genres")).alias("genre"))
    place = F.row_number().over(W.partitionBy("user_id", "genre").orderBy(*[F.desc(c) for c in order])) - 1
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("k"))
    return own.withColumn("k", place).groupBy("user_id", "genre").agg((F.sum(F.round(F.col("x") * weight * 1e9).cast("long")) / 1e9).alias("preference"), F.count(F.lit(1)).alias("n"))


def template_explanation(lists: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Adds text: the template of the row's method with {title}, {genre} and {score} filled in; the default one for other methods."""
    text = F.lit(templates["default"])
    for method, t in templates.items():
        text = F.when(F.col("method") == method, t).otherwise(text)
    for name in ("title", "genre"):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return lists.withColumn("text", F.replace(text, F.lit("{score}"), F.format_number("score", 2)))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds completeness: the share of the columns that are there and not empty."""
    have = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns), F.lit(0))
    return rows.withColumn("completeness", have / len(columns))


def list_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """user_id, added, removed, unchanged items between two sets of lists."""
    both = old.select("user_id", "item_id", F.lit(1).alias("o")).join(new.select("user_id", "item_id", F.lit(1).alias("n")), ["user_id", "item_id"], "full_outer")
    return both.groupBy("user_id").agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("unchanged"))


def group_explanation(lists: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, item_id, mean, lowest, highest, agreement 1 - (highest - lowest), label by agreement."""
    a = members.join(lists, "user_id").groupBy("group_id", "item_id").agg(F.avg("score").alias("mean"), F.min("score").alias("lowest"), F.max("score").alias("highest"))
    g = 1 - (F.col("highest") - F.col("lowest"))
    return a.select("group_id", "item_id", "mean", "lowest", "highest", g.alias("agreement"), F.when(g >= 0.9, "consensus").when(g >= 0.7, "mostly").otherwise("mixed").alias("label"))


def preference_contradictions(prefs: DataFrame, overlap: float = 0.5) -> DataFrame:
    """user_id, a, b: pairs of the user's features whose tokens' Jaccard overlap is above the given, with opposite values, both of a confidence above 0.7."""
    own = prefs.filter(F.col("confidence") > 0.7).withColumn("tokens", F.array_distinct(F.split(F.lower("feature"), "_")))
    each = own.select("user_id", "feature", "value", "tokens", F.explode("tokens").alias("t"))
    a, b = (each.select("user_id", "t", F.col("feature").alias(k), F.col("value").alias(f"v{k}"), F.col("tokens").alias(f"t{k}")) for k in "ab")
    both = a.join(b, ["user_id", "t"]).filter((F.col("a") < F.col("b")) & (F.col("va") * F.col("vb") < -0.5))
    j = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return both.filter(j > overlap).select("user_id", "a", "b").distinct()


def preference_category(feature: Column, keywords: dict[str, list[str]]) -> Column:
    """The first category of which the feature's name holds a keyword, else general."""
    out = F.lit("general")
    for name, words in reversed(list(keywords.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(feature), F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def demographics(users: DataFrame) -> DataFrame:
    """Adds income_band (right-closed at 0, 2500, 5000, 7500), is_domestic for the given region, and the group's code."""
    x = F.col("income")
    return users.withColumns({"income_band": F.when(x <= 0, "none").when(x <= 2500, "low").when(x <= 5000, "middle").when(x <= 7500, "upper").otherwise("high"), "is_american": F.col("region") == "AMERICA", "group_code": F.substring("user_group", 1, 3)})
