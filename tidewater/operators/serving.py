"""Re-ranking, control and explanation of recommendation lists, and what is reported of them.

Lists have user_id, item_id and score. Every operator works on lists that are
already short for each user; nothing pairs all users or all items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import top
from ..functions.tables import kept
from .evaluation import jaccard

#: Tasks that the users of one genre are dealt to.
DEALT = 16


def content_recommend(interactions: DataFrame, content: DataFrame, n: int = 10, factor: float = 0.1) -> DataFrame:
    """user_id, item_id, score, rank: unseen items by similarity to the user's genres, re-ranked for diversity.

    The profile is the mean over the user's items of each genre's presence,
    the similarity the cosine with an item's genres. Of the 3n best, n are chosen
    one by one by similarity times 1 less the penalty, which is the mean genre
    overlap with those chosen before, times the factor.

    Items with the same genres are equally similar to a user and go by their
    id. So users meet sets of genres, and of the best sets each user gets the
    first items that are not seen.
    """
    most = 3 * n
    items = content.select(F.col("content_id").alias("item_id"), F.array_sort(F.array_distinct("genres")).alias("genres")).filter(F.size("genres") > 0)
    items = kept(items, "items")
    own = kept(interactions.select("user_id", "item_id").distinct().join(items.hint("merge"), "item_id"), "seen")
    profile = kept(own.select("user_id", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("w")), "profile")
    norm = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double")).alias("norm"))
    sets = kept(items.groupBy("genres").agg(F.count(F.lit(1)).alias("members")), "sets")
    # a genre's users are dealt to several tasks
    dealt = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))
    by_genre = kept(sets.select("genres", "members", F.explode("genres").alias("genre")).withColumn("_d", dealt), "by_genre")
    each = profile.withColumn("_d", F.pmod(F.xxhash64("user_id"), F.lit(DEALT)).cast("int"))
    dots = each.join(by_genre.hint("merge"), ["genre", "_d"]).groupBy("user_id", "genres", "members").agg(F.sum("w").alias("dot"))
    taken = kept(own.groupBy("user_id", "genres").agg(F.count(F.lit(1)).alias("taken")), "taken")
    scored = dots.join(norm.hint("merge"), "user_id").join(taken.hint("merge"), ["user_id", "genres"], "left")
    scored = scored.select("user_id", "genres", "members", F.coalesce("taken", F.lit(0)).alias("taken"), F.round(F.col("dot") / F.col("norm") / F.sqrt(F.size("genres").cast("double")), 9).alias("score"))
    # sets in their order, until those before leave enough unseen items
    free = F.col("members") - F.col("taken")
    upto, equal = W.partitionBy("user_id").orderBy(F.desc("score")), W.partitionBy("user_id", "score")
    chosen = scored.withColumn("_before", F.sum(free).over(upto) - F.sum(free).over(equal)).filter((F.col("_before") < most) & (free > 0))
    slots = chosen.select("user_id", "genres", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("members", F.col("taken") + most))).alias("place"))
    longest = taken.agg(F.max("taken")).first()[0] or 0
    first = kept(top(items, ["genres"], [F.col("item_id")], most + longest, "place").withColumn("place", F.col("place").cast("long")), "first")
    known = own.select("user_id", "item_id").join(first.select("item_id", "genres", "place").hint("merge"), "item_id").select("user_id", "genres", "place")
    unseen = kept(slots.join(known.hint("merge"), ["user_id", "genres", "place"], "left_anti"), "unseen")
    few = top(unseen.join(first.hint("merge"), ["genres", "place"]), ["user_id"], [F.desc("score"), F.col("item_id")], most)
    return _chosen(few, lambda s, overlap: s * (1 - factor * overlap), n)


def mmr_rerank(lists: DataFrame, content: DataFrame, factor: float = 0.3) -> DataFrame:
    """user_id, item_id, score, rank: the list in the order of relevance less factor times the mean genre overlap with the items before; score is that value, the first item's its relevance."""
    own = lists.select("user_id", "item_id", "score").join(content.select(F.col("content_id").alias("item_id"), F.array_distinct("genres").alias("genres")), "item_id")
    return _chosen(own, lambda s, overlap: s - factor * overlap, None)


def _chosen(lists: DataFrame, value, n: int | None) -> DataFrame:
    """Greedy choice from each user's short list: the largest value of (score, mean overlap with the chosen), ties to the larger score and the smaller item."""
    import pandas as pd

    def choose(user, rows):
        left = sorted(([r["score"], r["item_id"], set(r["genres"]), []] for r in rows), key=lambda r: (-r[0], r[1]))
        k = 0
        while left and (n is None or k < n):
            worth = [value(r[0], sum(r[3]) / k if k else 0.0) for r in left]
            at = max(range(len(left)), key=lambda i: (round(worth[i], 9), left[i][0], -left[i][1]))
            best, k = left.pop(at), k + 1
            yield user, best[1], worth[at], k
            for r in left:
                r[3].append(len(r[2] & best[2]) / max(len(r[2] | best[2]), 1))

    def run(parts):
        for part in parts:
            yield pd.DataFrame([x for u, r in zip(part["user_id"], part["rows"], strict=True) for x in choose(u, r)], columns=["user_id", "item_id", "score", "rank"])

    rows = lists.groupBy("user_id").agg(F.collect_list(F.struct("item_id", "score", "genres")).alias("rows"))
    return rows.mapInPandas(run, "user_id bigint, item_id bigint, score double, rank int")


#: Genres or types that suit a context, the score of those, and that of others.
CONTEXTS = [
    ("season", "summer", "genre", ["action", "adventure", "comedy"], 0.7, 0.5),
    ("season", "winter", "genre", ["drama", "horror", "thriller"], 0.7, 0.5),
    ("season", "spring", "genre", ["romance", "family", "comedy"], 0.7, 0.5),
    ("season", "fall", "genre", ["thriller", "drama", "horror"], 0.7, 0.5),
    ("device", "mobile", "type", ["short_form", "music", "podcast"], 0.8, 0.5),
    ("device", "tv", "type", ["movie", "series", "documentary"], 0.8, 0.5),
    ("device", "tablet", "type", ["book", "magazine", "comic"], 0.8, 0.5),
    ("device", "desktop", "type", ["game", "software", "course"], 0.8, 0.5),
    ("location", "home", "type", ["movie", "series", "book"], 0.7, 0.4),
    ("location", "work", "type", ["podcast", "audiobook", "music"], 0.7, 0.4),
    ("location", "commute", "type", ["podcast", "audiobook", "music"], 0.7, 0.4),
    ("location", "gym", "type", ["music", "podcast"], 0.7, 0.4),
    ("location", "travel", "type", ["book", "movie", "music"], 0.7, 0.4),
    ("weather", "sunny", "genre", ["adventure", "comedy", "action"], 0.6, 0.5),
    ("weather", "rainy", "genre", ["drama", "romance", "documentary"], 0.6, 0.5),
    ("weather", "cloudy", "genre", ["thriller", "mystery", "drama"], 0.6, 0.5),
    ("weather", "stormy", "genre", ["horror", "thriller", "action"], 0.6, 0.5),
]


def contextual_items(content: DataFrame, context: dict[str, str], rules=CONTEXTS, n: int = 10) -> DataFrame:
    """item_id, score, rank: the mean over the given contexts of the rule's score for items that suit it, and its other score for the rest. Contexts without a rule do not count."""
    names = F.concat_ws(" ", F.transform("genres", F.lower))
    parts: list[Column] = []
    for kind, value, field, wanted, yes, no in rules:
        if context.get(kind) == value:
            fits = names.rlike("|".join(wanted)) if field == "genre" else F.lower("content_type").isin(*wanted)
            parts.append(F.when(fits, F.lit(yes)).otherwise(F.lit(no)))
    if not parts:
        return content.select(F.col("content_id").alias("item_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    scored = content.select(F.col("content_id").alias("item_id"), F.round(sum(parts[1:], parts[0]) / len(parts), 9).alias("score"))
    # only the n best reach the window
    best = scored.orderBy(F.desc("score"), "item_id").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "item_id")))


def controlled(lists: DataFrame, settings: DataFrame) -> DataFrame:
    """The lists that pass their user's settings: no blocked category, novelty reached, and with enforce_diversity the `most` best of a category. lists has category and novelty; settings has user_id, blocked, novelty_preference, enforce_diversity, most; users without settings keep all."""
    own = lists.join(settings, "user_id", "left")
    blocked = F.coalesce(F.array_contains("blocked", F.col("category")), F.lit(False))
    own = own.filter(~blocked & (F.coalesce("novelty", F.lit(0.5)) >= F.coalesce("novelty_preference", F.lit(0.0))))
    place = F.row_number().over(W.partitionBy("user_id", "category").orderBy(F.desc("score"), "item_id"))
    own = own.withColumn("_p", place).filter(~F.coalesce("enforce_diversity", F.lit(False)) | (F.col("_p") <= F.coalesce("most", F.lit(3))))
    return own.select(*lists.columns)


def bandit_select(arms: DataFrame, rounds: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """user_id, round, arm, explored: with a chance of epsilon an arm drawn by hash, else the user's arm of the largest mean reward (the smallest of equals). Draws are the first digits of md5 of user, round and purpose."""

    def draw(purpose: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("round").cast("string"), F.lit(purpose))), 1, 8), 16, 10).cast("long")

    own = arms.groupBy("user_id").agg(F.sort_array(F.collect_set("arm")).alias("arms"), F.min(F.struct((-F.col("reward")).alias("r"), "arm"))["arm"].alias("best"))
    out = rounds.join(own, "user_id").withColumn("explored", draw("explore") % 10_000 < int(epsilon * 10_000))
    picked = F.element_at("arms", (draw("arm") % F.size("arms") + 1).cast("int"))
    return out.select("user_id", "round", F.when(F.col("explored"), picked).otherwise(F.col("best")).alias("arm"), "explored")


def ensemble_predict(pairs: DataFrame, parts: dict[str, tuple[DataFrame, list[str], float]]) -> DataFrame:
    """pairs with prediction: the mean of the parts' predictions by their weights, among those that have one, between 0 and 5; 2.5 without any. A part is (table with its keys and `prediction`, keys, weight)."""
    out, total, weights = pairs, F.lit(0.0), F.lit(0.0)
    for name, (df, keys, weight) in parts.items():
        out = out.join(df.select(*keys, F.col("prediction").alias(f"_{name}")), keys, "left")
        total = total + F.coalesce(F.col(f"_{name}") * weight, F.lit(0.0))
        weights = weights + F.when(F.col(f"_{name}").isNotNull(), weight).otherwise(0.0)
    prediction = F.when(weights > 0, F.greatest(F.lit(0.0), F.least(F.lit(5.0), total / weights))).otherwise(2.5)
    return out.withColumn("prediction", prediction).select(*pairs.columns, "prediction")


def fair_boost(scores: DataFrame, lists: DataFrame, members: DataFrame, weight: float = 0.3, top_n: int = 20) -> DataFrame:
    """group_id, item_id, score, boosted: members whose sum of scores over the group's top items is under 0.8 of the members' mean lift the items that they score, by 1 plus `weight` times their scores."""
    own = members.select("group_id", "user_id").join(lists.select("user_id", "item_id", F.col("score").alias("own")), "user_id")
    best = top(scores.select("group_id", "item_id", "score"), ["group_id"], [F.desc("score"), F.col("item_id")], top_n)
    got = own.join(best.select("group_id", "item_id"), ["group_id", "item_id"], "left_semi").groupBy("group_id", "user_id").agg(F.sum("own").alias("got"))
    all_ = members.select("group_id", "user_id").join(got, ["group_id", "user_id"], "left").fillna(0.0, ["got"])
    under = all_.withColumn("mean", F.avg("got").over(W.partitionBy("group_id"))).filter(F.round(F.col("got"), 9) < F.round(0.8 * F.col("mean"), 9)).select("group_id", "user_id")
    lift = own.join(under, ["group_id", "user_id"], "left_semi").groupBy("group_id", "item_id").agg((1 + weight * F.sum("own")).alias("lift"))
    out = scores.join(lift, ["group_id", "item_id"], "left")
    return out.select("group_id", "item_id", (F.col("score") * F.coalesce("lift", F.lit(1.0))).alias("score"), (F.coalesce("lift", F.lit(1.0)) > 1).alias("boosted"))


def history_explanation(lists: DataFrame, interactions: DataFrame, content: DataFrame, last: int = 5) -> DataFrame:
    """user_id, item_id, because, similarity: for each recommended item the one of the user's last `last` items whose genres overlap most, the smallest of equals."""
    genres = content.select("content_id", "genres")
    recent = interactions.groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("t"))
    recent = top(recent, ["user_id"], [F.desc("t")], last).select("user_id", F.col("item_id").alias("content_id")).join(genres, "content_id").select("user_id", F.col("content_id").alias("other"), F.col("genres").alias("theirs"))
    own = lists.select("user_id", F.col("item_id").alias("content_id")).join(genres, "content_id")
    both = own.join(recent, "user_id").withColumn("s", jaccard(F.col("genres"), F.col("theirs")))
    a = both.groupBy("user_id", F.col("content_id").alias("item_id")).agg(F.min(F.struct((-F.col("s")).alias("s"), "other")).alias("x"))
    return a.select("user_id", "item_id", F.col("x.other").alias("because"), (-F.col("x.s")).alias("similarity"))


def neighbour_explanation(lists: DataFrame, matrix: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """user_id, item_id, rank, neighbour, similarity, rating: the users most like the user among those who rated the recommended item. pairs has a, b, similarity, each pair once."""
    both = pairs.select(F.col("a").alias("user_id"), F.col("b").alias("neighbour"), "similarity").unionByName(pairs.select(F.col("b").alias("user_id"), F.col("a").alias("neighbour"), "similarity"))
    raters = lists.select("user_id", "item_id").join(matrix.select(F.col("user_id").alias("neighbour"), "item_id", "rating"), "item_id")
    own = raters.join(both, ["user_id", "neighbour"]).withColumn("similarity", F.round("similarity", 9))
    return top(own, ["user_id", "item_id"], [F.desc("similarity"), F.col("neighbour")], n).select("user_id", "item_id", "rank", "neighbour", "similarity", "rating")


def overall_score(parts: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """user_id, the score of each part (0 where it has none) and overall, their sum by weight. A part has user_id and value."""
    users = None
    for df in parts.values():
        own = df.select("user_id")
        users = own if users is None else users.unionByName(own)
    out = users.distinct()
    for name, df in parts.items():
        out = out.join(df.select("user_id", F.col("value").alias(name)), "user_id", "left")
    out = out.fillna(0.0, list(parts))
    return out.withColumn("overall", sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))


def quality_grade(metrics: DataFrame) -> DataFrame:
    """metrics with issues and grade: below 0.35 of ndcg, 0.65 of diversity, 500 requests a second, above 100 ms; A for no issue with the targets 0.40 and 0.70 reached, else B; C, D, F by the number of issues."""
    issues = F.filter(F.array(F.when(F.col("ndcg") < 0.35, "ndcg"), F.when(F.col("diversity") < 0.65, "diversity"), F.when(F.col("latency") > 100, "latency"), F.when(F.col("throughput") < 500, "throughput")), lambda x: x.isNotNull())
    target = (F.col("ndcg") >= 0.40) & (F.col("diversity") >= 0.70)
    out = metrics.withColumn("issues", F.array_join(issues, ",")).withColumn("_n", F.size(issues))
    return out.withColumn("grade", F.when(F.col("_n") == 0, F.when(target, "A").otherwise("B")).when(F.col("_n") == 1, "C").when(F.col("_n") == 2, "D").otherwise("F")).drop("_n")


def sync_metrics(log: DataFrame, as_of: Column) -> DataFrame:
    """batch_updates, stream_updates, conflicts, resolved, lag_seconds since the last batch, success_rate: 1 less unresolved conflicts over updates. log has kind (batch, stream, conflict, resolved) and ts."""
    n = lambda k: F.count_if(F.col("kind") == k)
    a = log.agg(n("batch").alias("batch_updates"), n("stream").alias("stream_updates"), n("conflict").alias("conflicts"), n("resolved").alias("resolved"), F.max(F.when(F.col("kind") == "batch", F.unix_micros("ts"))).alias("last"))
    total = F.col("batch_updates") + F.col("stream_updates")
    rate = F.when(total > 0, F.greatest(F.lit(0.0), 1 - (F.col("conflicts") - F.col("resolved")) / total))
    return a.select("batch_updates", "stream_updates", "conflicts", "resolved", ((F.unix_micros(as_of) - F.col("last")) / 1e6).alias("lag_seconds"), rate.alias("success_rate"))


def experiment_report(results: DataFrame, metrics: list[str], control: str, least: int = 30) -> DataFrame:
    """metric, variant, n, mean, control_mean, lift, t, significant, decision for each variant but the control.

    t is Welch's; |t| > 1.96 is significant, and the decision is `insufficient_data` below `least` rows of either side, else declare_winner, stop, or continue.
    """
    rows = results.select("variant", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))).filter("x is not null")
    a = rows.groupBy("metric", "variant").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("v"))
    c = a.filter(F.col("variant") == control).select("metric", F.col("n").alias("cn"), F.col("mean").alias("control_mean"), F.col("v").alias("cv"))
    # one row a metric
    out = a.filter(F.col("variant") != control).join(F.broadcast(c), "metric")
    error = F.sqrt(F.col("v") / F.col("n") + F.col("cv") / F.col("cn"))
    out = out.withColumn("lift", F.when(F.col("control_mean") > 0, (F.col("mean") - F.col("control_mean")) / F.col("control_mean")).otherwise(0.0)).withColumn("t", F.when(error > 0, (F.col("mean") - F.col("control_mean")) / error))
    out = out.withColumn("significant", F.coalesce(F.abs("t") > 1.96, F.lit(False)))
    decision = F.when((F.col("n") < least) | (F.col("cn") < least), "insufficient_data").when(F.col("significant") & (F.col("lift") > 0), "declare_winner").when(F.col("significant"), "stop").otherwise("continue")
    return out.select("metric", "variant", "n", "mean", "control_mean", "lift", "t", "significant", decision.alias("decision"))


def fairness_report(measures: DataFrame) -> DataFrame:
    """kind, n, score, passed (no measure of the kind under its limit), band of the score (0.9, 0.8, 0.6), alerts. measures has kind, name, value, limit."""
    a = measures.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.least(F.lit(1.0), F.col("value"))).alias("score"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("value") < F.col("limit"), F.col("name")))), ",").alias("alerts"))
    band = F.when(F.col("score") >= 0.9, "compliant").when(F.col("score") >= 0.8, "mostly_compliant").when(F.col("score") >= 0.6, "partly_compliant").otherwise("non_compliant")
    return a.select("kind", "n", "score", (F.col("alerts") == "").alias("passed"), band.alias("band"), "alerts")


def feature_contributions(lists: DataFrame, interactions: DataFrame, content: DataFrame) -> DataFrame:
    """user_id, item_id, feature, contribution, rank: how the item meets the user's history by genres (share of its genres known), creator (share of events), type (share of events); the larger first."""
    own = interactions.select("user_id", F.col("item_id").alias("content_id")).join(content.select("content_id", "genres", "creator", "content_type"), "content_id")
    n = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("genres"))).alias("known"))

    def share(column: str) -> DataFrame:
        return own.groupBy("user_id", column).agg(F.count(F.lit(1)).alias(f"n_{column}"))

    out = lists.select("user_id", F.col("item_id").alias("content_id")).join(content.select("content_id", "genres", "creator", "content_type"), "content_id").join(n, "user_id")
    out = out.join(share("creator"), ["user_id", "creator"], "left").join(share("content_type"), ["user_id", "content_type"], "left")
    genre = F.size(F.array_intersect("genres", "known")) / F.size(F.array_distinct("genres"))
    parts = [("genre", genre), ("creator", F.coalesce("n_creator", F.lit(0)) / F.col("n")), ("type", F.coalesce("n_content_type", F.lit(0)) / F.col("n"))]
    rows = out.select("user_id", F.col("content_id").alias("item_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.round(v, 9).alias("contribution")) for k, v in parts])))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("user_id", "item_id").orderBy(F.desc("contribution"), "feature")))


def preference_summary(interactions: DataFrame, content: DataFrame, genres: int = 5, types: int = 3) -> DataFrame:
    """user_id, genres and types (the most frequent, comma-joined), mean rating, deviation, diversity (distinct genres over all genre mentions)."""
    own = interactions.select("user_id", "rating", F.col("item_id").alias("content_id")).join(content.select("content_id", "genres", "content_type"), "content_id")

    def best(rows: DataFrame, column: str, n: int, name: str) -> DataFrame:
        few = top(rows.groupBy("user_id", column).agg(F.count(F.lit(1)).alias("c")), ["user_id"], [F.desc("c"), F.col(column)], n)
        return few.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda x: x[column]), ",").alias(name))

    g = own.select("user_id", F.explode("genres").alias("genre"))
    spread = g.groupBy("user_id").agg((F.countDistinct("genre") / F.count(F.lit(1))).alias("diversity"))
    scalar = own.groupBy("user_id").agg(F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("deviation"))
    return best(g, "genre", genres, "genres").join(best(own, "content_type", types, "types"), "user_id").join(scalar, "user_id").join(spread, "user_id")


def factor_export(interactions: DataFrame, rank: int = 50, iterations: int = 10) -> DataFrame:
    """kind (user or item), id, factors of an implicit-feedback factor model."""
    from pyspark.ml.recommendation import ALS

    matrix = interactions.groupBy("user_id", "item_id").agg(F.sum("rating").cast("float").alias("rating"))
    model = ALS(userCol="user_id", itemCol="item_id", ratingCol="rating", implicitPrefs=True, rank=rank, maxIter=iterations, regParam=0.1, seed=42).fit(matrix)
    kinds = [("user", model.userFactors), ("item", model.itemFactors)]
    return kinds[0][1].select(F.lit("user").alias("kind"), "id", F.col("features").alias("factors")).unionByName(kinds[1][1].select(F.lit("item").alias("kind"), "id", F.col("features").alias("factors")))
