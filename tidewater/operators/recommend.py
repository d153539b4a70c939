"""Recommenders, their blending, and recommendations for groups.

Lists are rows (user_id, item_id, score); ties go to the smaller item. Empty
inputs give empty lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import kept
from ..functions.stats import as_of, ratio, top  # noqa: F401
from .networks import unit
from .vectors import nearest


def _ranked(items: DataFrame, n: int, step: float) -> DataFrame:
    """The n best items with rank and score 1 - step * (rank - 1); `by` orders them. The order is taken over at most n rows."""
    best = items.orderBy(F.desc("by"), "item_id").limit(n)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("by"), "item_id")))
    return ranked.select("item_id", "rank", (1 - step * (F.col("rank") - 1)).alias("score"))


def trending_items(interactions: DataFrame, days: int = 7, least: int = 50, n: int = 10, when: str | None = None) -> DataFrame:
    """Items with the largest count times mean rating of the last days, among those with `least` events."""
    own = as_of(interactions, when).filter(F.col("ts") >= F.col("as_of") - F.expr(f"interval {days} days"))
    a = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"), F.avg("rating").alias("m")).filter(F.col("c") >= least)
    return _ranked(a.select("item_id", F.round(F.col("c") * F.col("m"), 6).alias("by")), n, 0.1)


def new_releases(items: DataFrame, days: int = 30, n: int = 10, when: str | None = None) -> DataFrame:
    """Items (item_id, ts) of the last days, newest first."""
    own = as_of(items, when).filter(F.col("ts") >= F.col("as_of") - F.expr(f"interval {days} days"))
    return _ranked(own.select("item_id", F.col("ts").alias("by")), n, 0.05)


def acclaimed_items(interactions: DataFrame, threshold: float = 4.0, least: int = 50, n: int = 10) -> DataFrame:
    """Items with a mean rating of the threshold and `least` ratings, best first."""
    a = interactions.groupBy("item_id").agg(F.round(F.avg("rating"), 9).alias("by"), F.count("rating").alias("c"))
    return _ranked(a.filter((F.col("c") >= least) & (F.col("by") >= threshold)).select("item_id", "by"), n, 0.02)


def popular_items(interactions: DataFrame, n: int = 10) -> DataFrame:
    """item_id, count, mean, score ln(1 + count) * mean, rank: the n best."""
    a = interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"))
    best = a.withColumn("score", F.round(F.log1p("n") * F.col("mean"), 9)).orderBy(F.desc("score"), "item_id").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "item_id")))


def user_based_scores(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """user_id, item_id, score of items not rated by the user: the similarity-weighted mean of the raters' ratings, over the sum of similarities."""
    both = pairs.select(F.col("a").alias("user_id"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("user_id"), F.col("a").alias("other"), "similarity"))
    seen = matrix.select("user_id", "item_id")
    scored = both.join(matrix.select(F.col("user_id").alias("other"), "item_id", "rating"), "other").groupBy("user_id", "item_id").agg(F.sum(F.col("similarity") * F.col("rating")).alias("s"), F.sum(F.abs("similarity")).alias("w"), F.avg("rating").alias("m"))
    return scored.join(seen, ["user_id", "item_id"], "left_anti").select("user_id", "item_id", F.coalesce(ratio(F.col("s"), F.col("w")), F.col("m")).alias("score"))


def item_based_scores(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same over pairs of items: the mean of the user's ratings weighted by their items' similarity to the item."""
    both = pairs.select(F.col("a").alias("item_id"), F.col("b").alias("rated"), "similarity").unionByName(pairs.select(F.col("b").alias("item_id"), F.col("a").alias("rated"), "similarity"))
    seen = matrix.select("user_id", "item_id")
    scored = both.join(matrix.select("user_id", F.col("item_id").alias("rated"), "rating"), "rated").groupBy("user_id", "item_id").agg(F.sum(F.col("similarity") * F.col("rating")).alias("s"), F.sum(F.abs("similarity")).alias("w"))
    return scored.join(seen, ["user_id", "item_id"], "left_anti").select("user_id", "item_id", ratio(F.col("s"), F.col("w"), 0.0).alias("score"))


def cold_start(users: DataFrame, interactions: DataFrame, n: int = 5) -> DataFrame:
    """Popular items for users without interactions; the list of n items goes to every task."""
    new = users.select("user_id").join(interactions.select("user_id"), "user_id", "left_anti")
    return new.crossJoin(F.broadcast(popular_items(interactions, n).select("item_id", "score", "rank")))


def genre_popularity(interactions: DataFrame, content: DataFrame, genres: int = 3, n: int = 10) -> DataFrame:
    """user_id, item_id, score, rank: unseen items in the user's most frequent genres, by 0.4 * min(1, count / 100) + 0.6 * mean / 5."""
    items = content.select(F.col("content_id").alias("item_id"), F.explode(F.array_distinct("genres")).alias("genre"))
    taste = interactions.join(items, "item_id").groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("c"))
    liked = top(taste, ["user_id"], [F.desc("c"), F.col("genre")], genres).select("user_id", "genre")
    a = interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"), F.avg("rating").alias("m"))
    scored = a.select("item_id", F.round(0.4 * F.least(F.lit(1.0), F.col("c") / 100) + 0.6 * F.col("m") / 5, 9).alias("score"))
    offered = liked.join(items.join(scored, "item_id"), "genre").select("user_id", "item_id", "score").distinct()
    unseen = offered.join(interactions.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top(unseen, ["user_id"], [F.desc("score"), F.col("item_id")], n)


def knn(vectors: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """query_id, item_id, similarity, rank: exact cosine neighbours of a given set of queries, the query itself left out.

    The queries are compared with all vectors by products of blocks in tasks,
    and each task keeps its best rows. Vectors without a direction take no part.
    """
    own = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), unit(F.col("embedding")).alias("v")).filter("v is not null")
    return nearest(own(queries), own(vectors), n).select(F.col("id").alias("query_id"), F.col("other").alias("item_id"), "similarity", "rank")


def profile_embedding(interactions: DataFrame, vectors: DataFrame, block: int = 4_096, share: int = 200_000) -> DataFrame:
    """user_id, pos, value: the mean of the vectors of the user's items, scaled to length 1, as one row a dimension.

    Vectors are dealt to blocks, and the pairs of user and item to the blocks'
    tasks, about `share` a task; a task sums the vectors of each of its users,
    so that rows of single dimensions come up only at the end. Null parts count
    in no mean.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    seen = kept(interactions.select("user_id", "item_id").dropna(subset=["item_id"]).distinct(), "seen")
    own = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v")).filter("size(v) > 0")
    number = max(1, -(-own.count() // block))
    at = F.pmod(F.xxhash64(F.col("item_id").cast("long")), F.lit(number)).cast("int").alias("_b")
    slices = max(1, -(-seen.count() // (share * number)))
    pairs = seen.select("user_id", "item_id", at, F.pmod(F.xxhash64(F.lit(3), "user_id"), F.lit(slices)).cast("int").alias("_s"))
    blocks = own.select("item_id", "v", at).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    n = max(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(number * slices, 2_000))
    kind = seen.schema["user_id"]
    fields = pa.schema([("s", pa.list_(pa.float64())), ("n", pa.list_(pa.int64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # an item may have several vectors: each counts
        met = left.select(["user_id", "item_id"]).join(right.select(["item_id"]).append_column("_v", pa.array(np.arange(len(right)))), "item_id", join_type="inner")
        users = met.column("user_id").combine_chunks().dictionary_encode(null_encoding="encode")
        u, v = users.indices.to_numpy(), met.column("_v").to_numpy()
        lists = right.column("v").combine_chunks()
        size = np.asarray(pc.list_value_length(lists))
        width = int(size.max()) if len(size) else 0
        there = np.arange(width)[None, :] < size[:, None]
        flat = lists.flatten()
        x, known = np.zeros((len(size), width)), np.zeros((len(size), width), bool)
        x[there], known[there] = np.asarray(flat.fill_null(0.0)), ~np.asarray(flat.is_null())
        m = len(users.dictionary)
        s, c, of = (np.zeros((m, width)) for _ in range(3))
        for k in range(width):
            s[:, k], c[:, k] = np.bincount(u, x[v, k], m), np.bincount(u, known[v, k], m)
            of[:, k] = np.bincount(u, there[v, k], m)
        # -1: the user has no vector as long
        c = np.where(of > 0, c, -1).astype(np.int64)
        ends = pa.array(np.arange(m + 1) * width, pa.int32())
        return pa.table([users.dictionary, pa.ListArray.from_arrays(ends, pa.array(s.ravel())), pa.ListArray.from_arrays(ends, pa.array(c.ravel()))], names=["user_id", "s", "n"]).cast(pa.schema([pa.field("user_id", users.dictionary.type), *fields]))

    place = ["_b", "_s"]
    parts = pairs.repartition(n, *place).groupBy(*place).cogroup(blocks.repartition(n, *place).groupBy(*place)).applyInArrow(run, f"user_id {kind.dataType.simpleString()}, s array<double>, n array<bigint>")
    each = parts.select("user_id", F.posexplode(F.arrays_zip("s", "n")).alias("pos", "z")).filter("z.n >= 0")
    if number == 1:
        # one block: a user is in one task
        mean = each.select("user_id", "pos", F.when(F.col("z.n") > 0, F.col("z.s") / F.col("z.n")).alias("x"))
    else:
        mean = each.groupBy("user_id", "pos").agg((F.sum("z.s") / F.nullif(F.sum("z.n"), F.lit(0))).alias("x"))
    mean = kept(mean, "means")
    norm = mean.groupBy("user_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return mean.join(norm.hint("merge"), "user_id").select("user_id", "pos", ratio(F.col("x"), F.col("norm"), 0.0).alias("value"))


def weighted_blend(lists: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """user_id, item_id, score (sum of the components' scores times their weights), components (their names in order)."""
    every = None
    for name, (df, weight) in lists.items():
        own = df.select("user_id", "item_id", (F.col("score") * weight).alias("score"), F.lit(name).alias("component"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("user_id", "item_id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components"))


def category_limit(lists: DataFrame, blocked: list[str], boosted: list[str], factor: float = 1.5, most: int = 3) -> DataFrame:
    """Lists with column category: blocked categories go, boosted ones score more, and each category has `most` items at most, by score."""
    own = lists.filter(~F.coalesce(F.col("category").isin(blocked), F.lit(False)) if blocked else F.lit(True))
    own = own.withColumn("score", F.when(F.col("category").isin(boosted), F.col("score") * factor).otherwise(F.col("score")))
    return top(own, ["user_id", "category"], [F.desc("score"), F.col("item_id")], most, "category_rank")


def group_scores(lists: DataFrame, members: DataFrame, strategy: str) -> DataFrame:
    """group_id, item_id, score, voters of a strategy over the members' lists.

    average (from 30 percent of the members on), least_misery and approval
    (from two on), most_pleasure, fairness (average less 0.3 of the deviation's
    share), borda (length of the list less rank, from two on). members has
    group_id, user_id and weight.
    """
    size = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    own = members.join(lists, "user_id")
    if strategy == "borda":
        w = W.partitionBy("group_id", "user_id")
        place = F.row_number().over(w.orderBy(F.desc("score"), "item_id"))
        own = own.withColumn("score", (F.count(F.lit(1)).over(w) - place).cast("double"))
    weighted = F.sum(F.col("score") * F.col("weight"))
    a = own.groupBy("group_id", "item_id").agg(F.count(F.lit(1)).alias("voters"), (weighted / F.sum("weight")).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.stddev_pop("score").alias("deviation"), weighted.alias("total"), F.sum(F.when(F.col("score") > 0.5, F.col("weight")).otherwise(0.0)).alias("approval"), F.count_if(F.col("score") > 0.5).alias("approvals"))
    a = a.join(size, "group_id")
    score, enough = {
        "average": (F.col("mean"), F.col("voters") >= 0.3 * F.col("members")),
        "least_misery": (F.col("low"), F.col("voters") >= 2),
        "most_pleasure": (F.col("high"), F.lit(True)),
        "fairness": (F.col("mean") * (1 - F.col("deviation") * 0.3), F.lit(True)),
        "approval": (F.col("approval"), F.col("approvals") >= 2),
        "borda": (F.col("total"), F.col("voters") >= 2),
    }[strategy]
    return a.filter(enough).select("group_id", "item_id", score.alias("score"), "voters")


def group_satisfaction(chosen: DataFrame, lists: DataFrame, members: DataFrame, enough: float = 0.5) -> DataFrame:
    """group_id, mean, lowest, highest, deviation of the members' mean scores over the chosen items, satisfied members, fairness 1 - variation."""
    own = members.join(chosen.select("group_id", "item_id"), "group_id").join(lists, ["user_id", "item_id"], "left")
    each = own.groupBy("group_id", "user_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("s"))
    a = each.groupBy("group_id").agg(F.avg("s").alias("mean"), F.min("s").alias("lowest"), F.max("s").alias("highest"), F.stddev_pop("s").alias("deviation"), F.count_if(F.col("s") > enough).alias("satisfied"))
    return a.withColumn("fairness", 1 - ratio(F.col("deviation"), F.col("mean"), 0.0))


def group_topn(lists: DataFrame, members: DataFrame, strategy: str = "average", n: int = 10) -> DataFrame:
    """The first n items of each group by a strategy, with their rank."""
    scored = group_scores(lists, members, strategy).withColumn("score", F.round("score", 9))
    return top(scored, ["group_id"], [F.desc("score"), F.col("item_id")], n)


def transition_matrix(sessions: DataFrame, item: str = "item_id") -> DataFrame:
    """current, next, n, p: how often an item follows another inside a session."""
    follow = F.lead(item).over(W.partitionBy("user_id", "session").orderBy("ts", "event_id"))
    n = sessions.select(F.col(item).alias("current"), follow.alias("next")).filter("next is not null").groupBy("current", "next").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("current")))


def _lists(sessions: DataFrame, item: str) -> DataFrame:
    """user_id, session, start, items: each session's items in order, as texts."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", item)))
    return sessions.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.transform(rows, lambda x: x[item].cast("string")).alias("items"))


def frequent_runs(sessions: DataFrame, item: str, shortest: int = 2, longest: int = 10, support: float = 0.01) -> DataFrame:
    """run (an array), n, support: contiguous runs of `shortest` to `longest` items that stand in at least the share of all sessions."""
    own = _lists(sessions, item)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    runs = own.filter(F.size("items") >= shortest).select("user_id", "session", "items", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.size("items")))).alias("k"))
    runs = runs.select("user_id", "session", F.explode(F.transform(F.sequence(F.lit(1), F.size("items") - F.col("k") + 1), lambda i: F.slice("items", i, F.col("k")))).alias("run")).distinct()
    n = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).filter(F.col("n") >= support * F.col("total")).select("run", "n", (F.col("n") / F.col("total")).alias("support"))


def sequence_mining(sessions: DataFrame, item: str, longest: int = 10, support: float = 0.01) -> DataFrame:
    """sequence, n, support: the frequent runs of 2 to `longest` items, their items joined by >."""
    return frequent_runs(sessions, item, 2, longest, support).select(F.array_join("run", ">").alias("sequence"), "n", "support")


def sequential_rules(sessions: DataFrame, item: str, longest: int = 10, support: float = 0.01, confidence: float = 0.1) -> DataFrame:
    """antecedent, consequent (arrays), n, confidence: each frequent run cut in two, with the share of the sessions holding the first part that hold the run."""
    runs = frequent_runs(sessions, item, 1, longest, support)
    k = F.col("k")
    cuts = runs.filter(F.size("run") >= 2).select("run", "n", F.explode(F.sequence(F.lit(1), F.size("run") - 1)).alias("k"))
    cuts = cuts.select(F.slice("run", 1, k).alias("antecedent"), F.slice("run", k + 1, F.size("run") - k).alias("consequent"), "n")
    before = runs.select(F.col("run").alias("antecedent"), F.col("n").alias("_of"))
    out = cuts.join(before.hint("shuffle_hash"), "antecedent").withColumn("confidence", F.col("n") / F.col("_of"))
    return out.filter(F.col("confidence") >= confidence).drop("_of")


def next_items(sessions: DataFrame, item: str = "item_id", n: int = 5, longest: int = 10, markov: float = 0.6, rules: float = 0.4) -> DataFrame:
    """user_id, next, score, rank: what follows each user's last session, by `markov` of the chance to follow its last item and `rules` of the confidences of rules whose antecedent ends it, shared by the items of their consequents. Equal scores go by the item."""
    last = _lists(sessions, item).groupBy("user_id").agg(F.max_by("items", F.struct("start", "session")).alias("items"))
    follow = transition_matrix(sessions.withColumn(item, F.col(item).cast("string")), item)
    # each user has one last item and at most `longest` - 1 endings
    chain = last.select("user_id", F.element_at("items", -1).alias("current")).join(follow.hint("shuffle_hash"), "current").select("user_id", "next", (markov * F.col("p")).alias("score"))
    ends = last.select("user_id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest - 1), F.size("items"))), lambda k: F.slice("items", -k, k))).alias("antecedent"))
    found = ends.join(sequential_rules(sessions, item, longest).hint("shuffle_hash"), "antecedent")
    shares = found.select("user_id", F.explode("consequent").alias("next"), (rules * F.col("confidence") / F.size("consequent")).alias("score"))
    scored = chain.unionByName(shares).groupBy("user_id", "next").agg(F.round(F.sum("score"), 9).alias("score"))
    return top(scored, ["user_id"], [F.desc("score"), F.col("next")], n)


def als(interactions: DataFrame, n: int = 10, rank: int = 50, iterations: int = 10, spare: int = 200) -> DataFrame:
    """user_id, item_id, score: implicit-feedback factor model, the n best unseen items of each user.

    Every user is first offered n + spare items; those who have seen more than
    spare are taken in bands by powers of two of it and offered n more than
    their band may have seen, so nobody's offers grow with another's history.
    """
    from pyspark.ml.recommendation import ALS

    matrix = kept(interactions.groupBy("user_id", "item_id").agg(F.sum("rating").cast("float").alias("rating")), "ratings")
    model = ALS(userCol="user_id", itemCol="item_id", ratingCol="rating", implicitPrefs=True, rank=rank, maxIter=iterations, regParam=0.1, seed=42, coldStartStrategy="drop").fit(matrix)
    seen = matrix.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    many = seen.filter(F.col("k") > spare).select("user_id")

    def unseen(offered: DataFrame) -> DataFrame:
        rows = offered.select("user_id", F.explode("recommendations").alias("r")).select("user_id", F.col("r.item_id").alias("item_id"), F.col("r.rating").cast("double").alias("score"))
        return rows.join(matrix.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")

    rows = unseen(model.recommendForAllUsers(n + spare)).join(many, "user_id", "left_anti")
    most, upper = seen.agg(F.max("k")).first()[0] or 0, spare
    while upper < most:
        lower, upper = upper, max(1, 2 * upper)
        band = seen.filter((F.col("k") > lower) & (F.col("k") <= upper)).select("user_id")
        rows = rows.unionByName(unseen(model.recommendForUserSubset(band, n + upper)))
    return top(rows, ["user_id"], [F.desc("score"), F.col("item_id")], n)
