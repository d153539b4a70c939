"""Ranking metrics, fairness, experiments and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal_two_sided, places, ratio, student_as_normal, student_point
from .strips import overlap


def ndcg(lists: DataFrame, relevance: DataFrame, k: int = 10) -> DataFrame:
    """user_id, ndcg: gains rel / log2(rank + 1) of the first k items over those of the best order; users without relevant items get 0."""
    gain = F.coalesce(F.col("relevance"), F.lit(0.0)) / F.log2(F.col("rank") + 1.0)
    got = lists.filter(F.col("rank") <= k).join(relevance, ["user_id", "item_id"], "left").groupBy("user_id").agg(F.sum(gain).alias("dcg"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("relevance"), "item_id"))
    best = relevance.withColumn("i", place).filter(F.col("i") <= k).groupBy("user_id").agg(F.sum(F.col("relevance") / F.log2(F.col("i") + 1.0)).alias("ideal"))
    return got.join(best, "user_id", "left").select("user_id", ratio(F.col("dcg"), F.col("ideal"), 0.0).alias("ndcg"))


def precision_recall(lists: DataFrame, relevance: DataFrame, k: int = 10, least: float = 4.0) -> DataFrame:
    """user_id, precision, recall, f1, reciprocal rank of the first hit, and whether there is one; relevant is a relevance of `least` or more."""
    good = relevance.filter(F.col("relevance") >= least).select("user_id", "item_id", F.lit(1).alias("hit"))
    total = good.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    a = lists.filter(F.col("rank") <= k).join(good, ["user_id", "item_id"], "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    a = a.join(total, "user_id", "left")
    p, r = F.col("hits") / F.col("n"), ratio(F.col("hits"), F.col("relevant"), 0.0)
    return a.select("user_id", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r, 0.0).alias("f1"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("hits") > 0).alias("hit"))


def prediction_error(scores: DataFrame) -> DataFrame:
    """mae, rmse, n over columns predicted and actual."""
    e = F.col("predicted") - F.col("actual")
    return scores.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"))


def catalog_coverage(lists: DataFrame, catalog: DataFrame) -> DataFrame:
    """recommended, items, coverage."""
    a = lists.agg(F.countDistinct("item_id").alias("recommended"))
    b = catalog.agg(F.countDistinct("content_id").alias("items"))
    return a.crossJoin(F.broadcast(b)).withColumn("coverage", ratio(F.col("recommended"), F.col("items"), 0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def intra_list_diversity(lists: DataFrame, content: DataFrame) -> DataFrame:
    """user_id, diversity: the mean of 1 less the Jaccard similarity of genres over the pairs of a list, which is short."""
    own = lists.join(content.select(F.col("content_id").alias("item_id"), "genres"), "item_id")
    a, b = own.select("user_id", F.col("rank").alias("ra"), F.col("genres").alias("ga")), own.select("user_id", F.col("rank").alias("rb"), F.col("genres").alias("gb"))
    pairs = a.join(b, "user_id").filter("ra < rb")
    return pairs.groupBy("user_id").agg(F.avg(1 - jaccard(F.col("ga"), F.col("gb"))).alias("diversity"))


def novelty(lists: DataFrame, interactions: DataFrame, head: float = 0.2) -> DataFrame:
    """user_id, novelty (mean of 1 less popularity), information (mean of -log2 popularity), long_tail (share of items beyond the most popular fifth)."""
    users = interactions.agg(F.countDistinct("user_id").alias("users"))
    n = interactions.groupBy("item_id").agg(F.countDistinct("user_id").alias("n"))
    # items as popular as the one at the cut are told apart by their ids
    above = F.col("total") - F.col("below") - F.col("ties")
    cut = places(n, "n").select(F.col("n").alias("_at"), above.alias("_above"), "total", ((above + 1) / F.col("total") > head).alias("_beyond"), ((above + F.col("ties")) / F.col("total") <= head).alias("_inside"))
    own = n.join(cut, F.col("n") == F.col("_at"))
    at_cut = own.filter("not _beyond and not _inside")
    ids = places(at_cut, "item_id").select("item_id", F.col("below").alias("_earlier"))
    tail = F.col("_beyond") | (~F.col("_inside") & ((F.col("_above") + F.coalesce("_earlier", F.lit(0)) + 1) / F.col("total") > head))
    pop = own.join(ids, "item_id", "left").crossJoin(F.broadcast(users)).select("item_id", (F.col("n") / F.col("users")).alias("p"), tail.alias("tail"))
    return lists.join(pop, "item_id").groupBy("user_id").agg(F.avg(1 - F.col("p")).alias("novelty"), F.avg(-F.log2("p")).alias("information"), F.avg(F.col("tail").cast("double")).alias("long_tail"))


def serendipity(lists: DataFrame, interactions: DataFrame, content: DataFrame) -> DataFrame:
    """user_id, serendipity: the mean share of an item's genres that are new to the user."""
    genres = content.select(F.col("content_id").alias("item_id"), "genres")
    known = interactions.join(genres, "item_id").groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_set("genres"))).alias("known"))
    own = lists.join(genres, "item_id").join(known, "user_id", "left")
    new = F.size(F.array_except("genres", F.coalesce("known", F.array().cast("array<string>")))) / F.size(F.array_distinct("genres"))
    return own.groupBy("user_id").agg(F.avg(new).alias("serendipity"))


def personalization(lists: DataFrame) -> DataFrame:
    """users, personalization: the mean of 1 less the Jaccard similarity over all pairs of users; equal lists are compared once."""
    all_ = overlap(lists.select("user_id", "item_id", F.lit(0).cast("long").alias("group")), "group").agg(F.coalesce(F.sum("users"), F.lit(0).cast("long")).alias("users"), F.coalesce(F.sum("alike"), F.lit(0.0)).alias("alike"))
    pairs = F.col("users") * (F.col("users") - 1) / 2
    return all_.select("users", F.when(pairs > 0, 1 - F.col("alike") / pairs).otherwise(0.0).alias("personalization"))


def attribute_fairness(lists: DataFrame, attribute: str) -> DataFrame:
    """entropy of the attribute's shares over its largest value, gini of its counts, values."""
    n = lists.groupBy(attribute).agg(F.count(F.lit(1)).alias("n"))
    # one row a value of the attribute
    w = W.partitionBy()
    own = n.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("i", F.row_number().over(W.orderBy("n", attribute)))
    a = own.agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"), F.count(F.lit(1)).alias("k"), F.sum(F.col("i") * F.col("n")).alias("weighted"), F.sum("n").alias("total"))
    gini = 2 * F.col("weighted") / (F.col("k") * F.col("total")) - (F.col("k") + 1) / F.col("k")
    return a.select(F.when(F.col("k") > 1, F.col("h") / F.ln(F.col("k").cast("double"))).otherwise(0.0).alias("entropy"), gini.alias("gini"), F.col("k").alias("n_values"))


def demographic_parity(scores: DataFrame, group: str, threshold: float) -> DataFrame:
    """group, n, positive rate, its ratio to the highest rate, severity (under .8 a violation, under .6 a severe one)."""
    a = scores.groupBy(F.col(group).alias("group_value")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"))
    r = ratio(F.col("rate"), F.max("rate").over(W.partitionBy()), 1.0)
    return a.select("group_value", "n", "rate", r.alias("parity"), F.when(r < 0.6, "severe").when(r < 0.8, "violation").otherwise("ok").alias("severity"))


def representation_gap(lists: DataFrame, group: str, attribute: str) -> DataFrame:
    """attribute value, lowest, highest share over the groups and their gap."""
    n = lists.groupBy(group, attribute).agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))
    groups = n.agg(F.countDistinct(group).alias("groups"))
    a = share.groupBy(F.col(attribute).alias("value")).agg(F.min("share").alias("low"), F.max("share").alias("highest"), F.count(F.lit(1)).alias("k"))
    low = F.when(F.col("k") == F.col("groups"), F.col("low")).otherwise(0.0)
    return a.crossJoin(F.broadcast(groups)).select("value", low.alias("lowest"), "highest", (F.col("highest") - low).alias("gap"))


def equalized_odds(scores: DataFrame, group: str) -> DataFrame:
    """group, true and false positive rate of the predictions, over columns predicted and actual (0 or 1)."""
    return scores.groupBy(F.col(group).alias("group_value")).agg(F.avg(F.when(F.col("actual") == 1, F.col("predicted").cast("double"))).alias("tpr"), F.avg(F.when(F.col("actual") == 0, F.col("predicted").cast("double"))).alias("fpr"), F.count(F.lit(1)).alias("n"))


def calibration(scores: DataFrame, bins: int = 10, group: list[str] | None = None) -> DataFrame:
    """bin (right-closed, 1 at least), n, mean score, mean outcome, gap, for each group."""
    b = F.greatest(F.lit(1), F.ceil(F.col("score") * bins)).cast("int")
    return scores.groupBy(*(group or []), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.avg(F.col("actual").cast("double")).alias("outcome")).withColumn("gap", F.abs(F.col("score") - F.col("outcome")))


def expected_calibration_error(scores: DataFrame, bins: int = 10) -> DataFrame:
    """ece (bins' gaps weighted by their rows), n, accurate (under 0.1)."""
    c = calibration(scores, bins)
    e = ratio(F.sum(F.col("gap") * F.col("n")), F.sum("n"), 0.0)
    return c.agg(e.alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("accurate", F.col("ece") < 0.1)


def ab_bucket(user: str, experiment: str) -> Column:
    """md5 of user:experiment modulo 10000, over 10000."""
    digest = F.md5(F.concat_ws(":", F.col(user).cast("string"), F.lit(experiment)))
    half = lambda i: F.conv(F.substring(digest, i, 16), 16, 10).cast("decimal(20,0)")
    # 2 ** 64 modulo 10000 is 1616
    return ((half(1) % 10000) * 1616 + half(17) % 10000) % 10000 / 10000


def ab_assignment(users: DataFrame, experiment: str, traffic: dict[str, float]) -> DataFrame:
    """user_id, bucket, variant: the first variant whose running traffic exceeds the bucket; null beyond all."""
    own = users.select("user_id", ab_bucket("user_id", experiment).cast("double").alias("bucket"))
    variant, upto = F.lit(None).cast("string"), 0.0
    for name, share in reversed(list(traffic.items())):
        variant = F.when(F.col("bucket") < sum(list(traffic.values())[: list(traffic).index(name) + 1]), name).otherwise(variant)
    return own.withColumn("variant", variant)


def welch(df: DataFrame, variant: str, metric: str, control: str, treatment: str) -> DataFrame:
    """n, means, difference, t, degrees of freedom, p, effect (difference over the root of the mean variance) and the 95 % interval of two variants.

    Effect and interval use population variances, the interval the point of Student's t
    for the smaller sample; p takes t to a normal deviate (stats.student_as_normal).
    """
    def part(name: str, prefix: str) -> list[Column]:
        x = F.when(F.col(variant) == name, F.col(metric))
        return [F.count(x).alias(f"n_{prefix}"), F.avg(x).alias(f"mean_{prefix}"), F.var_samp(x).alias(f"var_{prefix}")]

    a = df.agg(*part(control, "a"), *part(treatment, "b"))
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    diff = F.col("mean_b") - F.col("mean_a")
    dof = (ea + eb) * (ea + eb) / (ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1))
    pa, pb = F.col("var_a") * (F.col("n_a") - 1) / F.col("n_a"), F.col("var_b") * (F.col("n_b") - 1) / F.col("n_b")
    out = a.select("n_a", "n_b", "mean_a", "mean_b", diff.alias("difference"), (diff / F.sqrt(ea + eb)).alias("t"), dof.alias("dof"), (diff / F.sqrt((pa + pb) / 2)).alias("effect"), F.sqrt(pa / F.col("n_a") + pb / F.col("n_b")).alias("_se"))
    half = student_point(F.least("n_a", "n_b") - 1) * F.col("_se")
    return out.withColumns({"p": normal_two_sided(student_as_normal(F.col("t"), F.col("dof"))), "low": F.col("difference") - half, "high": F.col("difference") + half}).drop("_se")


def mann_whitney(df: DataFrame, variant: str, metric: str, control: str, treatment: str) -> DataFrame:
    """u of the control, n of both, z with tie correction and its two-sided p with continuity correction, over ranks that ties share.

    Ranks come from the counts of the distinct values.
    """
    own = df.filter(F.col(variant).isin(control, treatment) & F.col(metric).isNotNull())
    n = places(own, metric, F.count_if(F.col(variant) == control).alias("a"))
    ranked = n.withColumn("c", F.col("ties")).withColumn("rank", F.col("below") + (F.col("c") + 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("a")).alias("ra"), F.sum("a").alias("na"), F.sum("c").alias("n"), F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"))
    na, nb = F.col("na").cast("double"), (F.col("n") - F.col("na")).cast("double")
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    off = u - na * nb / 2
    p = normal_two_sided(F.greatest(F.lit(0.0), F.abs(off) - 0.5) / sd)
    return s.select(F.col("na").alias("n_a"), (F.col("n") - F.col("na")).alias("n_b"), u.alias("u"), (off / sd).alias("z"), p.alias("p"))


def chi_square(df: DataFrame, variant: str, converted: str, control: str, treatment: str) -> DataFrame:
    """Rates, lift, Yates' chi-square and its p of conversions of two variants."""
    c = lambda name, hit: F.count_if((F.col(variant) == name) & (F.col(converted) if hit else ~F.col(converted))).cast("double")
    s = df.agg(c(control, True).alias("a"), c(control, False).alias("b"), c(treatment, True).alias("c"), c(treatment, False).alias("d"))
    a, b, cc, d = (F.col(x) for x in "abcd")
    n = a + b + cc + d
    off = F.greatest(F.lit(0.0), F.abs(a * d - b * cc) - n / 2)
    chi = ratio(n * off * off, (a + b) * (cc + d) * (a + cc) * (b + d), 0.0)
    ra, rb = ratio(a, a + b, 0.0), ratio(cc, cc + d, 0.0)
    return s.select(ra.alias("rate_a"), rb.alias("rate_b"), ratio(rb - ra, ra).alias("lift"), chi.alias("chi_square"), normal_two_sided(F.sqrt(chi)).alias("p"))


def sprt(df: DataFrame, variant: str, metric: str, control: str, treatment: str, effect: float = 0.1, alpha: float = 0.05, beta: float = 0.2, least: int = 10) -> DataFrame:
    """z, evidence, decision: the z-score of the difference of means times the effect over the pooled deviation, held against ln((1 - beta) / alpha) and ln(beta / (1 - alpha)); `continue` for fewer than `least` values or none that vary."""
    def part(name: str) -> list[Column]:
        x = F.when(F.col(variant) == name, F.col(metric))
        return [F.count(x), F.avg(x), F.var_pop(x)]

    own = df.agg(*[c.alias(f"{k}_{x}") for name, x in ((control, "a"), (treatment, "b")) for k, c in zip("nmv", part(name), strict=True)])
    pooled = F.sqrt((F.col("v_a") + F.col("v_b")) / 2)
    enough = (F.least("n_a", "n_b") >= least) & (pooled > 0)
    z = F.when(enough, (F.col("m_b") - F.col("m_a")) / (pooled * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))))
    out = own.select(F.coalesce(z, F.lit(0.0)).alias("z"), F.coalesce(z * effect / pooled, F.lit(0.0)).alias("evidence"))
    decision = F.when(F.col("evidence") >= F.ln(F.lit((1 - beta) / alpha)), "stop_treatment_wins").when(F.col("evidence") <= F.ln(F.lit(beta / (1 - alpha))), "stop_control_wins").otherwise("continue")
    return out.withColumn("decision", decision)


def business_kpis(events: DataFrame, shown: str = "view", clicked: str = "click", bought: str = "purchase") -> DataFrame:
    """Click-through rate, conversion, revenue a user."""
    k = F.col("event_type")
    a = events.agg(F.count_if(k == shown).alias("s"), F.count_if(k == clicked).alias("c"), F.count_if(k == bought).alias("b"), F.sum(F.when(k == bought, F.col("value"))).alias("revenue"), F.countDistinct("user_id").alias("users"))
    return a.select(ratio(F.col("c"), F.col("s"), 0.0).alias("ctr"), ratio(F.col("b"), F.col("c"), 0.0).alias("conversion"), ratio(F.coalesce("revenue", F.lit(0.0)), F.col("users"), 0.0).alias("revenue_per_user"), "users")


def retention(events: DataFrame, middle: str) -> DataFrame:
    """Users before and after a time, of the former those who came again, and their share."""
    a = events.groupBy("user_id").agg(F.max((F.col("ts") < F.lit(middle).cast("timestamp")).cast("int")).alias("before"), F.max((F.col("ts") >= F.lit(middle).cast("timestamp")).cast("int")).alias("after"))
    s = a.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("first"), F.coalesce(F.sum("after"), F.lit(0)).alias("second"), F.count_if((F.col("before") == 1) & (F.col("after") == 1)).alias("retained"))
    return s.withColumn("retention", ratio(F.col("retained"), F.col("first"), 0.0))


def metric_rollup(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """start, n, mean, highest, p95, p99 of the values of each window, and a grade of p95 (under 50 A, 100 B, 200 C, 500 D, else F)."""
    a = events.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("highest"), F.percentile("value", F.array(F.lit(0.95), F.lit(0.99))).alias("p"))
    p95 = F.col("p")[0]
    return a.select(F.col("w.start").alias("start_ts"), "n", "mean", "highest", p95.alias("p95"), F.col("p")[1].alias("p99"), F.when(p95 < 50, "A").when(p95 < 100, "B").when(p95 < 200, "C").when(p95 < 500, "D").otherwise("F").alias("grade"))


def metric_anomaly(series: DataFrame, before: int = 20, limit: float = 3.0) -> DataFrame:
    """Adds mean and deviation of the values before, z, reason: rows of (metric, ts, value) off by more than `limit` deviations."""
    w = W.partitionBy("metric").orderBy("ts").rowsBetween(-before, -1)
    out = series.withColumns({"mean": F.avg("value").over(w), "deviation": F.stddev_samp("value").over(w)})
    z = ratio(F.col("value") - F.col("mean"), F.col("deviation"))
    return out.withColumn("z", z).withColumn("reason", F.when(F.col("z") > limit, "high").when(F.col("z") < -limit, "low"))


def metric_trends(series: DataFrame, last: int = 60) -> DataFrame:
    """metric, slope a step, first, current, change over the last rows of (metric, ts, value)."""
    i = F.row_number().over(W.partitionBy("metric").orderBy(F.desc("ts")))
    own = series.withColumn("i", i).filter(F.col("i") <= last)
    a = own.groupBy("metric").agg(F.regr_slope("value", -F.col("i").cast("double")).alias("slope"), F.max_by("value", "i").alias("first"), F.min_by("value", "i").alias("current"))
    return a.withColumn("change", ratio(F.col("current") - F.col("first"), F.abs("first")))


def alert_rules(series: DataFrame, rules: DataFrame, minutes: int = 60) -> DataFrame:
    """rule, metric, ts, value of the alerts: rows that break a rule (metric, op, threshold, severity), but those within the minutes of the alert before.

    The cool-down depends on the alerts given, so it is folded over each
    rule's breaches in order.
    """
    broken = series.join(F.broadcast(rules), "metric").filter(F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold")))
    own = broken.groupBy("rule", "metric", "severity").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("x"))
    none = F.array().cast("array<struct<ts:timestamp,value:double>>")
    quiet = F.expr(f"interval {minutes} minutes")
    kept = F.aggregate("x", none, lambda acc, e: F.when((F.size(acc) == 0) | (e["ts"] >= F.element_at(acc, -1)["ts"] + quiet), F.concat(acc, F.array(e))).otherwise(acc))
    return own.select("rule", "metric", "severity", F.inline(kept))
