"""Short- and long-term preferences, their evolution, and drift.

Time windows end at as_of, which defaults to the latest event. Vectors are kept
in long form (user, key, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import as_of, clip, ratio, top
from ..functions.tables import kept

#: Fixed weights of interaction types.
WEIGHTS = {"purchase": 1.0, "click": 0.6, "view": 0.4, "signup": 0.5}


def type_weight(column: str = "interaction_type") -> Column:
    """The type's weight, 0.3 for others."""
    out = F.lit(0.3)
    for name, w in WEIGHTS.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out


def decayed_vector(interactions: DataFrame, hours: float, rate: float, when: str | None = None) -> DataFrame:
    """user_id, item_id, weight: sums of exp(-rate * hours) * type weight * rating / 5 over the last hours, divided by the user's largest."""
    own = as_of(interactions, when)
    age = (F.unix_micros("as_of") - F.unix_micros("ts")) / 3.6e9
    own = own.withColumn("age", age).filter((F.col("age") <= hours) & (F.col("age") >= 0))
    w = own.groupBy("user_id", "item_id").agg(F.sum(F.exp(-rate * F.col("age")) * type_weight() * F.col("rating") / 5).alias("w"))
    return w.select("user_id", "item_id", ratio(F.col("w"), F.max("w").over(W.partitionBy("user_id")), 0.0).alias("weight"))


def trending_for_user(interactions: DataFrame, hours: int, when: str | None = None) -> DataFrame:
    """user_id, key, gain: the key's share in the newer half of the last hours less that in the older half, where positive."""
    own = as_of(interactions, when).filter(F.col("ts") >= F.col("as_of") - F.expr(f"interval {hours} hours"))
    new = F.col("ts") >= F.col("as_of") - F.expr(f"interval {hours * 30} minutes")
    n = own.groupBy("user_id", F.col("interaction_type").alias("key")).agg(F.count_if(new).alias("a"), F.count_if(~new).alias("b"))
    w = W.partitionBy("user_id")
    gain = ratio(F.col("a"), F.sum("a").over(w), 0.0) - ratio(F.col("b"), F.sum("b").over(w), 0.0)
    return n.select("user_id", "key", gain.alias("gain")).filter("gain > 0")


def volatility(sessions: DataFrame, item: str, last: int = 5) -> DataFrame:
    """user_id, volatility: the deviation of the items' entropy over the user's last sessions."""
    n = sessions.groupBy("user_id", "session", item).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("user_id", "session"))
    h = n.withColumn("p", p).groupBy("user_id", "session").agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    return top(h, ["user_id"], [F.desc("session")], last).groupBy("user_id").agg(F.stddev_pop("h").alias("volatility"))


def horizons(interactions: DataFrame, content: DataFrame, days: tuple[int, ...] = (7, 30, 180, 365), least: int = 2, when: str | None = None) -> DataFrame:
    """user_id, horizon, genre, value (mean of (rating - 2.5) / 2.5), confidence 0.7 * min(1, n / 5) + 0.3 * min(1, |value|), for each number of days; genres with fewer events are left out."""
    own = as_of(interactions, when).join(content.select(F.col("content_id").alias("item_id"), "genres"), "item_id")
    each = own.select("user_id", ((F.col("rating") - 2.5) / 2.5).alias("x"), F.datediff("as_of", "ts").alias("age"), F.explode("genres").alias("genre"))
    wide = each.select("*", F.explode(F.filter(F.array(*map(F.lit, days)), lambda d: F.col("age") < d)).alias("horizon"))
    a = wide.groupBy("user_id", "horizon", "genre").agg(F.avg("x").alias("value"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    confidence = 0.7 * F.least(F.lit(1.0), F.col("n") / 5) + 0.3 * F.least(F.lit(1.0), F.abs("value"))
    return a.withColumn("confidence", confidence)


def time_of_day(interactions: DataFrame, least: int = 10) -> DataFrame:
    """user_id, shares of morning, evening, night and weekend events, for users with enough."""
    h = F.hour("ts")
    share = lambda c: F.avg(c.cast("double"))
    a = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), share((h >= 6) & (h < 12)).alias("morning"), share((h >= 18) & (h < 23)).alias("evening"), share((h >= 23) | (h < 6)).alias("night"), share(F.weekday("ts") >= 5).alias("weekend"))
    return a.filter(F.col("n") >= least)


def normalised_entropy(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """user_id, entropy of the values shifted above 0, over its largest; 0 for one key."""
    w = W.partitionBy("user_id")
    shifted = F.col(value) - F.min(value).over(w) + 0.01
    own = vectors.withColumn("_s", shifted).withColumn("_p", F.col("_s") / F.sum("_s").over(w))
    a = own.groupBy("user_id").agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("h"), F.count(F.lit(1)).alias("n"))
    return a.select("user_id", F.when(F.col("n") > 1, F.col("h") / F.ln(F.col("n").cast("double"))).otherwise(0.0).alias("entropy"))


#: Rows of a task that orders or groups what it holds by user: their memory bounds the task's.
ROWS = 500_000


def by_user(df: DataFrame, rows: int) -> DataFrame:
    """df dealt by user to as many partitions as its rows need; small shuffles of well-packed rows would be merged to fewer."""
    return df.repartition(max(1, -(-rows // ROWS)), "user_id")


def snapshots(interactions: DataFrame, content: DataFrame, days: int = 90) -> DataFrame:
    """user_id, period, genre, value: mean rating over 5 of each genre in each period of days from the user's first event."""
    first = interactions.groupBy("user_id").agg(F.min("ts").alias("first"))
    own = interactions.join(first, "user_id").withColumn("period", F.floor(F.datediff("ts", "first") / days).cast("int"))
    own = kept(own.join(content.select(F.col("content_id").alias("item_id"), "genres"), "item_id").select("user_id", "period", "rating", "genres"), "rated")
    rows = own.agg(F.sum(F.size("genres"))).first()[0] or 0
    each = by_user(own.select("user_id", "period", "rating", F.explode("genres").alias("genre")), rows)
    return each.groupBy("user_id", "period", "genre").agg((F.avg("rating") / 5).alias("value"))


def evolution_series(snaps: DataFrame, drawn: int = 5, least: float = 0.1) -> DataFrame:
    """snaps with what a chart of them draws: place, the genre's among the user's by its mean value, shown (one of the first places), change from its first to its last value (null for one value) and direction, increased or decreased by more than `least`, stable if not."""
    own = kept(snaps, "series")
    dealt = by_user(own, own.count())
    same = W.partitionBy("user_id", "genre")
    ends = [F.round(f("value", "period").over(same), 9) for f in (F.max_by, F.min_by)]
    each = dealt.select("user_id", "period", "genre", "value", F.round(F.avg("value").over(same), 9).alias("_mean"), F.when(F.count(F.lit(1)).over(same) > 1, F.round(ends[0] - ends[1], 9)).alias("change"))
    # rows of a genre share a place
    each = each.withColumn("place", F.dense_rank().over(W.partitionBy("user_id").orderBy(F.desc("_mean"), "genre")))
    direction = F.when(F.col("change") > least, "increased").when(F.col("change") < -least, "decreased").when(F.col("change").isNotNull(), "stable")
    return each.select("user_id", "period", "genre", "value", "place", (F.col("place") <= drawn).alias("shown"), "change", direction.alias("direction"))


def _numbered(snaps: DataFrame) -> DataFrame:
    """Snapshots with their number in order of the user's periods, dealt by user: what follows needs no other order."""
    own = kept(snaps, "snapshots")
    n = F.dense_rank().over(W.partitionBy("user_id").orderBy("period"))
    return by_user(own, own.count()).withColumn("n", n).filter("user_id is not null and period is not null")


def stability(snaps: DataFrame) -> DataFrame:
    """user_id, stability: the mean cosine of consecutive snapshots."""
    same = W.partitionBy("user_id", "genre").orderBy("n")
    own = _numbered(snaps).select("user_id", "n", "value", F.when(F.col("genre").isNotNull() & (F.lead("n").over(same) == F.col("n") + 1), F.lead("value").over(same)).alias("next"))
    a = own.groupBy("user_id", "n").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.coalesce(F.sum(F.col("value") * F.col("next")), F.lit(0.0)).alias("dot"))
    after = W.partitionBy("user_id").orderBy("n")
    pairs = a.select("user_id", "dot", "norm", F.lead("norm").over(after).alias("norm2"), F.lead("n").over(after).alias("after")).filter("after is not null")
    return pairs.groupBy("user_id").agg(F.avg(ratio(F.col("dot"), F.col("norm") * F.col("norm2"), 0.0)).alias("stability"))


def changes(snaps: DataFrame, least: float = 0.2) -> DataFrame:
    """user_id, genre, change (new, removed, increase, decrease), difference between the user's last two snapshots, above `least`."""
    own = _numbered(snaps)
    own = own.withColumn("last", F.max("n").over(W.partitionBy("user_id"))).filter(F.col("n") >= F.col("last") - 1)
    both = own.groupBy("user_id", "genre").agg(F.max(F.when(F.col("n") == F.col("last"), F.col("value"))).alias("now"), F.max(F.when(F.col("n") < F.col("last"), F.col("value"))).alias("before"), F.max("last").alias("last")).filter("last > 1")
    d = F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    kind = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").when(d > 0, "increase").otherwise("decrease")
    return both.select("user_id", "genre", kind.alias("change"), d.alias("difference")).filter(F.abs("difference") > least)


def trend(series: DataFrame, key: list[str], last: int = 3) -> DataFrame:
    """key, slope and next value of a line through the last points of (key, t, value), between -1 and 1."""
    own = top(series, key, [F.desc("t")], last)
    a = own.groupBy(*key).agg(F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("start"), F.max("t").alias("t"), F.count(F.lit(1)).alias("n"))
    return a.select(*key, "slope", clip(F.col("start") + F.col("slope") * (F.col("t") + 1), -1.0, 1.0).alias("forecast"), "n").filter("slope is not null")


def change_points(series: DataFrame, key: list[str], width: int = 20, limit: float = 3.0) -> DataFrame:
    """Rows of (key, t, value) where the mean of the width before and that of the width from here differ by a t of more than the limit."""
    w = W.partitionBy(*key).orderBy("t")
    before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    own = series
    for name, frame in (("a", before), ("b", after)):
        own = own.withColumns({f"n_{name}": F.count("value").over(frame), f"m_{name}": F.avg("value").over(frame), f"v_{name}": F.var_samp("value").over(frame)})
    t = ratio(F.col("m_b") - F.col("m_a"), F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b")))
    full = own.filter((F.col("n_a") == width) & (F.col("n_b") == width)).withColumn("t_value", t)
    return full.filter(F.abs("t_value") > limit).select(*key, "t", (F.col("m_b") - F.col("m_a")).alias("magnitude"), "t_value")


def asof_join(left: DataFrame, right: DataFrame, key: list[str], seconds: int) -> DataFrame:
    """left with the value of right nearest in time, within the seconds, ties to the earlier.

    Both sides are dealt to time buckets as wide as the tolerance, the right
    side to its own bucket and the two beside it.
    """
    bucket = F.floor(F.unix_micros("ts") / (seconds * 1_000_000))
    a = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_b", bucket)
    b = right.select(*key, F.col("ts").alias("_ts"), "value", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    gap = F.abs(F.unix_micros("ts") - F.unix_micros("_ts"))
    near = a.join(b, [*key, "_b"]).withColumn("_gap", gap).filter(F.col("_gap") <= seconds * 1_000_000)
    best = near.groupBy(*left.columns, "_row").agg(F.min(F.struct("_gap", "_ts", "value")).alias("_x"))
    return best.select(*left.columns, F.col("_x.value").alias("value"), (F.col("_x._gap") / 1e6).alias("gap_seconds"))


def seasonality(series: DataFrame, key: list[str], hours: tuple[int, ...] = (24, 168)) -> DataFrame:
    """key, period, amplitude, r2 of sine and cosine of each period, by the normal equations of (key, t in hours, value)."""
    own = series.withColumn("period", F.explode(F.array(*map(F.lit, hours))))
    angle = 2 * F.pi() * F.col("t") / F.col("period")
    own = own.withColumns({"s": F.sin(angle), "c": F.cos(angle), "y": F.col("value")})
    a = own.groupBy(*key, "period").agg(F.covar_pop("s", "y").alias("sy"), F.covar_pop("c", "y").alias("cy"), F.covar_pop("s", "c").alias("sc"), F.var_pop("s").alias("ss"), F.var_pop("c").alias("cc"), F.var_pop("y").alias("yy"))
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    b1 = ratio(F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc"), det)
    b2 = ratio(F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc"), det)
    return a.select(*key, "period", F.sqrt(b1 * b1 + b2 * b2).alias("amplitude"), ratio(b1 * F.col("sy") + b2 * F.col("cy"), F.col("yy"), 0.0).alias("r2"))


def merged_preferences(current: DataFrame, updates: DataFrame) -> DataFrame:
    """user_id, feature, value, source of current rows and the updates (value, source, action): locked rows change only by explicit updates; merge takes the mean, others replace; values lie between -1 and 1."""
    u = updates.select("user_id", "feature", clip(F.col("value"), -1.0, 1.0).alias("new"), F.col("source").alias("new_source"), "action")
    both = current.join(u, ["user_id", "feature"], "full_outer")
    keep = F.col("new").isNull() | (F.coalesce("locked", F.lit(False)) & (F.col("new_source") != "explicit"))
    value = F.when(keep, F.col("value")).when((F.col("action") == "merge") & F.col("value").isNotNull(), (F.col("value") + F.col("new")) / 2).otherwise(F.col("new"))
    return both.select("user_id", "feature", value.alias("value"), F.when(keep, F.col("source")).otherwise(F.col("new_source")).alias("source"))


def hour_drift(interactions: DataFrame, days: int = 15, when: str | None = None) -> DataFrame:
    """user_id, kl: Kullback-Leibler divergence of the hours of the last days from those of the days before, counts smoothed by 1."""
    own = as_of(interactions, when).filter(F.col("ts") >= F.col("as_of") - F.expr(f"interval {2 * days} days"))
    new = F.col("ts") >= F.col("as_of") - F.expr(f"interval {days} days")
    n = own.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count_if(new).alias("a"), F.count_if(~new).alias("b"))
    t = n.groupBy("user_id").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("k")).filter("ta > 0 and tb > 0")
    both = n.join(t, "user_id")
    p, q = (F.col("a") + 1) / (F.col("ta") + 24), (F.col("b") + 1) / (F.col("tb") + 24)
    # hours without events have 1 / (ta + 24) against 1 / (tb + 24) each
    empty = (24 - F.first("k")) * (1 / (F.first("ta") + 24)) * F.ln((F.first("tb") + 24) / (F.first("ta") + 24))
    return both.groupBy("user_id").agg((F.sum(p * F.ln(p / q)) + empty).alias("kl"))


def genre_drift(interactions: DataFrame, content: DataFrame) -> DataFrame:
    """user_id, js: Jensen-Shannon divergence of the genres' shares in the first and second half of the user's events.

    Order lines may share their number and time; they stand in the order of item and rating.
    """
    w = W.partitionBy("user_id")
    place = F.row_number().over(w.orderBy("ts", "l_orderkey", "l_linenumber", "item_id", "rating")) if "l_orderkey" in interactions.columns else F.row_number().over(w.orderBy("ts", "event_id"))
    own = interactions.withColumn("second", place > F.floor(F.count(F.lit(1)).over(w) / 2)).join(content.select(F.col("content_id").alias("item_id"), "genres"), "item_id")
    n = own.select("user_id", "second", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.count_if(~F.col("second")).alias("a"), F.count_if("second").alias("b"))
    p, q = ratio(F.col("a"), F.sum("a").over(w), 0.0), ratio(F.col("b"), F.sum("b").over(w), 0.0)
    own = n.select("user_id", p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / F.col("m"))).otherwise(0.0)
    return own.groupBy("user_id").agg(F.sum(0.5 * part("p") + 0.5 * part("q")).alias("js"))


def ks(df: DataFrame, key: list[str], value: str, second: str) -> DataFrame:
    """key, ks: the largest gap between the cumulative shares of two samples of a value, told apart by a boolean column."""
    n = df.groupBy(*key, value).agg(F.count_if(~F.col(second)).alias("a"), F.count_if(second).alias("b"))
    upto = W.partitionBy(*key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*key)
    gap = F.abs(ratio(F.sum("a").over(upto), F.sum("a").over(all_)) - ratio(F.sum("b").over(upto), F.sum("b").over(all_)))
    return n.select(*key, gap.alias("gap")).groupBy(*key).agg(F.max("gap").alias("ks")).filter("ks is not null")


def rating_drift(interactions: DataFrame, order: list[str]) -> DataFrame:
    """user_id, ks of the ratings of the first and second half of the user's events, relative change of their mean and variance, and the largest as score."""
    w = W.partitionBy("user_id")
    own = interactions.withColumn("second", F.row_number().over(w.orderBy(*order)) > F.floor(F.count(F.lit(1)).over(w) / 2))
    a = own.groupBy("user_id").agg(F.avg(F.when(~F.col("second"), F.col("rating"))).alias("ma"), F.avg(F.when(F.col("second"), F.col("rating"))).alias("mb"), F.var_pop(F.when(~F.col("second"), F.col("rating"))).alias("va"), F.var_pop(F.when(F.col("second"), F.col("rating"))).alias("vb"))
    both = ks(own, ["user_id"], "rating", "second").join(a, "user_id")
    mean, variance = F.abs(F.col("mb") - F.col("ma")) / F.col("ma"), F.coalesce(ratio(F.abs(F.col("vb") - F.col("va")), F.col("va")), F.lit(0.0))
    return both.select("user_id", "ks", mean.alias("mean_change"), variance.alias("variance_change"), F.greatest("ks", mean, variance).alias("score"))


def adwin(series: DataFrame, key: list[str], delta: float = 0.05) -> DataFrame:
    """key, n, gap of the halves' means, bound sqrt(2 var ln(2 / delta) / half), drift, over (key, t, value)."""
    w = W.partitionBy(*key)
    own = series.withColumn("second", F.row_number().over(w.orderBy("t")) > F.floor(F.count(F.lit(1)).over(w) / 2))
    a = own.groupBy(*key).agg(F.count("value").alias("n"), F.avg(F.when(~F.col("second"), F.col("value"))).alias("ma"), F.avg(F.when(F.col("second"), F.col("value"))).alias("mb"), F.var_pop("value").alias("v")).filter("n >= 4")
    bound = F.sqrt(2 * F.col("v") * F.ln(F.lit(2 / delta)) / F.floor(F.col("n") / 2))
    gap = F.abs(F.col("mb") - F.col("ma"))
    return a.select(*key, "n", gap.alias("gap"), bound.alias("bound"), (gap > bound).alias("drift"))


def page_hinkley(series: DataFrame, key: list[str], alpha: float = 0.999, tolerance: float = 0.005, limit: float = 50.0) -> DataFrame:
    """key, statistic, drift: the cumulative deviation from the running mean with forgetting, folded over each key's values in order."""
    own = series.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("v"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (alpha * acc["sum"] + (x - mean - tolerance)).alias("sum"))

    s = F.aggregate("v", start, step, lambda acc: acc["sum"])
    return own.select(*key, s.alias("statistic")).withColumn("drift", F.abs("statistic") > limit)


def evolution_trends(series: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """key, slope, r2, direction, strength of a line through all points of (key, t, value)."""
    a = series.groupBy(*key).agg(F.regr_slope("value", "t").alias("slope"), F.coalesce(F.regr_r2("value", "t"), F.lit(0.0)).alias("r2"), F.count("value").alias("n")).filter((F.col("n") >= least) & F.col("slope").isNotNull())
    direction = F.when(F.abs("slope") < 0.001, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    strength = F.when(F.col("r2") >= 0.7, "strong").when(F.col("r2") >= 0.3, "moderate").otherwise("weak")
    return a.select(*key, "slope", "r2", "n", direction.alias("direction"), strength.alias("strength"))


def lifecycle(interactions: DataFrame, when: str | None = None) -> DataFrame:
    """user_id, stage: inactive after 90 quiet days, new in the first 30 days, developing under 20 events, active with one in the last week, else regular."""
    a = as_of(interactions, when).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("as_of"), F.max("ts")).alias("quiet"), F.datediff(F.max("as_of"), F.min("ts")).alias("age"))
    stage = F.when(F.col("quiet") > 90, "inactive").when(F.col("age") < 30, "new").when(F.col("n") < 20, "developing").when(F.col("quiet") <= 7, "active").otherwise("regular")
    return a.select("user_id", "n", "quiet", "age", stage.alias("stage"))
