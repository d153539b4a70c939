"""Reports over tables, lists, sessions and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import as_of, percentiles, ratio, top
from .cleaning import skewness


def quality_dashboard(interactions: DataFrame, users: DataFrame, days: int = 30, when: str | None = None) -> DataFrame:
    """engagement (users with events), rating_coverage, freshness (share of events of the last days), score (their mean), grade (A from .9, B .7, C .5, else D)."""
    own = as_of(interactions, when)
    a = own.agg(F.countDistinct("user_id").alias("active"), F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), F.count_if(F.col("ts") >= F.col("as_of") - F.expr(f"interval {days} days")).alias("fresh"))
    row = a.crossJoin(F.broadcast(users.agg(F.count(F.lit(1)).alias("users"))))
    e, r, f = ratio(F.col("active"), F.col("users"), 0.0), ratio(F.col("rated"), F.col("n"), 0.0), ratio(F.col("fresh"), F.col("n"), 0.0)
    s = (e + r + f) / 3
    return row.select(e.alias("engagement"), r.alias("rating_coverage"), f.alias("freshness"), s.alias("score"), F.when(s >= 0.9, "A").when(s >= 0.7, "B").when(s >= 0.5, "C").otherwise("D").alias("grade"))


def distribution(items: DataFrame, column: str) -> DataFrame:
    """n, mean, median, deviation, lowest, highest, skew of a column."""
    row = items.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("deviation"), F.min(column).alias("lowest"), F.max(column).alias("highest"), skewness(column).alias("skew"))
    median = percentiles(items, column, [0.5]).select(F.col("_q")[0].alias("median"))
    return row.crossJoin(F.broadcast(median)).select("n", "mean", "median", "deviation", "lowest", "highest", "skew")


def impute_domain(df: DataFrame, numeric: dict[str, float], text: dict[str, str]) -> DataFrame:
    """Null numbers take the column's median, or the given default where all are null; null texts take theirs."""
    out = df
    for c, default in numeric.items():
        out = out.crossJoin(F.broadcast(percentiles(df, c, [0.5]))).withColumn(c, F.coalesce(c, F.col("_q")[0], F.lit(default))).drop("_q")
    return out.fillna(text)


def issue_rollup(issues: DataFrame, least: int = 3) -> DataFrame:
    """field, issues, worst level, flagged (more than `least`) of rows (field, level)."""
    order = F.when(F.col("level") == "CRITICAL", 3).when(F.col("level") == "ERROR", 2).otherwise(1)
    a = issues.groupBy("field").agg(F.count(F.lit(1)).alias("issues"), F.max(order).alias("w"))
    return a.select("field", "issues", F.when(F.col("w") == 3, "CRITICAL").when(F.col("w") == 2, "ERROR").otherwise("WARNING").alias("worst"), (F.col("issues") > least).alias("flagged"))


def session_bigrams(sessions: DataFrame, kind: str, least: int = 3) -> DataFrame:
    """user_id, first, second, n, p (share of the followers of first): pairs of kinds that stand together at least so often."""
    follow = F.lead(kind).over(W.partitionBy("user_id", "session").orderBy("ts", "event_id"))
    n = sessions.select("user_id", F.col(kind).alias("first"), follow.alias("second")).filter("second is not null").groupBy("user_id", "first", "second").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("user_id", "first"))).filter(F.col("n") >= least)


def sequence_stats(sessions: DataFrame, kind: str) -> DataFrame:
    """kind, n, starts: how often a kind occurs and how often it begins a session."""
    first = F.row_number().over(W.partitionBy("user_id", "session").orderBy("ts", "event_id")) == 1
    return sessions.withColumn("_f", first).groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_f").alias("starts"))


def list_diversity(lists: DataFrame, content: DataFrame) -> DataFrame:
    """user_id, items, types, largest share of a type in the user's list."""
    own = lists.join(content.select(F.col("content_id").alias("item_id"), "content_type"), "item_id")
    n = own.groupBy("user_id", "content_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("types"), (F.max("n") / F.sum("n")).alias("largest_share"))


def temporal_metrics(lists: DataFrame, years: DataFrame, year_now: int) -> DataFrame:
    """user_id, deviation and range of the items' years, freshness 1 / (1 + mean age)."""
    own = lists.join(years, "item_id")
    return own.groupBy("user_id").agg(F.stddev_pop("year").alias("deviation"), (F.max("year") - F.min("year")).alias("year_range"), (1 / (1 + F.avg(year_now - F.col("year")))).alias("freshness"))


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """metric, severity, alerts, mean hours between them."""
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(W.partitionBy("metric", "severity").orderBy("ts")))) / 3.6e9
    return alerts.withColumn("_gap", gap).groupBy("metric", "severity").agg(F.count(F.lit(1)).alias("alerts"), F.avg("_gap").alias("mean_hours"))


def key_statistics(vectors: DataFrame, key: str, value: str, n: int = 20) -> DataFrame:
    """key, users, mean value: the keys that most users have."""
    return vectors.groupBy(key).agg(F.countDistinct("user_id").alias("users"), F.avg(value).alias("mean")).orderBy(F.desc("users"), key).limit(n)


def hit_rate_of_next(sessions: DataFrame, transitions: DataFrame, kind: str, n: int = 2) -> DataFrame:
    """sessions, hits, rate: sessions of two events or more whose last kind is among the n likeliest followers of the one before."""
    w = W.partitionBy("user_id", "session").orderBy(F.desc("ts"), F.desc("event_id"))
    own = sessions.withColumn("_i", F.row_number().over(w)).filter("_i <= 2").groupBy("user_id", "session").agg(F.max(F.when(F.col("_i") == 1, F.col(kind))).alias("last"), F.max(F.when(F.col("_i") == 2, F.col(kind))).alias("before")).filter("before is not null")
    best = top(transitions, ["current"], [F.desc("p"), F.col("next")], n).select(F.col("current").alias("before"), F.col("next").alias("last"), F.lit(1).alias("hit"))
    a = own.join(best, ["before", "last"], "left").agg(F.count(F.lit(1)).alias("sessions"), F.count("hit").alias("hits"))
    return a.withColumn("rate", ratio(F.col("hits"), F.col("sessions"), 0.0))


def feature_set_report(sets: dict[str, DataFrame]) -> DataFrame:
    """feature_set, category (the kind of features its name holds, else other), rows, columns, numeric, categorical (text), missing_percent over all cells; one aggregate a set, 0 for an empty one."""
    out = None
    for name, df in sets.items():
        kinds = [f.dataType.typeName().split("(")[0] for f in df.schema]
        numeric = sum(k in ("byte", "short", "integer", "long", "float", "double", "decimal") for k in kinds)
        category = next((k for k in ("content", "user", "interaction", "temporal", "similarity") if k in name), "other")
        missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
        a = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing"))
        row = a.select(F.lit(name).alias("feature_set"), F.lit(category).alias("category"), "rows", F.lit(len(kinds)).alias("columns"), F.lit(numeric).alias("numeric"), F.lit(kinds.count("string")).alias("categorical"), ratio(F.col("missing") * 100.0, F.col("rows") * len(kinds), 0.0).alias("missing_percent"))
        out = row if out is None else out.unionByName(row)
    return out


def content_vectors(items: DataFrame, key: str, lists: list[str], texts: list[str], numbers: list[str], long: int = 20, words: int = 10) -> DataFrame:
    """key, feature, value: an item's attributes as a sparse vector.

    Members of lists and texts of up to `long` characters weigh 1; of longer texts the first
    `words` words weigh one over all their words; numbers keep their value. Equal features
    count once; null attributes and null members give none.
    """
    pair = lambda feature, value: F.struct(feature.alias("feature"), value.cast("double").alias("value"))

    def pairs(values: Column, prefix: str, weight: Column) -> Column:
        return F.transform(values, lambda v: pair(F.concat(F.lit(prefix), v), weight))

    parts = [pairs(F.col(c), f"{c}_", F.lit(1.0)) for c in lists]
    for c in texts:
        split = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
        many = pairs(F.slice(split, 1, words), f"{c}_word_", 1 / F.nullif(F.size(split), F.lit(0)))
        parts.append(F.when(F.length(c) > long, many).when(F.col(c).isNotNull(), F.array(pair(F.concat(F.lit(f"{c}_"), F.col(c)), F.lit(1.0)))))
    parts += [F.when(F.col(c).isNotNull(), F.array(pair(F.lit(f"{c}_numeric"), F.col(c)))) for c in numbers]
    rows = F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))
    return items.select(key, F.inline(F.array_distinct(F.filter(rows, lambda r: r["feature"].isNotNull()))))
