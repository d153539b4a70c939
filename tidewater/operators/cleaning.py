"""Imputation, outliers, scaling, encoding and time features.

Fitted values (means, quantiles) come from one aggregate and join back as one
row; nothing is collected. Nulls are ignored by the statistics and stay null
unless they are what is filled in. A constant column scales to 0 (0.5 for
ratings) and has no outliers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal_point, percentiles, places, ratio


def _with(df: DataFrame, *aggs: Column) -> DataFrame:
    """df with the aggregates of all its rows, which are one row."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent non-null value, the smallest on ties, as one row `mode`."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("mode"))


def skewness(column: str) -> Column:
    """Sample-adjusted skewness."""
    n = F.count(column)
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(column))


def impute_default_strategy(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """field, null_share, strategy: drop above half nulls, else median for skewed and mean for other numbers, mode for texts."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in [*numeric, *text]:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
    aggs += [skewness(c).alias(f"skew_{c}") for c in numeric]
    rows = []
    for c in [*numeric, *text]:
        share = ratio(F.col(f"null_{c}"), F.col("n"))
        known = F.when(F.abs(f"skew_{c}") > 1, "median").otherwise("mean") if c in numeric else F.lit("mode")
        rows.append(F.struct(F.lit(c).alias("field"), share.alias("null_share"), F.when(share > 0.5, "drop").otherwise(known).alias("strategy")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def impute_stat(df: DataFrame, column: str, how: str, value: object = None) -> DataFrame:
    """Nulls of a column become its mean, median, mode or a constant, or their rows go (how = drop)."""
    if how == "drop":
        return df.filter(F.col(column).isNotNull())
    if how == "constant":
        return df.withColumn(column, F.coalesce(column, F.lit(value)))
    if how == "mode":
        fill = df.select(column).transform(lambda d: mode(d, column)).withColumnRenamed("mode", "_fill")
        # a column without values has no mode: the outer join keeps the rows
        return df.join(F.broadcast(fill), how="left").withColumn(column, F.coalesce(column, "_fill")).drop("_fill")
    fill = df.agg(F.avg(column).alias("_fill")) if how == "mean" else percentiles(df, column, [0.5]).select(F.col("_q")[0].alias("_fill"))
    return df.crossJoin(F.broadcast(fill)).withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def impute_fill(df: DataFrame, column: str, keys: list[str], order: list[str], forward: bool = True) -> DataFrame:
    """Nulls take the last known value before them (or the next after) in their key's order."""
    w = W.partitionBy(*keys).orderBy(*order)
    known = F.last(column, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)) if forward else F.first(column, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return df.withColumn(column, known)


def impute_interpolate(df: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    """Nulls between two known values lie on the line between them, by position; after the last known value they repeat it."""
    w = W.partitionBy(*keys).orderBy(*order)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(column).isNotNull(), F.col("_i"))
    out = df.withColumn("_i", F.row_number().over(w))
    out = out.select("*", F.last(column, True).over(before).alias("_a"), F.first(column, True).over(after).alias("_b"), F.last(at, True).over(before).alias("_ia"), F.first(at, True).over(after).alias("_ib"))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_i") - F.col("_ia")) / F.nullif(F.col("_ib") - F.col("_ia"), F.lit(0))
    return out.withColumn(column, F.coalesce(column, line, F.when(F.col("_b").isNull(), F.col("_a")))).drop("_i", "_a", "_b", "_ia", "_ib")


def outlier_iqr(df: DataFrame, column: str, factor: float = 1.5, far: float = 3.0) -> DataFrame:
    """Adds is_outlier (outside the quartiles by factor times their distance) and severity (high beyond `far`, else medium)."""
    out = df.crossJoin(F.broadcast(percentiles(df, column, [0.25, 0.75]))).withColumn("_d", F.col("_q")[1] - F.col("_q")[0])
    off = F.greatest(F.col("_q")[0] - F.col(column), F.col(column) - F.col("_q")[1])
    bad = F.coalesce(off > factor * F.col("_d"), F.lit(False))
    return out.withColumn("is_outlier", bad).withColumn("severity", F.when(bad & (off > far * F.col("_d")), "high").when(bad, "medium")).drop("_q", "_d")


def outlier_zscore(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Adds z (by the population deviation; 0 for a constant column) and is_outlier."""
    out = _with(df, F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = F.when(F.col("_s") == 0, F.col(column) * 0.0).otherwise((F.col(column) - F.col("_m")) / F.nullif("_s", F.lit(0.0)))
    return out.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("_m", "_s")


#: Fixed plausible ranges by what a column's name holds.
DOMAINS = {"age": (0, 120), "rating": (0, 10), "duration": (0, 1440), "year": (1900, 2030)}


def outlier_domain(df: DataFrame, column: str) -> DataFrame:
    """Adds is_outlier: outside the range that the column's name suggests; no name, no outliers."""
    low, high = next((r for name, r in DOMAINS.items() if name in column.lower()), (None, None))
    bad = F.lit(False) if low is None else F.coalesce(~F.col(column).between(low, high), F.lit(False))
    return df.withColumn("is_outlier", bad)


def outlier_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, method, outliers, percent over all rows, for the quartile and the z-score method."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    both = df.crossJoin(F.broadcast(df.agg(*aggs)))
    for c in columns:
        both = both.crossJoin(F.broadcast(percentiles(df, c, [0.25, 0.75], f"q_{c}")))
    counts = [F.first("n").alias("n")]
    for c in columns:
        q, d = F.col(f"q_{c}"), F.col(f"q_{c}")[1] - F.col(f"q_{c}")[0]
        counts.append(F.count_if((F.col(c) < q[0] - 1.5 * d) | (F.col(c) > q[1] + 1.5 * d)).alias(f"iqr_{c}"))
        counts.append(F.count_if(F.abs(F.col(c) - F.col(f"m_{c}")) > 3 * F.col(f"s_{c}")).alias(f"zscore_{c}"))
    rows = [F.struct(F.lit(c).alias("field"), F.lit(m).alias("method"), F.col(f"{m}_{c}").alias("outliers"), ratio(F.col(f"{m}_{c}") * 100.0, F.col("n")).alias("percent")) for c in columns for m in ("iqr", "zscore")]
    return both.agg(*counts).select(F.inline(F.array(*rows)))


def outlier_cap(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values beyond the two percentiles become these."""
    out = df.crossJoin(F.broadcast(percentiles(df, column, [low, high])))
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col(column))))).drop("_q")


def outlier_winsorize(df: DataFrame, column: str, low: float = 0.05, high: float = 0.05) -> DataFrame:
    """The lowest and highest shares of the values become the nearest value that is kept.

    The two order statistics come from the places of the distinct values.
    """
    upto, n = F.col("below") + F.col("ties"), F.col("total")
    ends = places(df, column).agg(F.min(F.when(upto > F.floor(n * low), F.col(column))).alias("_low"), F.min(F.when(upto >= n - F.floor(n * high), F.col(column))).alias("_high"))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, F.when(F.col(column).isNotNull(), F.greatest("_low", F.least("_high", column)))).drop("_low", "_high")


def transform_log(df: DataFrame, column: str, name: str) -> DataFrame:
    """Natural logarithm, after a shift by |min| + 1 where a value is not positive."""
    out = _with(df, F.min(column).alias("_min"))
    return out.withColumn(name, F.ln(F.col(column) + F.when(F.col("_min") <= 0, F.abs("_min") + 1).otherwise(0))).drop("_min")


def transform_boxcox(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds <name> and <name>_lambda: the Box-Cox transform with the exponent of the largest likelihood, after a shift by |min| + 1 where a value is not positive.

    The exponent is sought from -2 to 2 in steps of 0.25, then of 0.025 and of 0.0025
    around the best; each pass is one aggregate. Equal likelihoods take the smaller one.
    """
    out = _with(df, F.min(column).alias("_min"))
    out = out.withColumn("_x", F.col(column).cast("double") + F.when(F.col("_min") <= 0, F.abs("_min") + 1).otherwise(0)).withColumn("_best", F.lit(0.0))

    def power(at: Column) -> Column:
        return F.when(F.abs(at) < 1e-9, F.ln("_x")).otherwise((F.pow(F.col("_x"), at) - 1) / at)

    for step, reach in ((0.25, 8), (0.025, 10), (0.0025, 10)):
        at = [F.round(F.col("_best") + i * step, 4) for i in range(-reach, reach + 1)]
        fit = [F.struct((-((x - 1) * F.sum(F.ln("_x")) - F.count("_x") / 2 * F.ln(F.var_pop(power(x))))).alias("loss"), x.alias("at")) for x in at]
        # one group, as the exponents reached so far are the same in all rows
        best = out.groupBy("_best").agg(F.array_min(F.array(*fit))["at"].alias("_next"))
        out = out.crossJoin(F.broadcast(best.select("_next"))).withColumn("_best", F.col("_next")).drop("_next")
    return out.withColumn(name, power(F.col("_best"))).withColumnRenamed("_best", f"{name}_lambda").drop("_min", "_x")


def transform_quantile_normal(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds <name>: the standard normal's point at the value's share of smaller ones (ties at their middle), which is kept 1e-7 from 0 and 1."""
    share = (F.col("below") + (F.col("ties") - 1) / 2) / F.greatest(F.col("total") - 1, F.lit(1))
    p = places(df, column).select(F.col(column).alias("_at"), normal_point(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), share))).alias(name))
    return df.join(p, F.col(column) == F.col("_at"), "left").drop("_at")


def outlier_default_treatment(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, percent, treatment: cap above 20 percent of outliers, winsorize above 10, cap for ratings, log for skewed ones, else cap."""
    report = outlier_report(df, columns).filter("method = 'iqr'").select("field", "percent")
    skew = df.agg(*[skewness(c).alias(c) for c in columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("skew")) for c in columns])))
    both = report.join(F.broadcast(skew), "field")  # a row a column
    how = F.when(F.col("percent") > 20, "cap").when(F.col("percent") > 10, "winsorize").when(F.contains("field", F.lit("rating")), "cap").when(F.abs("skew") > 2, "log").otherwise("cap")
    return both.select("field", "percent", "skew", how.alias("treatment"))


def rating_minmax(df: DataFrame, column: str = "rating") -> DataFrame:
    """The rating between 0 and 1 (0.5 if all are equal), the original beside it and the scale's name."""
    out = _with(df, F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.5)).otherwise((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return out.withColumn("original_rating", F.col(column)).withColumn(column, F.when(F.col("original_rating").isNotNull(), scaled)).withColumn("rating_scale", F.lit("min-max")).drop("_lo", "_hi")


def scale_features(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Adds <column>_scaled: standard (population deviation), minmax, or robust (median and quartile distance)."""
    if method == "robust":
        out = df
        for c in columns:
            q = percentiles(df, c, [0.25, 0.5, 0.75]).select(F.col("_q")[1].alias(f"_m_{c}"), (F.col("_q")[2] - F.col("_q")[0]).alias(f"_s_{c}"))
            out = out.crossJoin(F.broadcast(q))
    else:
        pairs = {c: {"standard": (F.avg(c), F.stddev_pop(c)), "minmax": (F.min(c), F.max(c) - F.min(c))}[method] for c in columns}
        out = _with(df, *[x for c, (mid, span) in pairs.items() for x in (mid.alias(f"_m_{c}"), span.alias(f"_s_{c}"))])
    for c in columns:
        out = out.withColumn(f"{c}_scaled", (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def encode_label(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>_encoded: the number of the value among the sorted distinct values, from 0; null for null.

    The distinct values are numbered in bins, and these join back.
    """
    codes = places(df, column).select(F.col(column).alias("_v"), F.col("number").cast("int").alias(f"{column}_encoded"))
    return df.join(codes, F.col(column) == F.col("_v"), "left").drop("_v")


def encode_onehot(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """One 0/1 column a value, for each key."""
    return df.groupBy(key).agg(*[F.max((F.col(column) == v).cast("int")).alias(f"{column}_{v}") for v in values])


def encode_target(df: DataFrame, column: str, target: str) -> DataFrame:
    """Adds <column>_target: the mean of the target over the rows of the same value."""
    means = df.groupBy(F.col(column).alias("_v")).agg(F.avg(target).alias(f"{column}_target"))
    return df.join(means, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


def temporal_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the parts of the time (Monday is 0), their sines and cosines, the time of day, days before the last row, and recency 1 / (1 + days)."""
    out = _with(df, F.max(ts).alias("_last"))
    hour, day, month = F.hour(ts), F.weekday(ts), F.month(ts)
    turn = lambda x, n: 2 * math.pi * x / n
    part = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    days = F.floor((F.unix_timestamp("_last") - F.unix_timestamp(ts)) / 86400)
    return out.select(
        *df.columns, hour.alias("hour"), day.alias("day_of_week"), month.alias("month"), F.year(ts).alias("year"), (day >= 5).alias("is_weekend"),
        F.sin(turn(hour, 24)).alias("hour_sin"), F.cos(turn(hour, 24)).alias("hour_cos"), F.sin(turn(day, 7)).alias("day_sin"), F.cos(turn(day, 7)).alias("day_cos"), F.sin(turn(month, 12)).alias("month_sin"), F.cos(turn(month, 12)).alias("month_cos"),
        part.alias("time_of_day"), days.alias("days_since"), (1 / (1 + days)).alias("recency"),
    )


def preprocess(df: DataFrame, numeric: list[str], text: list[str], ts: str) -> DataFrame:
    """Median and mode imputation, capping, time features, label codes and standard scores, in this order."""
    for c in numeric:
        df = outlier_cap(impute_stat(df, c, "median"), c)
    for c in text:
        df = encode_label(impute_stat(df, c, "mode"), c)
    return scale_features(temporal_features(df, ts), numeric)
