"""Models over whole tables: robust trends of many series, what features tell about a target, and weights chosen by a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal_two_sided, places, ratio, student_as_normal, top
from ..functions.tables import kept

#: Residuals beyond so many scales count by their size and no more by their square; penalty on the slope.
EPSILON, ALPHA = 1.35, 0.0001


def _fitter(passes: int, piece: int = 1 << 18):
    """Fits lines in a task to rows (_g, t, y) in the order of _g, some `piece` rows at a time, whole series only."""
    import numpy as np
    import pyarrow as pa

    def fit(g: np.ndarray, t: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        m = np.diff(np.r_[starts, len(g)]).astype(float)
        total = lambda x: np.add.reduceat(x, starts)
        each = lambda x: np.repeat(x, m.astype(int))
        with np.errstate(divide="ignore", invalid="ignore"):
            mt, my = total(t) / m, total(y) / m
            dt, dy = t - each(mt), y - each(my)
            vt = total(dt * dt)
            b = np.where(vt > 0, total(dt * dy) / vt, 0.0)
            a, s = my - b * mt, np.sqrt(total(dy * dy) / m)
            for _ in range(passes):
                r, limit = y - each(a) - each(b) * t, EPSILON * each(s)
                inside = np.abs(r) <= limit
                w = np.where(inside, 1.0, limit / np.abs(r))
                sw, wt, wy = total(w), total(w * t), total(w * y)
                under = total(w * t * t) - wt * wt / sw + ALPHA * s
                b = np.where(under != 0, (total(w * t * y) - wt * wy / sw) / under, 0.0)
                a = (wy - b * wt) / sw
                left = m - total(~inside * 1.0) * EPSILON * EPSILON
                s = np.where(left > 0, np.sqrt(total(np.where(inside, r * r, 0.0)) / left), s)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g[starts], b, a, s)], ["_g", "b", "a", "s"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([np.asarray(batch.column(i)) for i in range(3)])
            n += batch.num_rows
            if n >= piece:
                g, t, y = (np.concatenate(c) for c in zip(*held, strict=True))
                cut = int(np.searchsorted(g, g[-1]))  # the last series may go on
                if cut:
                    yield fit(g[:cut], t[:cut], y[:cut])
                held, n = [[g[cut:], t[cut:], y[cut:]]], len(g) - cut
        if n:
            yield fit(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _fit_long(rows: DataFrame, passes: int) -> DataFrame:
    """The same lines for few long series: each pass is one sum over the rows, added up before the shuffle, and its result is written."""
    start = rows.groupBy("_g").agg(F.coalesce(F.regr_slope("y", "t"), F.lit(0.0)).alias("b"), F.coalesce(F.regr_intercept("y", "t"), F.avg("y")).alias("a"), F.stddev_pop("y").alias("s"))
    fit = kept(start, "fit")
    for _ in range(passes):
        r = F.col("y") - F.col("a") - F.col("b") * F.col("t")
        inside = F.abs(r) <= EPSILON * F.col("s")
        # a row for every series of so many rows: fewer than rows / longest
        each = rows.join(F.broadcast(fit), "_g").withColumn("r", r).withColumn("i", inside).withColumn("w", F.when(inside, 1.0).otherwise(EPSILON * F.col("s") / F.abs(r)))
        w, t, y = F.col("w"), F.col("t"), F.col("y")
        sums = each.groupBy("_g").agg(F.sum(w).alias("w"), F.sum(w * t).alias("wt"), F.sum(w * y).alias("wy"), F.sum(w * t * t).alias("wtt"), F.sum(w * t * y).alias("wty"), F.count(F.lit(1)).alias("m"), F.count_if(~F.col("i")).alias("out"), F.sum(F.when(F.col("i"), F.col("r") * F.col("r")).otherwise(0.0)).alias("rr"), F.first("s").alias("s"))
        slope = ratio(F.col("wty") - F.col("wt") * F.col("wy") / F.col("w"), F.col("wtt") - F.col("wt") * F.col("wt") / F.col("w") + ALPHA * F.col("s"), 0.0)
        left = F.col("m") - F.col("out") * EPSILON * EPSILON
        scale = F.when(left > 0, F.sqrt(F.col("rr") / left)).otherwise(F.col("s"))
        fit = kept(sums.withColumn("b", slope).withColumn("a", (F.col("wy") - F.col("b") * F.col("wt")) / F.col("w")).select("_g", "b", "a", scale.alias("s")), "fit")
    return fit


def robust_trend(series: DataFrame, keys: list[str], as_of: Column, *, days: int = 30, least: int = 10, passes: int = 30, horizon: int = 7, level: float = 0.05, longest: int = 100_000) -> DataFrame:
    """keys, n, slope (by the hour), intercept, r2, p, trend (increasing, decreasing, volatile, stable), strength, confidence, forecast (the next `horizon` hours) of (keys, ts, value).

    A line is fitted to the rows of the last days, in hours from the series'
    first of them, by a fixed number of re-weighted least-squares passes. Rows
    whose residual is beyond 1.35 scales weigh the less the farther they are;
    the scale follows from the others. Series of at most `longest` rows are
    dealt to tasks whole and fitted there, many at a time; longer ones take a
    pass together, as sums that are written. Series with fewer than `least` rows are left out, null times and
    values do not count; a constant series has an r2 of 0 and is stable.
    """
    hours = F.unix_micros("ts") / 3.6e9
    own = series.filter(F.col("ts") > as_of - F.expr(f"interval {days} days")).filter("value is not null").select(*keys, hours.alias("_h"), F.col("value").cast("double").alias("y"))
    about = own.groupBy(*keys).agg(F.min("_h").alias("_first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    about = kept(about.withColumn("_g", F.monotonically_increasing_id()), "about")
    rows = kept(own.join(about.hint("merge"), keys).select("_g", "_n", (F.col("_h") - F.col("_first")).alias("t"), "y"), "series")

    short = rows.filter(F.col("_n") <= longest).repartition("_g").sortWithinPartitions("_g").select("_g", "t", "y")
    fit = kept(short.mapInArrow(_fitter(passes), "_g long, b double, a double, s double"), "fit")
    if not about.filter(F.col("_n") > longest).isEmpty():
        fit = fit.unionByName(_fit_long(rows.filter(F.col("_n") > longest), passes))

    e = F.col("y") - F.col("a") - F.col("b") * F.col("t")
    out = rows.join(fit.hint("merge"), "_g").groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("intercept"), F.first("b").alias("slope"), F.sum(e * e).alias("sse"), F.var_pop("y").alias("vy"), F.var_pop("t").alias("vt"), F.max("t").alias("end"))
    out = out.join(about.select(*keys, "_g").hint("merge"), "_g")
    error = F.sqrt(ratio(F.col("sse") / (F.col("n") - 2), F.col("n") * F.col("vt")))
    stat = F.coalesce(ratio(F.col("slope"), error), F.lit(0.0))
    out = out.withColumn("r2", F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("n") * F.col("vy"))).otherwise(0.0)).withColumn("p", F.when(F.col("n") > 2, normal_two_sided(student_as_normal(stat, F.col("n") - 2.0))).otherwise(1.0))
    trend = F.when(F.col("p") > level, "stable").when(F.col("r2") <= 0.7, "volatile").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    forecast = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.col("intercept") + F.col("slope") * (F.col("end") + k))
    return out.select(*keys, "n", "slope", "intercept", "r2", "p", trend.alias("trend"), F.least(F.abs("slope"), F.lit(1.0)).alias("strength"), F.greatest(F.lit(0.0), F.col("r2")).alias("confidence"), forecast.alias("forecast"))


def feature_importance(df: DataFrame, features: list[str], target: str, bins: int = 10, n: int = 20) -> DataFrame:
    """feature, correlation (absolute, null for constant features), mutual_information, rank: the n features that tell most about a target.

    Features and target are cut into bins of equally many rows, equal values
    staying together; the information is that between two such bins, by natural
    logarithms. Null features count as 0; rows without a target are left out.
    """
    own = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("_y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    own = kept(own, "features")
    long = own.select("_y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("_f")).select("_y", "_f.feature", "_f.x")
    links = long.groupBy("feature").agg(F.abs(F.corr("x", "_y")).alias("correlation"))
    # pairs of values are counted first: what is joined to the bins has a row for each of them
    pairs = kept(long.groupBy("feature", "x", "_y").agg(F.count(F.lit(1)).alias("n")), "pairs")

    def binned(value: str, name: str) -> DataFrame:
        return places(own.select(F.col(value).alias("v")), "v").select("v", F.floor(F.col("below") * bins / F.col("total")).alias(name))

    of_x = None
    for f in features:
        b = binned(f, "bx").withColumn("feature", F.lit(f))
        of_x = b if of_x is None else of_x.unionByName(b)
    of_x, of_y = kept(of_x, "bins"), kept(binned("_y", "by"), "bins")
    cells = pairs.join(of_x.withColumnRenamed("v", "x").hint("merge"), ["feature", "x"]).join(of_y.withColumnRenamed("v", "_y").hint("merge"), "_y").groupBy("feature", "bx", "by").agg(F.sum("n").alias("n"))
    # bins * bins rows a feature from here on
    every, row, column = W.partitionBy("feature"), W.partitionBy("feature", "bx"), W.partitionBy("feature", "by")
    share = F.col("n") / F.sum("n").over(every)
    cells = cells.withColumns({"p": share, "px": F.sum("n").over(row) / F.sum("n").over(every), "py": F.sum("n").over(column) / F.sum("n").over(every)})
    told = cells.groupBy("feature").agg(F.round(F.sum(F.col("p") * F.ln(F.col("p") / F.col("px") / F.col("py"))), 9).alias("mutual_information"))
    # a row a feature
    return top(told.join(links, "feature").withColumn("all", F.lit(0)), ["all"], [F.desc("mutual_information"), F.col("feature")], n).select("feature", "correlation", "mutual_information", "rank")


def forest_importance(df: DataFrame, features: list[str], target: str, *, trees: int = 100, depth: int = 5, n: int = 20, seed: int = 42) -> DataFrame:
    """feature, importance, rank: the n features with the largest share of what a random forest's splits gain. Null features count as 0; rows without a target are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    own = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("_y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(own).select("_x", "_y")
    gains = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows).featureImportances
    ranked = sorted(zip(features, map(float, gains.toArray()), strict=True), key=lambda r: (-r[1], r[0]))[:n]
    return df.sparkSession.createDataFrame([(f, g, i + 1) for i, (f, g) in enumerate(ranked)], "feature string, importance double, rank int")


#: Fixed values of the grid: weights of the first, second and third component; those that sum to 1 are tried.
GRID = ((0.2, 0.3, 0.4, 0.5, 0.6), (0.2, 0.3, 0.4, 0.5, 0.6), (0.1, 0.2, 0.3))


def weight_combinations(grid: tuple[tuple[float, ...], ...] = GRID) -> list[tuple[float, ...]]:
    """Combinations of the grid whose sum is within 0.01 of 1."""
    out: list[tuple[float, ...]] = [()]
    for values in grid:
        out = [(*c, v) for c in out for v in values]
    return [c for c in out if abs(sum(c) - 1) < 0.01]


def weight_grid(candidates: DataFrame, relevance: DataFrame, components: list[str], combinations: list[tuple[float, ...]], k: int = 10) -> DataFrame:
    """combination (its number), weights, ndcg (mean over users with relevant items), users, best: each combination judged on held-out relevance (user_id, item_id, relevance).

    candidates hold user_id, item_id and a column of scores, nulls for 0, for
    each component. best marks the largest mean, ties to the first combination.
    Users with relevant items but no candidates count with 0.
    """
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("relevance"), "item_id"))
    ideal = relevance.filter("relevance > 0").withColumn("i", place).filter(F.col("i") <= k).groupBy("user_id").agg(F.sum(F.col("relevance") / F.log2(F.col("i") + 1.0)).alias("ideal"))
    ideal = kept(ideal, "ideal")
    own = candidates.join(ideal.select("user_id").hint("merge"), "user_id", "left_semi").join(relevance.select("user_id", "item_id", "relevance").hint("merge"), ["user_id", "item_id"], "left")
    scores = [F.struct(F.lit(i).alias("combination"), F.round(sum((w * F.coalesce(F.col(c), F.lit(0.0)) for w, c in zip(ws, components, strict=True)), F.lit(0.0)), 9).alias("score")) for i, ws in enumerate(combinations)]
    each = own.select("user_id", "item_id", "relevance", F.explode(F.array(*scores)).alias("s")).select("user_id", "item_id", "relevance", "s.*")
    lists = top(each, ["combination", "user_id"], [F.desc("score"), F.col("item_id")], k)
    gains = lists.groupBy("combination", "user_id").agg(F.sum(F.coalesce("relevance", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    users = ideal.agg(F.count(F.lit(1)).alias("users"))  # one row
    named = F.element_at(F.array(*[F.array(*map(F.lit, ws)) for ws in combinations]), F.col("combination") + 1)
    means = gains.join(ideal.hint("merge"), "user_id").groupBy("combination").agg(F.sum(F.col("dcg") / F.col("ideal")).alias("total")).crossJoin(F.broadcast(users))
    means = means.select("combination", named.alias("weights"), F.round(F.col("total") / F.col("users"), 9).alias("ndcg"), "users")
    # a row a combination
    return means.withColumn("best", F.row_number().over(W.orderBy(F.desc("ndcg"), "combination")) == 1)


#: Fixed periods in hours: day, week, 30 and 90 days.
PERIODS = (24, 168, 720, 2160)


def seasonal_waves(series: DataFrame, keys: list[str], periods: tuple[int, ...] = PERIODS, least: int = 50) -> DataFrame:
    """keys, period (hours), amplitude, phase, r2 of the waves in series (keys, ts, value) of `least` rows or more.

    Sine and cosine of each period that fits twice between a series' first and
    last row are fitted by the normal equations; waves with an r2 above 0.1 and
    an amplitude above 0.01 count. The phase is the angle whose sine and cosine
    are in the proportion of the fitted sine and cosine.
    """
    own = series.filter("ts is not null and value is not null").withColumn("t", F.unix_micros("ts") / 1e6).withColumn("period", F.explode(F.array(*map(F.lit, periods))))
    angle = 2 * F.pi() * F.col("t") / (F.col("period") * 3600)
    own = own.withColumns({"s": F.sin(angle), "c": F.cos(angle), "y": F.col("value").cast("double")})
    a = own.groupBy(*keys, "period").agg(F.covar_pop("s", "y").alias("sy"), F.covar_pop("c", "y").alias("cy"), F.covar_pop("s", "c").alias("sc"), F.var_pop("s").alias("ss"), F.var_pop("c").alias("cc"), F.var_pop("y").alias("yy"), F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"))
    a = a.filter((F.col("n") >= least) & (F.col("span") >= 2 * 3600 * F.col("period")))
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    sine = ratio(F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc"), det)
    cosine = ratio(F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc"), det)
    a = a.withColumn("b", sine).withColumn("d", cosine)
    waves = a.select(*keys, "period", F.sqrt(F.col("b") * F.col("b") + F.col("d") * F.col("d")).alias("amplitude"), F.atan2("b", "d").alias("phase"), ratio(F.col("b") * F.col("sy") + F.col("d") * F.col("cy"), F.col("yy"), 0.0).alias("r2"))
    return waves.filter((F.col("r2") > 0.1) & (F.col("amplitude") > 0.01))


def seasonal_forecast(series: DataFrame, keys: list[str], as_of: Column, *, horizon: int = 7, least: int = 10) -> DataFrame:
    """keys, step (hours after the last row), ts, value, band of (keys, ts, value): the trend's forecast, or the last value where there is no trend, plus each wave times its r2.

    The band is 1.96 deviations of the last 20 values, of 0.1 for a single
    one. Series with fewer than `least` rows are left out.
    """
    own = series.filter("ts is not null and value is not null").select(*keys, "ts", F.col("value").cast("double").alias("value"))
    own = kept(own.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter(F.col("_n") >= least).drop("_n"), "series")
    last = top(own, keys, [F.desc("ts"), F.desc("value")], 20).groupBy(*keys).agg(F.max("ts").alias("_last"), F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("_value"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("value")).otherwise(0.1).alias("_s"))
    trends = robust_trend(own, keys, as_of, least=least, horizon=horizon).select(*keys, "forecast")
    steps = last.join(trends.hint("merge"), keys, "left").select(*keys, "_last", "_value", "_s", "forecast", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    steps = kept(steps.withColumn("ts", F.timestamp_micros(F.unix_micros("_last") + F.col("step") * 3_600_000_000)), "steps")
    waves = seasonal_waves(own, keys)
    # four waves a series at most
    wave = F.col("amplitude") * F.sin(2 * F.pi() * (F.unix_micros("ts") / 1e6) / (F.col("period") * 3600) + F.col("phase")) * F.col("r2")
    added = steps.join(waves.hint("merge"), keys).groupBy(*keys, "step").agg(F.sum(wave).alias("_wave"))
    out = steps.join(added.hint("merge"), [*keys, "step"], "left")
    base = F.coalesce(F.element_at("forecast", F.col("step")), F.col("_value"))
    return out.select(*keys, "step", "ts", (base + F.coalesce("_wave", F.lit(0.0))).alias("value"), (1.96 * F.col("_s")).alias("band"))
