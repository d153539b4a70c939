"""One-column isolation forest.

Trees split small samples at points drawn evenly between a node's least and
largest value. Over one column a forest's mean path length is a step function
with as many steps as there are splits, so a row's score is its step's score.
The samples and the steps have a fixed size; all rows are scored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n values, which ends a path with n values left."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def tree_steps(values: list[float], draw: random.Random, depth: int) -> list[tuple[float, float]]:
    """(upper end, path length) of a tree's leaves, from the left; the last end is infinite."""
    out: list[tuple[float, float]] = []

    def split(part: list[float], left: int, upper: float) -> None:
        low, high = min(part), max(part)
        if not left or low == high:
            out.append((upper, depth - left + mean_path(len(part))))
            return
        cut = draw.uniform(low, high)
        below = [v for v in part if v < cut]
        if not below or len(below) == len(part):
            out.append((upper, depth - left + mean_path(len(part))))
            return
        split(below, left - 1, cut)
        split([v for v in part if v >= cut], left - 1, upper)

    split(values, depth, math.inf)
    return out


def forest_steps(values: list[float], trees: int = 100, sample: int = 256, seed: int = 42) -> list[tuple[float, float]]:
    """(lower end, score) of the forest's steps, from the left: 2 to the power of minus the mean path length over that of a sample. A value at a lower end belongs to the step."""
    draw = random.Random(seed)
    size = min(sample, len(values))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    moves: dict[float, float] = {}
    level = 0.0
    for _ in range(trees):
        steps = tree_steps(draw.sample(values, size), draw, depth)
        level += steps[0][1]
        for (end, path), (_, following) in zip(steps, steps[1:]):
            moves[end] = moves.get(end, 0.0) + following - path
    scale = mean_path(size) or 1.0
    out, at = [(-math.inf, 2 ** (-level / trees / scale))], level
    for end in sorted(moves):
        at += moves[end]
        out.append((end, 2 ** (-at / trees / scale)))
    return out


def isolation_forest(df: DataFrame, key: str, value: str, *, contamination: float = 0.1, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """key, score (0 to 1, higher: easier to isolate), is_outlier: scores above the (1 - contamination) quantile of all scores.

    The trees see at most trees * sample values, the first by a hash of the
    key. Null and NaN values have no score and are no outliers; if all values
    are equal, none is one.
    """
    from pyspark.ml.feature import Bucketizer

    own = df.select(F.col(key), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("_x"))
    known = own.filter("_x is not null")
    drawn = [r["_x"] for r in known.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), "_x").limit(trees * sample).select("_x").collect()]
    if not drawn:
        return own.select(key, F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_outlier"))
    steps = forest_steps(drawn, trees, sample, seed)
    ends = [s for s, _ in steps] + [math.inf]
    if len(steps) > 1:
        placed = Bucketizer(splits=ends, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(known).withColumn("_b", F.col("_b").cast("int"))
    else:
        placed = known.withColumn("_b", F.lit(0))
    # as many rows as there are steps: trees * sample at most
    table = df.sparkSession.createDataFrame([(i, s) for i, (_, s) in enumerate(steps)], "_b int, score double")
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table), "_b")
    w = W.orderBy("score").rowsBetween(W.unboundedPreceding, 0)
    summed = counts.groupBy("score").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy()))
    # the quantile lies between two neighbouring places, as if all scores stood in a row
    place = (1 - contamination) * (F.col("all") - 1)
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("score")))
    limit = summed.agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part")).select((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("limit"))
    scored = placed.join(F.broadcast(table), "_b").crossJoin(F.broadcast(limit))
    out = scored.select(key, "score", (F.col("score") > F.col("limit")).alias("is_outlier"))
    return out.unionByName(own.filter("_x is null").select(key, F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_outlier")))
