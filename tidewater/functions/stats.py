"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import kept


def as_of(df: DataFrame, when: str | None, ts: str = "ts") -> DataFrame:
    """df with a column as_of: the given time, or the latest of df. No wall clock is read."""
    if when is not None:
        return df.withColumn("as_of", F.lit(when).cast("timestamp"))
    latest = df.agg(F.max(ts).alias("as_of"))
    return df.crossJoin(F.broadcast(latest))  # one row


def binned(counts: DataFrame, value: str, bins: int) -> DataFrame:
    """counts (a row a value) with _bin, a number that grows with the value.

    Cuts lie, for numbers, at approximate percentiles, for texts at those of a
    sample of 16 values a bin, the first by hash.
    """
    if dict(counts.dtypes)[value] == "string":
        # one row: cuts of 256 characters at most
        drawn = counts.select(F.substring(value, 1, 256).alias("_s"), F.xxhash64(value).alias("_h")).orderBy("_h", "_s").limit(16 * bins).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
        cuts = drawn.select(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / bins).cast("int")))).alias("_cuts"))
        cuts = cuts.select(F.array_compact("_cuts").alias("_cuts"))
    else:
        cuts = counts.agg(F.percentile_approx(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(10 * bins)).alias("_cuts"))
    return counts.crossJoin(F.broadcast(cuts)).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def places(df: DataFrame, value: str, *aggs: Column, bins: int = 256) -> DataFrame:
    """Each distinct non-null value with ties (its rows), below (rows of smaller values), total (all rows), number (its place among the distinct values, from 0) and further aggregates of its rows.

    No task orders all values: they are dealt to bins of neighbouring values,
    ordered inside a bin, and moved by what the bins before hold.
    """
    return placed(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("ties"), *aggs), value, bins)


def placed(counts: DataFrame, value: str, bins: int) -> DataFrame:
    """What places gives, from a row with ties for each value."""
    dealt = binned(counts, value, bins)
    before = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = dealt.groupBy("_bin").agg(F.sum("ties").alias("_n"), F.count(F.lit(1)).alias("_d"))
    # a row a bin
    sums = sums.select("_bin", F.coalesce(F.sum("_n").over(before), zero).alias("_before"), F.coalesce(F.sum("_d").over(before), zero).alias("_numbers"), F.sum("_n").over(W.partitionBy()).alias("total"))
    w = W.partitionBy("_bin").orderBy(value)
    out = dealt.join(F.broadcast(sums), "_bin")
    below = F.col("_before") + F.sum("ties").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("ties")
    return out.withColumn("below", below).withColumn("number", F.col("_numbers") + F.row_number().over(w) - 1).drop("_bin", "_before", "_numbers")


def percentiles(df: DataFrame, value: str, shares: list[float], name: str = "_q") -> DataFrame:
    """One row: the exact percentiles of a column's non-null values as an array, between two neighbouring values in proportion; nulls if there are none.

    Their places are looked up among the ordered distinct values, so no buffer
    holds a column's values. Counts and result are written: what df stands for
    is computed once, and plans of several steps do not multiply.
    """
    p = placed(kept(df.select(F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("ties")), "counts"), "_v", 256)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("ties")), F.col("_v")))

    spots = [s * (F.col("total") - 1) for s in shares]
    found = p.agg(*[x for i, s in enumerate(spots) for x in (at(F.floor(s)).alias(f"a{i}"), at(F.ceil(s)).alias(f"b{i}"))], F.max("total").alias("total"))
    between = [F.when(F.floor(s) == F.ceil(s), F.col(f"a{i}")).otherwise((F.ceil(s) - s) * F.col(f"a{i}") + (s - F.floor(s)) * F.col(f"b{i}")) for i, s in enumerate(spots)]
    return kept(found.select(F.array(*between).alias(name)), "percentiles")


def with_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank of a value divided by the number of rows, ties sharing their mean rank; null for null."""
    p = places(df, value).select(F.col(value).alias("_at"), ((F.col("below") + (F.col("ties") + 1) / 2) / F.col("total")).alias(name))
    return df.join(p, F.col(value) == F.col("_at"), "left").drop("_at")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key in the given order, with their rank."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def clip(x: Column, low: float, high: float) -> Column:
    """x between the two; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b, and the given value where b is 0 or null."""
    return F.when((b != 0) & b.isNotNull(), a / b).otherwise(F.lit(otherwise).cast("double"))


def entropy(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Natural-log entropy of a value's shares for each key."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(W.partitionBy(*keys))
    return n.withColumn("_p", share).groupBy(*keys).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias(name))


def previous(value: str, window: WindowSpec) -> Column:
    return F.lag(value).over(window)


def r6(x: Column | str) -> Column:
    """Rounded to six digits, for results that two engines must agree on."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def normal_two_sided(z: Column) -> Column:
    """Share of the standard normal at least as far from 0 as z, by a rational approximation of the error function (absolute error 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values of the approximation, highest power first
    total = F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        total = (total + a) * t
    return total * F.exp(-x * x)


def student_as_normal(t: Column, dof: Column) -> Column:
    """The normal deviate that lies about as far out as Student's t (Wallace's approximation, within 0.01 from 3 degrees of freedom on)."""
    return F.signum(t) * (8 * dof + 1) / (8 * dof + 3) * F.sqrt(dof * F.ln(1 + t * t / dof))


def student_point(dof: Column, z: float = 1.959963984540054) -> Column:
    """Student's t whose normal deviate is z, 97.5 % by default: the inverse of student_as_normal."""
    u = z * (8 * dof + 3) / (8 * dof + 1)
    return F.sqrt(dof * (F.exp(u * u / dof) - 1))


def normal_point(p: Column) -> Column:
    """The standard normal's point below which a share p lies, by a rational approximation (relative error 1.2e-9); p strictly between 0 and 1."""
    # fixed values of the approximation, highest power first: middle part, then tails
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def poly(values: tuple[float, ...], x: Column) -> Column:
        total = F.lit(0.0)
        for v in values:
            total = total * x + v
        return total

    q = p - 0.5
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = poly(c, tail) / poly(d, tail)
    return F.when(F.abs(q) <= 0.47575, poly(a, q * q) * q / poly(b, q * q)).when(q < 0, outer).otherwise(-outer)
