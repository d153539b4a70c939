"""Filling gaps from the nearest complete rows, exactly, without comparing all pairs.

Distances leave out coordinates that either row lacks and are scaled up for
them. Donors are stored once for each set of coordinates that a receiver may
have, without the coordinates it lacks, and dealt to cells of quantile buckets.
Of donors with equal coordinates only the first k by key can matter, and
receivers with equal coordinates ask once, so hot values stay small.

A receiver first takes a bound: the k-th distance among donors of its own cell,
or, where that holds fewer, of wider cells with a share of their donors. Then
it meets the cells that the bound reaches, and no others. Cells are met in
tasks, a tile of them at a time, and what leaves a task is an answer: a bound,
or the k nearest of a receiver. No row stands for a pair. The receivers of a
tile are dealt to parts where they are many, so a task's rows stay bounded.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import top
from ..functions.tables import kept

# tasks get this module's functions with the job; executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most cut points of a coordinate, rows of both sides that a pack of tiles is meant to hold, pairs of a block.
CUTS, PACK, PAIRS = 1023, 200_000, 1 << 20


def _mask(names: list[str]) -> Column:
    """A bit for each coordinate that is there."""
    return sum((F.when(F.col(n).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(names)), F.lit(0)).cast("int")


def _cells(asked, stored, features: int):
    """For blocks of receivers and donors of one cell: the receivers' places, the donors' places and their distances."""
    import numpy as np

    take = lambda t, c: t.column(c).to_numpy()
    ca, cd = take(asked, "cell"), take(stored, "cell")
    oa, od = np.argsort(ca, kind="stable"), np.argsort(cd, kind="stable")
    ca, cd = ca[oa], cd[od]
    # an absent coordinate is NaN here
    xa = [take(asked, f"x{i}").astype(float) for i in range(features)]
    xd = [take(stored, f"x{i}").astype(float) for i in range(features)]
    shared = take(stored, "shared")
    starts = np.flatnonzero(np.r_[True, cd[1:] != cd[:-1]]) if len(cd) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(cd)]
    for lo, hi in zip(starts, ends, strict=True):
        la, ha = np.searchsorted(ca, cd[lo], "left"), np.searchsorted(ca, cd[lo], "right")
        donors = od[lo:hi]
        s = int(shared[donors[0]])
        step = max(1, PAIRS // len(donors))
        for at in range(la, ha, step):
            own = oa[at:min(at + step, ha)]
            square = np.zeros((len(own), len(donors)))
            for i in range(features):
                if s >> i & 1:
                    off = xa[i][own][:, None] - xd[i][donors][None, :]
                    square += off * off
            yield own, donors, np.sqrt(square * features / s.bit_count())


def _bounds(features: int, k: int):
    """The k-th distance of each receiver in a cell that has as many donors."""

    def run(asked, stored):
        import numpy as np
        import pyarrow as pa

        ids, bounds = [np.zeros(0, np.int64)], [np.zeros(0)]
        own_ids = asked.column("ask").to_numpy()
        for own, donors, distance in _cells(asked, stored, features):
            if len(donors) >= k:
                ids.append(own_ids[own])
                bounds.append(np.partition(distance, k - 1, axis=1)[:, k - 1])
        return pa.table({"ask": np.concatenate(ids), "bound": np.concatenate(bounds)})

    return run


def _nearest(features: int, k: int):
    """The k nearest donors of each receiver within its bound, of all cells of a pack."""

    def run(asked, stored):
        import numpy as np
        import pyarrow as pa

        asks, bound = asked.column("ask").to_numpy(), asked.column("bound").to_numpy()
        keys = stored.column("id").to_numpy()
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))
        a, d, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for own, donors, distance in _cells(asked, stored, features):
            near = ~(distance > bound[own][:, None])
            if len(donors) > k:
                # what is beyond the k-th of the cell can't be among the k nearest; NaN is beyond all
                near &= ~(distance > np.partition(distance, k - 1, axis=1)[:, k - 1 : k])
            r, c = np.nonzero(near)
            a.append(asks[own[r]])
            d.append(donors[c])
            far.append(distance[r, c])
        a, d, far = np.concatenate(a), np.concatenate(d), np.concatenate(far)
        order = np.lexsort((rank[d], far, a))
        a, d, far = a[order], d[order], far[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        first = place < k
        d = d[first]
        return pa.table({"ask": a[first], "id": stored.column("id").take(pa.array(d)), "y": stored.column("y").take(pa.array(d)), "distance": far[first]})

    return run


def impute_knn(df: DataFrame, key: str, target: str, features: list[str], k: int = 5, rows: int = 64) -> DataFrame:
    """key, target (filled), donors: the mean target of the k nearest rows that have one, by distance over the features, ties to the smaller key.

    The square of a distance is the sum over the coordinates that both rows
    have, times the number of features over the number of these. A row that
    shares no coordinate with any donor gets the mean of all donors. donors is
    the number of rows averaged, null where nothing was missing. Without any
    donor gaps stay. NaN counts as missing. rows is how many donors a cell is
    meant to hold.
    """
    spark = df.sparkSession
    n_features = len(features)
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    own = kept(df.select(F.col(key).alias("id"), clean(target).alias("y"), *[clean(c).alias(f"x{i}") for i, c in enumerate(features)]), "rows")
    xs = [f"x{i}" for i in range(n_features)]
    own = own.withColumn("mask", _mask(xs))

    asking = kept(own.filter("y is null and mask > 0").select(*xs, "mask").distinct(), "asking")
    asking = kept(asking.withColumn("ask", F.monotonically_increasing_id()), "asking")
    asking_masks = sorted(r["mask"] for r in asking.select("mask").distinct().collect())  # 2^features at most

    def bit(name: str, i: int) -> Column:
        return F.col(name).bitwiseAND(F.lit(1 << i)) != 0

    # a donor as receivers of a mask see it; of donors that look equal to them, the first k
    seen = own.filter("y is not null and mask > 0").withColumn("asker", F.explode(F.array(*map(F.lit, asking_masks or [0])))).withColumn("shared", F.col("mask").bitwiseAND(F.col("asker"))).filter("shared > 0")
    seen = seen.select("asker", "shared", "id", "y", *[F.when(bit("shared", i), F.col(x)).alias(x) for i, x in enumerate(xs)])
    alike = W.partitionBy("asker", "shared", *xs).orderBy("id")
    stored = kept(seen.withColumn("_r", F.row_number().over(alike)).filter(F.col("_r") <= k).drop("_r"), "donors")
    counts = {(r["asker"], r["shared"]): r["n"] for r in stored.groupBy("asker", "shared").agg(F.count(F.lit(1)).alias("n")).collect()}  # 4^features at most

    # cut points for groups of donors by the number of coordinates that they share
    sizes = {}
    for (_, s), n in counts.items():
        sizes[s.bit_count()] = max(n, sizes.get(s.bit_count(), 0))
    buckets = {c: max(1, min(CUTS + 1, round((n / rows) ** (1 / c)))) for c, n in sizes.items()}
    cuts: dict[int, list[list[float]]] = {}
    for c, b in buckets.items():
        shares = [i / b for i in range(1, b)]
        of = stored.filter(F.bit_count("shared") == c)
        found = of.agg(*[F.percentile_approx(x, F.array(*map(F.lit, shares)), F.lit(10 * b)).alias(x) for x in xs]).first() if shares else [None] * n_features
        cuts[c] = [sorted(set(f or [])) for f in found]
    levels = max(buckets.values(), default=1).bit_length()
    base = max(buckets.values(), default=1) + 1

    def bucket(i: int, at: Column) -> Column:
        """How many cut points of the coordinate lie below a value, 0 where it is not shared."""
        out = F.lit(0)
        for c in cuts:
            if cuts[c][i]:
                out = F.when(F.bit_count("shared") == c, F.size(F.filter(F.array(*map(F.lit, cuts[c][i])).cast("array<double>"), lambda p: p < at))).otherwise(out)
        return F.when(bit("shared", i), out).otherwise(0)

    packs = F.lit(max(1, -(-(sum(counts.values()) + 8 * asking.count()) // PACK)))

    def placed(side: DataFrame, level: Column, *columns: str) -> DataFrame:
        """cell, a number, and its pack, from asker, shared and the buckets p0, p1, ... at a level; tiles of cells share a pack."""
        cell = (F.col("asker").cast("long") * (1 << n_features) + F.col("shared")) * (levels + 1) + level
        for i in range(n_features):
            cell = cell * base + F.col(f"p{i}")
        tile = F.xxhash64("asker", "shared", level, *[F.shiftright(F.col(f"p{i}"), 2) for i in range(n_features)])
        return side.select(cell.alias("cell"), F.pmod(tile, packs).alias("pack"), *columns)

    def meet(asked: DataFrame, donors: DataFrame, function, schema: str) -> DataFrame:
        """Packs of both sides in tasks. Where a pack has many receivers, as wide cells have, they are dealt to parts, and its donors go to each."""
        # a row a pack of more than its share
        full = kept(asked.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PACK).select("pack", F.ceil(F.col("n") / PACK).alias("parts")), "packs")
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        a, d = (side.join(F.broadcast(full), "pack", "left") for side in (asked, donors))
        a = a.withColumn("part", F.pmod(F.xxhash64("ask"), parts)).drop("parts")
        d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        return a.groupBy("pack", "part").cogroup(d.groupBy("pack", "part")).applyInArrow(function, schema)

    at = [bucket(i, F.col(x)).cast("int").alias(f"b{i}") for i, x in enumerate(xs)]
    stored = kept(stored.select("*", *at), "cells")
    # the groups of donors of each mask
    groups = [F.when(F.col("mask") == m, F.array(*[F.lit(s) for a, s in counts if a == m])) for m in {a for a, _ in counts}]
    asked = asking.withColumn("asker", F.col("mask")).withColumn("shared", F.explode(F.coalesce(*groups, F.array().cast("array<int>")))).select("ask", "asker", "shared", *xs)

    # bounds: at each level a cell is twice as wide, and the share of its donors as much smaller
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    wide = lambda side, *columns: side.select(*columns, "asker", "shared", every, *[f"b{i}" for i in range(n_features)]).select("*", *[F.expr(f"shiftright(b{i}, level)").alias(f"p{i}") for i in range(n_features)])
    share = F.lit(1).cast("long")
    for (m, s), n in counts.items():
        fewest = max(1, n // max(rows, 16 * k))
        share = F.when((F.col("asker") == m) & (F.col("shared") == s), F.least(F.lit(fewest).cast("long"), F.pow(F.lit(2.0), F.col("level") * s.bit_count()).cast("long"))).otherwise(share)
    some = wide(stored, "id", *xs).filter(F.pmod(F.xxhash64("id"), share) == 0)
    bounds = meet(placed(wide(asked.select("*", *at), "ask", *xs), F.col("level"), "ask", *xs), placed(some, F.col("level"), "shared", *xs), _bounds(n_features, k), "ask long, bound double")
    bounds = kept(bounds.groupBy("ask").agg(F.min(F.nanvl("bound", F.lit(float("inf")))).alias("bound")), "bounds")

    # the cells that a bound reaches; no bound at all leaves few donors, unless values are not finite
    infinite = F.lit(float("inf"))
    asked = asked.join(bounds.hint("merge"), "ask", "left").withColumn("bound", F.coalesce("bound", infinite))
    reach = F.col("bound") * F.sqrt(F.bit_count("shared") / F.lit(float(n_features))) * (1 + 1e-9)
    few = asked.filter(F.col("bound") == infinite)
    for i, x in enumerate(xs):
        slack = reach + F.abs(F.col(x)) * 1e-12
        asked = asked.withColumn(f"p{i}", F.explode(F.sequence(bucket(i, F.col(x) - slack), bucket(i, F.col(x) + slack))))
    zero = [F.lit(0).alias(f"p{i}") for i in range(n_features)]
    asked = placed(asked.filter(F.col("bound") < infinite), F.lit(0), "ask", "bound", *xs)
    donors = stored.select("*", *[F.col(f"b{i}").alias(f"p{i}") for i in range(n_features)])
    near_schema = f"ask long, id {own.schema['id'].dataType.simpleString()}, y double, distance double"
    best = meet(asked, placed(donors, F.lit(0), "shared", "id", "y", *xs), _nearest(n_features, k), near_schema)
    # one cell a group, its receivers dealt to parts
    n_few = few.count()
    if n_few:
        parts = F.lit(-(-n_few // PACK))
        whole = placed(few.select("*", *zero), F.lit(0), "ask", "bound", *xs).withColumn("pack", F.pmod(F.xxhash64("ask"), parts))
        askers = few.select("asker").distinct()  # 2^features at most
        met = stored.join(F.broadcast(askers), "asker", "left_semi").select("*", *zero)
        met = placed(met, F.lit(0), "shared", "id", "y", *xs).withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
        best = best.unionByName(meet(whole, met, _nearest(n_features, k), near_schema))
    best = kept(best, "best")
    found = top(best, ["ask"], [F.col("distance"), F.col("id")], k).groupBy("ask").agg(F.avg("y").alias("filled"), F.count(F.lit(1)).alias("donors"))
    found = kept(asking.join(found.hint("merge"), "ask").select(*xs, "filled", "donors"), "found")

    mean = own.agg(F.avg("y").alias("_mean"), F.count("y").alias("_all"))  # one row
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"f.{x}")) for x in xs]
    gaps = own.filter("y is null").alias("a").join(found.alias("f").hint("merge"), same, "left").select("a.id", "f.filled", "f.donors").crossJoin(F.broadcast(mean))
    gaps = gaps.select(F.col("id").alias(key), F.coalesce("filled", "_mean").alias(target), F.when(F.col("filled").isNotNull(), F.col("donors")).otherwise(F.col("_all")).alias("donors"))
    return own.filter("y is not null").select(F.col("id").alias(key), F.col("y").alias(target), F.lit(None).cast("long").alias("donors")).unionByName(gaps)
