"""Factor models learned in steps: mini-batches of a stream, and pairwise ranking.

A step brings rows and the factors that they need together, sums the gradients
of each user and each item, and adds the sums; the order of rows inside a step
does not matter. Profiles are dealt to blocks of bounded size, and rows meet
blocks in tasks of bounded size (`met`): factors are copied once a task and not
once a row, and what leaves a task is a sum for each profile.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StructType, TimestampType

from ..functions.stats import clip, normal_point
from ..functions.tables import kept

# tasks get this module's functions with the job; executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Profiles of a block, and rows that meet blocks in a task, on average.
BLOCK, ROWS = 16_384, 500_000


@dataclass(frozen=True)
class Rates:
    """How mini-batches are learned: learning rate, its decay by the hour since the user's last event (not under `least` of it), penalty, number of factors, events until a profile is trusted, and the prediction for strangers."""

    rate: float = 0.01
    forgetting: float = 0.95
    least: float = 0.1
    penalty: float = 0.01
    rank: int = 50
    trusted: int = 5
    base: float = 3.0


def start_factor(key: Column, k: int, salt: str) -> Column:
    """A normal deviate of spread 0.1 for a key's k-th factor, by hash."""
    share = (F.pmod(F.xxhash64(F.lit(salt), key, F.lit(k)), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    return 0.1 * normal_point(share)


def start_factors(key: Column, rank: int, salt: str) -> Column:
    """The first `rank` of start_factor, as one expression and not one a factor."""
    share = lambda k: (F.pmod(F.xxhash64(F.lit(salt), key, k), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), share), lambda x: 0.1 * normal_point(x))


def _profile(key: str, kind: DataType) -> StructType:
    return StructType().add(key, kind).add("bias", DoubleType()).add("factors", ArrayType(DoubleType())).add("n", LongType()).add("updated", TimestampType())


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def met(rows: DataFrame, sides: list[tuple[list[str], DataFrame]], run, schema: str, block: int | None = None, most: int | None = None) -> DataFrame:
    """What run(rows, profiles) gives for each place: the rows whose keys are in one block each, cut to slices of about `most`, and those blocks.

    A side is the columns of rows that hold its keys, and its profiles, whose
    key has the first column's name; run gets the profiles of all sides as one
    table, with that name as _side.
    """
    block, most = block or BLOCK, most or ROWS
    at, number, k = [], [], 0
    for columns, profiles in sides:
        blocks = max(1, -(-profiles.count() // block))
        number.append(blocks)
        for c in columns:
            at.append((f"_b{k}", c, blocks))
            k += 1
    place = [b for b, _, _ in at]
    dealt = rows.withColumns({b: F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for b, c, n in at})
    # a row a place: broadcast, as there are few blocks
    places = kept(dealt.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_slices")), "places")
    dealt = dealt.join(F.broadcast(places), place).withColumn("_slice", F.pmod(F.xxhash64(F.lit(7), *[c for _, c, _ in at]), F.col("_slices")).cast("int")).drop("_slices")
    place = [*place, "_slice"]
    slices = places.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).select(*place)
    blocks = None
    for (columns, profiles), n in zip(sides, number, strict=True):
        # a block goes once to each place that has it, also where several columns ask for it
        asked = None
        for b, c, _ in at:
            if c in columns:
                one = slices.select(F.col(b).alias("_block"), *place)
                asked = one if asked is None else asked.unionByName(one)
        own = profiles.withColumn("_side", F.lit(columns[0])).withColumn("_block", F.pmod(F.xxhash64(columns[0]), F.lit(n)).cast("int")).join(F.broadcast(asked.distinct()), "_block").drop("_block")
        blocks = own if blocks is None else blocks.unionByName(own, allowMissingColumns=True)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(slices.count(), 2_000))
    return dealt.repartition(n, *place).groupBy(*place).cogroup(blocks.repartition(n, *place).groupBy(*place)).applyInArrow(run, schema)


def _of_side(profiles, key: str):
    """Keys of a side, and its profiles, of an Arrow table; the factors as an array with a row a factor."""
    import numpy as np
    import pyarrow.compute as pc

    own = profiles.filter(pc.equal(profiles.column("_side"), key))
    flat = own.column("factors").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return own.column(key).combine_chunks(), own, np.ascontiguousarray(flat.reshape(len(own), len(flat) // max(1, len(own))).T)


def _found(keys, column):
    """Where the keys of a column stand; -1: nowhere."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(column.combine_chunks(), value_set=keys), -1).to_numpy(zero_copy_only=False)


def _sums(kinds: dict, key: str, keys, n, moves, **more):
    """An Arrow table of the sums of the keys that have rows; the other key is null."""
    import numpy as np
    import pyarrow as pa

    some = np.flatnonzero(n)
    rank = len(moves)
    out = {k: keys.take(pa.array(some)) if k == key else pa.nulls(len(some), t) for k, t in kinds.items()}
    out |= {"n": pa.array(n[some], pa.int64())} | {k: x.take(pa.array(some)) if isinstance(x, pa.Array) else pa.array(x[some]) for k, x in more.items()}
    moved = np.stack([m[some] for m in moves], 1) if rank else np.zeros((len(some), 0))
    out["moves"] = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * rank, pa.int32()), pa.array(moved.ravel(), pa.float64()))
    return pa.table(out)


def _kinds(users: DataFrame, items: DataFrame) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k, df in (("user_id", users), ("item_id", items)))


def _added(parts: DataFrame, key: str, rank: int, *more: Column) -> DataFrame:
    """The sums of each key over all tasks."""
    # a row of parts for each task that had the key: the arrays are gathered, as an aggregate a factor makes code too long to compile
    sums = parts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("more"), *more, F.collect_list("moves").alias("moves"))
    return sums.withColumn("moves", F.aggregate("moves", F.array_repeat(F.lit(0.0), rank), lambda s, x: F.zip_with(s, x, lambda a, b: a + b)))


def _minibatch_sums(rates: Rates):
    import numpy as np
    import pyarrow as pa

    def run(rows: pa.Table, profiles: pa.Table) -> pa.Table:
        kinds = {k: rows.schema.field(k).type for k in ("user_id", "item_id")}
        (uk, u, p), (ik, i, q) = (_of_side(profiles, k) for k in kinds)
        a, b = _found(uk, rows.column("user_id")), _found(ik, rows.column("item_id"))
        bu, bi = (np.asarray(t.column("bias"), float) for t in (u, i))
        dots = np.zeros(len(a))
        for k in range(rates.rank):
            dots += p[k][a] * q[k][b]
        error = np.asarray(rows.column("rating"), float) - np.clip(rates.base + bu[a] + bi[b] + dots, 0.0, 5.0)
        ts, updated = rows.column("at"), u.column("at")
        none = np.asarray(ts.is_null()) | np.asarray(updated.is_null())[a]
        ts, updated = (np.asarray(c.fill_null(0)) for c in (ts, updated))
        hours = np.where(none, 0.0, (ts - updated[a]) / 3.6e9)
        rate = rates.rate * np.where(hours > 0, np.maximum(rates.least, np.power(rates.forgetting, np.maximum(hours, 0.0))), 1.0)
        pull = rate * error
        dated, out = ~np.asarray(rows.column("at").is_null()), []
        for key, keys, at, other, o in (("user_id", uk, a, q, b), ("item_id", ik, b, p, a)):
            total = lambda w: np.bincount(at, w, len(keys))  # noqa: B023, E731
            last = np.full(len(keys), np.iinfo(np.int64).min)
            np.maximum.at(last, at[dated], ts[dated])
            out.append(_sums(kinds, key, keys, np.bincount(at, minlength=len(keys)), [total(pull * other[k][o]) for k in range(rates.rank)], rates=total(rate), pulls=total(pull), last=pa.array(last, pa.int64(), mask=last == np.iinfo(np.int64).min)))
        return pa.concat_tables(out)

    return run


def minibatch_step(users: DataFrame, items: DataFrame, batch: DataFrame, rates: Rates = Rates()) -> tuple[DataFrame, DataFrame]:
    """The profiles (id, bias, factors, n, updated) of the users and items of a batch (user_id, item_id, rating, ts) after it.

    All rows are judged by the profiles before the batch: the error of the
    prediction, between 0 and 5, times the rate, which decays with the hours
    since the user's last event (new users and late events: not at all). Rows
    with a null in user, item or rating are left out; a null time does not decay.
    """
    rows = batch.filter("user_id is not null and item_id is not null and rating is not null").select("user_id", "item_id", F.col("rating").cast("double").alias("rating"), "ts")

    def known(profiles: DataFrame, key: str) -> DataFrame:
        ids = rows.select(key).distinct()
        fresh = start_factors(F.col(key), rates.rank, key)
        own = ids.join(profiles.hint("merge"), key, "left")
        # written: both the rows' join and the update read it
        return kept(own.select(key, F.coalesce("bias", F.lit(0.0)).alias("bias"), F.coalesce("factors", fresh).alias("factors"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "updated"), key)

    u, i = known(users, "user_id"), known(items, "item_id")
    micros = lambda df, c: df.withColumn("at", F.unix_micros(c)).drop(c)
    sides = [(["user_id"], micros(u.drop("n"), "updated")), (["item_id"], micros(i.drop("n"), "updated"))]
    parts = met(micros(rows, "ts"), sides, _minibatch_sums(rates), f"{_kinds(u, i)}, n long, rates double, pulls double, last long, moves array<double>")
    parts = kept(parts, "sums")

    def after(profiles: DataFrame, key: str) -> DataFrame:
        sums = _added(parts, key, rates.rank, F.sum("rates").alias("rates"), F.sum("pulls").alias("pulls"), F.timestamp_micros(F.max("last")).alias("last"))
        own = profiles.join(sums.hint("merge"), key)
        shrink = rates.penalty * F.col("rates")
        moved = F.zip_with("factors", "moves", lambda x, m: x + m - shrink * x)
        return own.select(key, (F.col("bias") + F.col("pulls") - shrink * F.col("bias")).alias("bias"), moved.alias("factors"), (F.col("n") + F.col("more")).alias("n"), F.greatest("updated", "last").alias("updated"))

    return after(u, "user_id"), after(i, "item_id")


class Profiles:
    """A table of profiles in versions: each holds the rows that its step changed, every `whole`-th all rows. Writing a version again gives the same."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: DataType, whole: int = 20) -> None:
        self.spark, self.path, self.key, self.whole = spark, path, key, whole
        self.schema = _profile(key, kind)

    def at(self, version: int) -> DataFrame:
        """The newest row of each key up to a version; no rows at version 0."""
        first = max(1, version - version % self.whole)
        if version < 1:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/version={v}").withColumn("_v", F.lit(v)) for v in range(first, version + 1)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names[1:]), "_v").alias("x"))
        return newest.select(self.key, "x.*")

    def put(self, version: int, changed: DataFrame) -> None:
        if version % self.whole == 0:
            before = self.at(version - 1).join(changed.select(self.key).hint("merge"), self.key, "left_anti")
            changed = before.unionByName(changed)
        changed.write.mode("overwrite").parquet(f"{self.path}/version={version}")


def learn_stream(stream: DataFrame, path: str, checkpoint: str, rates: Rates = Rates(), whole: int = 20):
    """Learns from a stream (user_id, item_id, rating, ts) batch by batch until no more is there; gives the two tables of profiles and the last version.

    A batch reads version n and writes version n + 1, so a batch that is run
    again after a failure changes nothing.
    """
    spark, kinds = stream.sparkSession, {f.name: f.dataType for f in stream.schema}
    users, items = (Profiles(spark, f"{path}/{k}", f"{k}_id", kinds[f"{k}_id"], whole) for k in ("user", "item"))
    last = [0]

    def step(batch: DataFrame, number: int) -> None:
        u, i = minibatch_step(users.at(number), items.at(number), batch, rates)
        users.put(number + 1, u)
        items.put(number + 1, i)
        last[0] = number + 1

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return users, items, last[0]


def negatives(seen: DataFrame, epoch: int, seed: int = 42, rows: int = 1000) -> DataFrame:
    """user_id, item_id, other: for each of the distinct pairs an item that the user has not, drawn as often as items are seen.

    Pairs are dealt into groups of about `rows` by hash, in the hash's order,
    and each takes the item of the pair behind it; pairs whose draw their user
    has, too, sit this epoch out.
    """
    n = seen.count()
    draw = F.xxhash64(F.lit(seed), F.lit(epoch), "user_id", "item_id")
    group = F.pmod(F.xxhash64("draw"), F.lit(max(1, n // rows)))
    w = W.partitionBy("group").orderBy("draw", "user_id", "item_id")
    pairs = seen.withColumn("draw", draw).withColumn("group", group).withColumn("other", F.lead("item_id").over(w)).filter("other is not null")
    taken = seen.select("user_id", F.col("item_id").alias("other"))
    return pairs.select("user_id", "item_id", "other").join(taken.hint("merge"), ["user_id", "other"], "left_anti").select("user_id", "item_id", "other")


def _scored(rows, profiles):
    """Where the rows' user, item and other stand in their profiles (rows without any are left out), their keys and factors, and the rows' score differences."""
    import numpy as np

    (uk, _, p), (ik, i, q) = (_of_side(profiles, k) for k in ("user_id", "item_id"))
    u, a, b = _found(uk, rows.column("user_id")), _found(ik, rows.column("item_id")), _found(ik, rows.column("other"))
    there = (u >= 0) & (a >= 0) & (b >= 0)
    u, a, b = u[there], a[there], b[there]
    bias = np.asarray(i.column("bias"), float)
    one, two = np.zeros(len(u)), np.zeros(len(u))
    if len(u):
        for x, y in zip(p, q, strict=True):
            own = x[u]
            one += own * y[a]
            two += own * y[b]
    return (u, a, b), (uk, p), (ik, q), bias[a] - bias[b] + one - two


def _bpr_sums(rank: int):
    import numpy as np
    import pyarrow as pa

    def run(rows: pa.Table, profiles: pa.Table) -> pa.Table:
        kinds = {k: rows.schema.field(k).type for k in ("user_id", "item_id")}
        (u, a, b), (uk, p), (ik, q), x = _scored(rows, profiles)
        with np.errstate(over="ignore"):
            g = 1 / (1 + np.exp(x))
        total = lambda at, w, keys: np.bincount(at, w, len(keys))
        if not len(u):
            p, q = np.zeros((rank, len(uk))), np.zeros((rank, len(ik)))
        users = [total(u, g * (q[k][a] - q[k][b]), uk) for k in range(rank)]
        items = []
        for k in range(rank):
            own = g * p[k][u]
            items.append(total(a, own, ik) - total(b, own, ik))
        n = np.bincount(u, minlength=len(uk)), np.bincount(a, minlength=len(ik)) + np.bincount(b, minlength=len(ik))
        return pa.concat_tables([_sums(kinds, "user_id", uk, n[0], users, push=np.zeros(len(uk))), _sums(kinds, "item_id", ik, n[1], items, push=total(a, g, ik) - total(b, g, ik))])

    return run


def bpr_step(users: DataFrame, items: DataFrame, triples: DataFrame, rank: int, rate: float, penalty: float) -> tuple[DataFrame, DataFrame]:
    """One epoch of pairwise ranking over (user_id, item_id, other): users (user_id, factors) and items (item_id, bias, factors) after it.

    The loss of a triple is -ln of the logistic of the score difference; a
    user's or item's summed gradient is divided by the root of its triples, so
    that popular ones do not run away.
    """
    sides = [(["user_id"], users), (["item_id", "other"], items)]
    parts = kept(met(triples, sides, _bpr_sums(rank), f"{_kinds(users, items)}, n long, push double, moves array<double>"), "sums")

    def moved(df: DataFrame, key: str) -> DataFrame:
        n = F.sqrt(F.col("n").cast("double"))
        out = df.withColumn("factors", F.when(F.col("n").isNull(), F.col("factors")).otherwise(F.zip_with("factors", "moves", lambda q, m: q + rate * (m / n - penalty * q))))
        if "bias" in df.columns:
            out = out.withColumn("bias", F.when(F.col("n").isNull(), F.col("bias")).otherwise(F.col("bias") + rate * (F.col("push") / n - penalty * F.col("bias"))))
            return out.select(key, "bias", "factors")
        return out.select(key, "factors")

    of_users = _added(parts, "user_id", rank).withColumnRenamed("more", "n")
    of_items = _added(parts, "item_id", rank, F.sum("push").alias("push")).withColumnRenamed("more", "n")
    return moved(users.join(of_users.hint("merge"), "user_id", "left"), "user_id"), moved(items.join(of_items.hint("merge"), "item_id", "left"), "item_id")


def bpr_train(interactions: DataFrame, *, rank: int = 50, epochs: int = 10, rate: float = 0.1, penalty: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Users (user_id, factors) and items (item_id, bias, factors) of a pairwise ranking model, after a fixed number of epochs with new draws each."""
    seen = kept(interactions.select("user_id", "item_id").dropna().distinct(), "seen")
    fresh = lambda key: start_factors(F.col(key), rank, f"bpr {key} {seed}").alias("factors")
    users = kept(seen.select("user_id").distinct().select("user_id", fresh("user_id")), "users")
    items = kept(seen.select("item_id").distinct().select("item_id", F.lit(0.0).alias("bias"), fresh("item_id")), "items")
    for epoch in range(epochs):
        users, items = bpr_step(users, items, kept(negatives(seen, epoch, seed), "draws"), rank, rate, penalty)
        users, items = kept(users, "users"), kept(items, "items")
    return users, items


def pair_auc(triples: DataFrame, score: Column) -> DataFrame:
    """auc, n: the share of triples whose score (first less second) is above 0, ties by half."""
    return triples.agg(F.avg(F.when(score > 0, 1.0).when(score == 0, 0.5).otherwise(0.0)).alias("auc"), F.count(F.lit(1)).alias("n"))


def bpr_auc(users: DataFrame, items: DataFrame, triples: DataFrame) -> DataFrame:
    """auc, n of a model over triples (user_id, item_id, other)."""
    import pyarrow as pa

    def run(rows: pa.Table, profiles: pa.Table) -> pa.Table:
        return pa.table({"score": _scored(rows, profiles)[-1]})

    return pair_auc(met(triples, [(["user_id"], users), (["item_id", "other"], items)], run, "score double"), F.col("score"))
