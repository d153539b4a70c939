"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Its documents share the target in
proportion to their weight (1 where none is given): a document expects
`target * weight / sum(weight * size)` copies, the limit at most. The whole
part of that is given for certain; the fraction is its inclusion probability
p. Documents are then ranked by the random odds u / (1 - u) divided by the
inclusion odds p / (1 - p), u being a hash of the document's key, and the
source takes them from the front until the words of its target are reached.
The size is fixed in words, so a gap smaller than the next document is left;
one document a source, the one whose size fits the gap best, fills it. That is
the only copy that is not drawn by rank.

The cut of each source is found in two steps without ordering a source in one
task: words are summed over bins of the rank, then ranks are ordered inside
the bin that holds the cut. Sources are numbered by ranges, so that no task
orders all of them either.

Null texts have size 0, are ranked as others and take 0 words; a null source
is a source of its own, the last; repeated rows are ranked side by side and
counted one by one; ties of rank go by id (null first), hash of the text and row
number, ties for the last gap by rank and then the same; very long texts are only counted; an empty table gives an
empty result. Columns that are carried along under the name of a result column
give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import written

#: Words for the size of a text.
SIZE = r"[^\x20\x09-\x0D]+"
#: Equal steps of the rank's logarithm between -SPREAD and SPREAD into which words are summed; ranks beyond fall into the outer steps.
BINS, SPREAD = 16_384, 24.0


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds `number`, the place of each row in the order of its key, null last.

    Rows are ranged by key; only a count for each range is summed in one task.
    """
    order = F.col(key).asc_nulls_last()
    ranged = written(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count"))
    inside = ranged.withColumn("number", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1)
    return inside.join(F.broadcast(before.select("part", "before")), "part").withColumn("number", F.col("number") + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """source, source_size, target: the words of all sources shared by weight, none above limit times its own.

    Sources are numbered by code point, null last, and weigh `weights` in turn.
    All get a common level times their weight; sources that this would bring
    over their limit stay at it, and the level rises for the others, until none
    is over.
    """
    given = F.array(*[F.lit(float(w)) for w in weights])
    own = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    own = own.withColumn("weight", F.element_at(given, (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))).withColumn("most", limit * F.col("source_size"))
    own = written(own.drop("number"), "sources")
    level, full = 0.0, None
    while True:
        over = F.lit(level) * F.col("weight") > F.col("most")
        r = own.agg(F.sum("source_size").cast("double"), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if r[3] == full or r[2] is None:
            break
        level, full = ((r[0] or 0.0) - (r[1] or 0.0)) / r[2], r[3]
    return own.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _by_source(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of one row a source; the written table goes to every task only if it is as small as Spark's threshold says."""
    return rows.join(one.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[float, ...] = (1, 2, 3), limit: int = 3, seed: int = 17, carry: bool = False) -> DataFrame:
    """One row a document: id, print (hash of its text), source, size, source_size, target, copies, taken (size times copies).

    With carry, docs's own columns and then size, source_size, target, copies and taken.
    """
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("print"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(SIZE)), F.lit(0)).cast("long").alias("size"),
        weight.alias("weight"),
        *whole,
    )
    # written, so that a row keeps its number
    base = written(base, "sizes")
    slim = base.drop("doc")
    spread = slim.groupBy("source").agg(F.sum(F.col("weight") * F.col("size")).alias("all"))
    goal = written(_by_source(targets(slim, weights, limit), spread), "targets")

    def drawn(rows: DataFrame) -> DataFrame:
        """Adds the certain copies, the rank of a further one and its bin."""
        rows = _by_source(rows, goal)
        expected = F.least(F.lit(float(limit)), F.when(F.col("all") > 0, F.round(F.col("target") * F.col("weight") / F.col("all"), 9)).otherwise(0.0))
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "print"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        rows = rows.withColumn("sure", F.floor(expected)).withColumn("p", expected - F.col("sure"))
        rank = F.when(F.col("p") > 0, F.ln(u / (1 - u)) - F.ln(F.col("p") / (1 - F.col("p"))))
        step = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((rank + SPREAD) * (BINS / (2 * SPREAD)))))
        return rows.withColumn("rank", rank).withColumn("bin", step.cast("int"))

    # the words that each source still needs after its certain copies, and the bin in which its ranks reach them
    bins = drawn(slim).groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("sure")).alias("certain"), F.sum("size").alias("words"), F.first("target").alias("target"))
    bins = bins.withColumn("need", F.col("target") - F.sum("certain").over(W.partitionBy("source")))
    upto = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.filter("bin is not null").withColumn("before", upto)
    reach = (F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") > F.col("need"))
    cuts = written(bins.groupBy("source").agg(F.first("need").alias("need"), F.min(F.when(reach, F.struct("bin", "before"))).alias("cut")), "cuts")

    # ranks are ordered in the cut bin only
    inside = _by_source(drawn(slim), cuts).filter(F.col("bin") == F.col("cut.bin"))
    running = F.sum("size").over(W.partitionBy("source").orderBy(_key()).rowsBetween(W.unboundedPreceding, W.currentRow))
    last_in = inside.withColumn("upto", F.col("cut.before") + running).filter(F.col("upto") <= F.col("need")).groupBy("source").agg(F.max(_key()).alias("last"))
    cuts = written(_by_source(cuts, last_in), "cuts")

    def copied(rows: DataFrame) -> DataFrame:
        """Adds copies: all bins before the cut are taken, and up to the cut inside its bin; a source without a cut takes all that have a chance."""
        rows = _by_source(drawn(rows), cuts)
        extra = (F.col("need") > 0) & F.col("bin").isNotNull() & (F.col("cut.bin").isNull() | (F.col("bin") < F.col("cut.bin")) | ((F.col("bin") == F.col("cut.bin")) & F.col("last").isNotNull() & (_key() <= F.col("last"))))
        return rows.withColumn("copies", (F.col("sure") + F.coalesce(extra, F.lit(False)).cast("int")).cast("long"))

    # the last gap of each source goes to the document whose one more copy comes nearest to it
    taken = written(copied(slim).select("row", "id", "print", "source", "size", "target", "copies", "rank"), "taken")
    gap = taken.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    spare = _by_source(taken.filter((F.col("copies") < limit) & (F.col("size") > 0)), written(gap, "gaps"))
    spare = spare.withColumn("off", F.abs(F.col("gap") - F.col("size"))).filter(F.col("off") < F.abs(F.col("gap")))
    fill = written(spare.groupBy("source").agg(F.min(F.struct("off", "rank", "id", "print", "row")).alias("fill")).select("source", F.col("fill.row").alias("fill")), "fills")
    out = _by_source(copied(base), fill).withColumn("copies", F.col("copies") + F.coalesce((F.col("row") == F.col("fill")).cast("long"), F.lit(0)))
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    results = ["size", "source_size", "target", "copies", "taken"]
    if carry:
        return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in results], *results)
    return out.select("id", "print", "source", *results)


def _key() -> Column:
    """What orders the rows of a bin; null ids first."""
    return F.struct("rank", F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "print", "row")
