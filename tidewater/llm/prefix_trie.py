"""Prefix trie of conversations that are rebuilt from a base's head and their own rest.

No rebuilt conversation is ever put together. A sequence of turns has a
fingerprint (sum of x_i * B^i, B^length) modulo the prime P, with x_i a hash of
role and text; two of them multiply as (a, s) * (b, t) = (a + s * b, s * t), so
the fingerprint of every rebuilt prefix follows from running sums over the
original conversations: the base's up to the head, and the own sums after it,
moved by a power of B. Three such numbers and the depth name a node.

Each prefix keeps a reference to the original turn that it ends with, and that
turn's SHA-256. A node is right if all its prefixes end with equal turns and
have one parent; as this is tested for every node, equality follows from the
root down. If the test fails anywhere, all is done again with another seed.

Sums over subtrees need no walk: a conversation is the smallest member of its
nodes from some depth on, so what a subtree saves is, summed over the members,
the length of their turns between the subtree's top and that depth, and its
leaves are the members that are smallest at a leaf. Turns are numbered by
ranges, so a long conversation fills many tasks; only ranges of the few
conversations that lie in several are broadcast, two a range at most. The
digest of a node's ends reads them in packs that ranges have put together.

Turns of one conversation with equal turn numbers, null first, stand in the
order of the SHA-256 of role and text. Null roles and texts are empty, empty
texts have length 0, very long ones are hashed whole; repeated rows are turns
of their own. Rows without a conversation id belong to none and are left out.
An empty table gives an empty result; columns other than the four are not
touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import hot_join, hot_keys, written

#: The prime, and the bases of the three fingerprints.
P, BASES = (1 << 31) - 1, (1_103_515_245, 69_069_691, 1_812_433_253)
#: Bytes of ids that one row of a digest holds at most.
PACK = 1 << 16


def _power(base: int, exponent: Column) -> Column:
    """base to the exponent modulo P, by squares that are known beforehand."""
    squares = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(pow(base, 1 << b, P)).cast("long").alias("square")) for b in range(31)])
    exponent = (exponent % (P - 1)).cast("long")
    return F.aggregate(squares, F.lit(1).cast("long"), lambda x, s: F.when(exponent.bitwiseAND(s["bit"]) != 0, x * s["square"] % P).otherwise(x))


def _numbered(rows: DataFrame, seed: int) -> DataFrame:
    """conv, pos (from 0), print, length, cum (code points up to here), f (three running fingerprints), x (this turn's part of them)."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("print"), F.col("row")]
    # the row's number parts equal rows, which may be many
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.select("conv", "print", "length", "hash", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "turns")
    own = W.partitionBy("part", "conv").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)

    # conversations in several ranges: the first and last of a range at most
    counts = ranged.groupBy("part", "conv").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("codes"))
    counts = written(counts.withColumn("ranges", F.count(F.lit(1)).over(W.partitionBy("conv"))).filter("ranges > 1"), "ranges")
    starts = written(counts.select("part", "conv", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("codes").over(before), F.lit(0)).alias("ahead")), "starts")
    placed = ranged.join(F.broadcast(starts), ["part", "conv"], "left")
    placed = placed.withColumn("pos", F.row_number().over(own) - 1 + F.coalesce("first", F.lit(0)))
    parts = [F.pmod(F.xxhash64(F.lit(seed * 7 + k), "hash"), F.lit(P)) * _power(b, F.col("pos")) % P for k, b in enumerate(BASES)]
    placed = placed.withColumn("x", F.array(*parts))
    sums = placed.join(F.broadcast(starts.select("part", "conv")), ["part", "conv"], "left_semi").groupBy("part", "conv").agg(*[(F.sum(F.col("x")[k]) % P).alias(f"s{k}") for k in range(3)])
    sums = written(sums.select("part", "conv", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"s{k}") for k in range(3)]), "sums")
    out = placed.join(F.broadcast(sums), ["part", "conv"], "left")
    f = F.array(*[(F.coalesce(f"s{k}", F.lit(0)) + F.sum(F.col("x")[k]).over(own)) % P for k in range(3)])
    return written(out.select("conv", "pos", "print", "length", (F.coalesce("ahead", F.lit(0)) + F.sum("length").over(own)).alias("cum"), f.alias("f"), "x"), "prefixes")


def _moved(x: Column, by: Column, most: int) -> Column:
    """Fingerprints divided by B to the power `by` (0 to most), each with its own B."""
    tables = [F.array(*[F.lit(pow(b, -k, P)).cast("long") for k in range(most + 1)]) for b in BASES]
    return F.array(*[x[k] * F.element_at(t, (by + 1).cast("int")) % P for k, t in enumerate(tables)])


def _sum(*parts: Column) -> Column:
    """Fingerprints added."""
    return F.array(*[F.pmod(sum((p[k] for p in parts[1:]), parts[0][k]), F.lit(P)) for k in range(3)])


def _less(x: Column) -> Column:
    return F.transform(x, lambda v: -v)


def _name(depth: Column, f: Column) -> Column:
    return F.concat_ws(".", depth.cast("string"), *[f[k].cast("string") for k in range(3)])


def _prefixes(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: conv, depth, node, parent, print, length, before (code points ahead of the last turn), total (of all turns), end (no further turn), and the turn that it ends with: of, at."""
    zero = F.array(*[F.lit(0).cast("long")] * 3)
    first = F.collect_list(F.when(F.col("pos") < most, F.struct("pos", "f", "x", "print", "length", "cum")))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("cum").alias("codes"), F.array_sort(first).alias("first"))
    convs = written(convs.withColumn("h", head(F.col("conv")).cast("int")).withColumn("base", base(F.col("conv"))), "convs")
    bases = convs.select(F.col("conv").alias("base"), F.col("first").alias("there"))
    plan = convs.join(bases.hint("merge"), "base", "left").withColumn("there", F.slice("there", 1, F.col("h")))

    def at(rows: str, k: Column, field: str, other: Column) -> Column:
        """A field of the k-th turn, counted from 1."""
        return F.coalesce(F.get(rows, k - 1)[field], other)

    skip = F.least("h", F.col("n")).cast("int")
    plan = plan.withColumn("g", F.coalesce(F.size("there"), F.lit(0))).withColumn("rest", F.col("n") - skip)
    plan = plan.withColumn("gf", at("there", F.col("g"), "f", zero)).withColumn("gc", at("there", F.col("g"), "cum", F.lit(0)))
    plan = plan.withColumn("sf", at("first", skip, "f", zero)).withColumn("sc", at("first", skip, "cum", F.lit(0)))
    plan = plan.withColumn("total", F.col("gc") + F.col("codes") - F.col("sc")).withColumn("size", F.col("g") + F.col("rest")).drop("first")
    plan = written(plan, "plan")

    names = ["conv", "depth", "node", "parent", "print", "length", "before", "total", "end", "of", "at"]
    none, null = F.lit(0).cast("long"), F.lit(None)
    root = plan.select("conv", none.alias("depth"), _name(none, zero).alias("node"), null.cast("string").alias("parent"), null.cast("binary").alias("print"), none.alias("length"), none.alias("before"), "total", (F.col("size") == 0).alias("end"), null.cast("long").alias("of"), null.cast("long").alias("at"))
    heads = plan.select("conv", "size", "total", "base", F.explode("there").alias("t")).withColumn("depth", F.col("t.pos") + 1)
    heads = heads.withColumns({"node": _name(F.col("depth"), F.col("t.f")), "parent": _name(F.col("depth") - 1, _sum(F.col("t.f"), _less(F.col("t.x")))), "print": F.col("t.print"), "length": F.col("t.length"), "before": F.col("t.cum") - F.col("t.length"), "end": F.col("depth") == F.col("size"), "of": F.col("base"), "at": F.col("t.pos")}).select(*names)
    rest = turns.filter(F.col("pos") >= head(F.col("conv"))).join(plan.select("conv", "h", "g", "gf", "gc", "sf", "sc", "size", "total").hint("merge"), "conv")
    rest = rest.withColumn("depth", F.col("g") + F.col("pos") - F.col("h") + 1).withColumn("f", _sum(F.col("gf"), _moved(_sum(F.col("f"), _less(F.col("sf"))), F.col("h") - F.col("g"), most)))
    rest = rest.withColumns({"node": _name(F.col("depth"), F.col("f")), "parent": _name(F.col("depth") - 1, _sum(F.col("f"), _less(_moved(F.col("x"), F.col("h") - F.col("g"), most)))), "before": F.col("gc") + F.col("cum") - F.col("sc") - F.col("length"), "end": F.col("depth") == F.col("size"), "of": F.col("conv"), "at": F.col("pos")}).select(*names)
    return written(root.unionByName(heads).unionByName(rest), "paths")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, conv (the first of the pack), ids: consecutive ids of a node, comma-joined."""
    node, first, ids, size = None, 0, [], 0
    out: list[tuple[str, int, str]] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["node", "conv", "ids"])

    for b in batches:
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n != node or size > PACK:
                if ids:
                    out.append((node, first, ",".join(ids)))
                node, first, ids, size = n, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        yield batch()
    if ids:
        out.append((node, first, ",".join(ids)))
    yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256 of packs in order."""
    node, state = None, hashlib.sha256()
    out: list[tuple[str, str]] = []
    for b in batches:
        for n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])
        out.clear()
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def trie(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", base: Callable[[Column], Column] = lambda c: c - c % 100, head: Callable[[Column], Column] = lambda c: F.crc32(c.cast("string").cast("binary")) % 6, most: int = 5, tries: int = 8) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and ref_conv, ref_pos: the original turn that it ends with.

    Every conversation c is its base's first head(c) turns (`most` at most; all
    if there are fewer) and its own turns after its first head(c).
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    slim = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv is not null")
    print_ = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    slim = slim.select("conv", "turn", print_.alias("print"), F.xxhash64("role", "text").alias("hash"), F.char_length("text").cast("long").alias("length"))
    for seed in range(tries):
        paths = _prefixes(_numbered(slim, seed), base, head, most)
        nodes = paths.groupBy("node").agg(
            F.first("depth").alias("depth"),
            F.min(F.struct("conv", "before", "of", "at")).alias("least"),
            F.count(F.lit(1)).alias("n_convs"),
            F.first("length").alias("length"),
            F.min("parent").alias("parent"),
            (~F.min("parent").eqNullSafe(F.max("parent")) | ~F.min("print").eqNullSafe(F.max("print"))).alias("mixed"),
        )
        nodes = written(nodes, "nodes")
        if nodes.filter("mixed").isEmpty():
            break
    else:
        raise ArithmeticError("fingerprints met for different prefixes under every seed")

    children = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).filter("parent is not null").withColumnRenamed("parent", "node")
    nodes = written(nodes.join(children.hint("merge"), "node", "left").select("node", "parent", "depth", "n_convs", "least", F.coalesce("n_children", F.lit(0)).alias("n_children")), "nodes")
    # of each conversation that is smallest somewhere: the code points ahead of the first such node, and whether one is a leaf
    owners = nodes.groupBy(F.col("least.conv").alias("conv")).agg(F.min(F.struct("depth", "least.before"))["before"].alias("since"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    shares = paths.join(owners.hint("merge"), "conv", "left")
    shares = shares.groupBy("node").agg(F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.coalesce("since", "total") - F.col("before"))).alias("saved_tokens"))
    ends = paths.filter("end").select("node", "conv")
    packs = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_packed, "node string, conv bigint, ids string")
    digests = packs.repartition("node").sortWithinPartitions("node", "conv").mapInArrow(_digests, "node string, ends_sha256 string")
    above = nodes.select(F.col("node").alias("parent"), F.col("least.conv").alias("parent_conv_id"))
    out = hot_join(nodes, above, "parent", hot_keys(nodes, "parent"), "left")
    out = out.join(shares.hint("merge"), "node").join(digests.hint("merge"), "node", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("least.conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), F.col("least.of").alias("ref_conv"), F.col("least.at").alias("ref_pos"))
