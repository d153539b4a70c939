"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written

#: Steps before the job gives up; a path of n vertices needs about log2(n).
MOST = 60
#: Edges that a task ties together at once.
AT_ONCE = 500_000
#: Parts into which the edges of a vertex with very many are dealt.
SALTS = 1024


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, AT_ONCE at a time, as edges of each vertex to the smallest that these edges reach."""

    def tied(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in root]
        a, b = ([r[k] for r in rows if r[0] != r[1]] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        while len(held) > AT_ONCE:
            yield tied(held[:AT_ONCE])
            held = held[AT_ONCE:]
    yield tied(held)


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(a, b, least): each edge (a, b) with its vertex's row of least (a, least, n).

    A vertex with more than a thousandth of all edges would gather them in one
    task. There are fewer than 1000 such vertices, so their rows are broadcast
    and their edges dealt over the tasks of the join, where they meet nothing.
    """
    hot = least.filter(F.col("n") > max(100, total // 1000)).select("a", F.col("least").alias("near"))
    salted = edges.join(F.broadcast(hot), "a", "left").withColumn("salt", F.when(F.col("near").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")))
    others = least.select("a", F.lit(0).alias("salt"), "least")
    return salted.join(others.hint("merge"), ["a", "salt"], "left").select("a", "b", F.coalesce("near", "least").alias("least"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of edges (a, b) that has an edge to another; component is the smallest id reachable.

    Each task first ties the edges that it holds, AT_ONCE at most at a time; if
    that was all there are, nothing is left to tie. Then both steps replace a
    vertex's edges by edges to its smallest neighbour, so the edges stay no more
    than before and the components stay the same. When a round changes nothing,
    all edges point at the smallest vertex of their component.
    """
    schema = "a bigint, b bigint"
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(now.distinct(), "edges")
    total = now.count()
    now = written(now.coalesce(max(1, -(-total // AT_ONCE))).mapInArrow(_forest, schema), "edges")
    if total <= AT_ONCE:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    state = _state(now)
    for _ in range(MOST):
        # large star: each larger neighbour of a vertex is tied to the vertex's smallest neighbour, or to it
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = now.unionByName(up).groupBy("a").agg(F.min("b").alias("least"), F.count_if(F.col("b") > F.col("a")).alias("n")).withColumn("least", F.least("a", "least"))
        large = written(_with_least(up, least, state[0]).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "large")
        # small star: a vertex and its smaller neighbours are tied to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, least, state[0]).select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        now = written(small.filter("a <> b").distinct().mapInArrow(_forest, schema), "edges")
        state, last = _state(now), state
        if state == last:
            break
    else:
        raise RuntimeError(f"components not found in {MOST} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of what has been found and more edges."""
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges.select("a", "b")))
