"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample (iterative quantisation: rotations that
bring the vectors near the corners of a cube) turn every vector into a binary
code. A code is cut into substrings, and the codes are stored once. Each block
of rows keeps, for every substring, a table from value to bucket. By the
pigeonhole principle a code within a radius r of the query's has some substring
that differs in few bits, so looking up the buckets of all values at that
smaller radius fetches all codes within r; these are checked on their whole
codes and reranked by the cosine of the original vectors. Where more values lie
within the smaller radius than a block has buckets, its buckets are gone
through instead, which fetches the same codes.

The radius is learned on the sample, so that it holds nearly all true
neighbours there. Queries that find too few neighbours are searched again with
a larger radius, at last with one that holds all codes.

Equal vectors are one entry of the index with their k + 1 smallest ids, as no
answer can need more of them; so large groups of copies cost no more than one
vector. Queries go to the tasks in blocks of a fixed number, against all
entries; each task keeps only the best of its entries for each query.

Vectors that are null or zero, that hold null or non-finite components, or
that differ in length from most of the sample take no part. Vectors of any
finite size do: they are brought near length 1 by an exact power of two first.
Ties go to the smaller id; long vectors make samples and blocks of queries
smaller, so that neither outgrows BYTES; repeated rows of an
id are each a candidate, and the query is asked once, by the smallest of its
vectors; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import received, scratch, sent, written

#: Bits of a code and of a substring.
BITS, PART = 256, 16
#: Vectors in the sample, sample queries for the radius, share of their neighbours that it must hold.
SAMPLE, ASKED, HELD = 8192, 256, 0.99
#: Queries in a block that is broadcast, rows in a block that is indexed, queries probed at once.
QUERIES, ROWS, AT_ONCE = 16_384, 16_384, 64
#: Bytes of the vectors in the sample, and in a block of queries, at most: long vectors make both smaller.
BYTES = 64 << 20


def usable(vector: str):
    """Rows whose vector is there, finite and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings their largest part between 1/2 and 1: exact, and squares stay in the range of doubles."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))
    return np.ldexp(x, -power)


class Codes:
    """The learned rotations and the radius."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 3):
        x = scaled(sample)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.mean = x.mean(0)
        v = x - self.mean
        _, axes = np.linalg.eigh(v.T @ v)
        axes = axes[:, ::-1][:, :BITS]
        v, rng, turns = v @ axes, np.random.default_rng(seed), []
        while sum(t.shape[1] for t in turns) < BITS:
            turn, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
            for _ in range(30):
                u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
                turn = (u @ w).T
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, axis=1)[:, :BITS]
        self.radius = self._learn(x, k)

    def _learn(self, x: np.ndarray, k: int) -> int:
        """The radius that holds nearly all nearest neighbours of some of the sample."""
        code, asked = words64(self.of(x)), min(ASKED, len(x))
        cos = x[:asked] @ x.T
        cos[np.arange(asked), np.arange(asked)] = -2
        near = np.argsort(-cos, axis=1)[:, : min(k, len(x) - 1)]
        if not near.size:
            return BITS
        far = np.bitwise_count(code[:asked, None] ^ code[near]).sum(-1)
        return int(np.quantile(far, HELD, method="higher"))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of normalised vectors, as substrings."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1).view(np.uint16)


def words64(code: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(code).view(np.uint64)


def within(radius: int) -> list[int]:
    """The radius at which each substring is probed: if r = m * s + a, a + 1 substrings at s and the others at s - 1 are enough."""
    m = BITS // PART
    s, a = divmod(radius, m)
    return [s if j <= a else s - 1 for j in range(m)]


@cache
def masks(radius: int) -> np.ndarray:
    """All substrings with `radius` bits set at most."""
    return np.array([sum(1 << b for b in bits) for n in range(min(radius, PART) + 1) for bits in combinations(range(PART), n)], np.uint16)


class Block:
    """Entries with a table of the buckets of every substring."""

    def __init__(self, code: np.ndarray):
        self.code, self.tables = code, []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable").astype(np.int32)
            values, start = np.unique(code[order, j], return_index=True)
            bucket = np.full(1 << PART, -1, np.int32)
            bucket[values] = np.arange(len(values))
            self.tables.append((values, np.append(start, len(order)), order, bucket))

    def fetch(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and entry numbers of all pairs whose codes differ in `radius` bits at most."""
        n, found = len(self.code), []
        for j, near in enumerate(within(radius)):
            if near < 0:
                continue
            values, start, order, bucket = self.tables[j]
            if len(masks(near)) <= len(values):
                hit = bucket[asked[:, j, None] ^ masks(near)[None, :]]
                q, at = np.nonzero(hit >= 0)
                at = hit[q, at]
            else:
                q, at = np.nonzero(np.bitwise_count(asked[:, j, None] ^ values[None, :]) <= near)
            size = start[at + 1] - start[at]
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[at], size)
            found.append(np.repeat(q, size) * n + order[place])
        pairs = unique(found, len(asked) * n)
        q, r = pairs // n, pairs % n
        far = np.bitwise_count(words64(asked)[q] ^ words64(self.code)[r]).sum(1)
        return q[far <= radius], r[far <= radius]


def unique(parts: list[np.ndarray], room: int) -> np.ndarray:
    """The distinct of numbers below room: sorted where they are few, by a bitmap where they are many."""
    if sum(map(len, parts)) < room // 64:
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
    seen = np.zeros(room, bool)
    for x in parts:
        seen[x] = True
    return np.flatnonzero(seen)


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k largest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    first = np.searchsorted(q[order], q[order], side="left")
    return order[np.arange(len(order)) - first < k]


def _encoder(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = received(shared)
        for b in batches:
            if b.num_rows:
                x = scaled(b.column("v").flatten().to_numpy().astype(float).reshape(-1, dim))
                code = codes.of(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([b.column("ids"), b.column("v"), pa.array([c.tobytes() for c in code], pa.binary())], names=["ids", "v", "code"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            if held and sum(b.num_rows for b in held) + min(ROWS, batch.num_rows - at) > ROWS:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, ROWS))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _searcher(shared, k: int, radius: int):
    fields = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("radius", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, qid, qx = received(shared)
        qx = scaled(qx)
        dim, qnorm = qx.shape[1], np.linalg.norm(qx, axis=1)
        asked = codes.of(qx / qnorm[:, None])
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, float))
        for t in _blocks(batches):
            ids, x, code = (t.column(c).combine_chunks() for c in ("ids", "v", "code"))
            count = ids.value_lengths().to_numpy()
            first, ids = np.cumsum(count) - count, ids.flatten().to_numpy()
            x = scaled(x.flatten().to_numpy().reshape(-1, dim))
            norm = np.linalg.norm(x, axis=1)
            block = Block(np.frombuffer(b"".join(code.to_pylist()), np.uint16).reshape(len(x), -1))
            for i in range(0, len(qid), AT_ONCE):
                q, r = block.fetch(asked[i : i + AT_ONCE], radius)
                q = q + i
                score = np.einsum("ij,ij->i", qx[q], x[r]) / (qnorm[q] * norm[r])
                # each entry for all its ids
                n = count[r]
                each = ids[np.repeat(first[r], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                q, score = np.repeat(q, n), np.repeat(score, n)
                other = qid[q] != each
                new = tuple(np.concatenate(c) for c in zip(found, (q[other], each[other], score[other]), strict=True))
                kept = best(*new, k)
                found = tuple(c[kept] for c in new)
        yield pa.RecordBatch.from_arrays([pa.array(qid[found[0]]), pa.array(found[1]), pa.array(found[2]), pa.array(np.full(len(found[0]), radius, np.int32))], schema=fields)

    return run


def search(vectors: DataFrame, *, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine; queries are the rows whose id is divisible by `every`."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable("v") & F.col("id").isNotNull())
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # one entry for equal vectors, with its k + 1 smallest ids, each k times at most
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = own.groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n")).withColumn("place", place).filter(F.col("place") <= k + 1)
    entries = written(few.groupBy("v").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("id", F.col("n"))))).alias("ids")), "entries")
    total, widest = entries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = min(SAMPLE, max(1, BYTES // (8 * max(widest or 1, 1))))
    # a bounded sample, by hash: the share lets about two samples pass, so that many partitions do not each send a whole one
    order = F.pmod(F.xxhash64(F.lit(11), "v"), F.lit(1 << 30))
    passing = entries.filter(order < F.lit(min(1 << 30, (1 << 31) * most // max(total, 1))))
    rows = passing.orderBy(order, "v").limit(most).select("v").toArrow().column("v").combine_chunks()
    if not len(rows):
        return none
    lengths = rows.value_lengths().to_pylist()
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    codes = Codes(np.array([v for v, n in zip(rows.to_pylist(), lengths, strict=True) if n == dim], float), k)
    index = written(entries.filter(F.size("v") == dim).mapInArrow(_encoder(sent(spark, codes), dim), "ids array<bigint>, v array<double>, code binary"), "index")
    total = own.filter(F.size("v") == dim).count()

    asked = own.filter((F.col("id") % every == 0) & (F.size("v") == dim)).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // min(QUERIES, max(1, BYTES // (8 * dim)))))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(blocks)).cast("int")), "asked")
    path, schema = f"{scratch(spark)}/{uuid.uuid4().hex}-hits", "query_id bigint, vec_id bigint, score double, radius int"
    for n in range(blocks):
        left, radius = asked.filter(F.col("block") == n), codes.radius
        while True:
            t = left.select("id", "v").toArrow()
            if not t.num_rows:
                break
            shared = sent(spark, (codes, t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)))
            index.mapInArrow(_searcher(shared, k, radius), schema).write.mode("append").parquet(path)
            if radius >= BITS:
                break
            got = spark.read.schema(schema).parquet(path).filter(F.col("radius") == radius).groupBy("query_id").count().filter(F.col("count") >= min(k, total - 1))
            left = written(left.join(got.hint("merge"), left["id"] == got["query_id"], "left_anti"), "left")
            radius = min(BITS, radius + BITS // 8)
    if asked.isEmpty():
        return none
    hits = spark.read.schema(schema).parquet(path)
    # a query that was asked again is answered by its last radius
    last = hits.withColumn("last", F.max("radius").over(W.partitionBy("query_id"))).filter("radius = last")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return last.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
