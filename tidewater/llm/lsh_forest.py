"""Near-duplicate detection with an LSH forest.

A text's word shingles are hashed to a set; equal sets form a class, and the
classes' smallest documents go on. Each of several trees gives them a
signature of min-hashes. A tree is kept as a sorted order: the rows are range
partitioned by (tree, signature), sorted, and streamed, and each row is paired
with its nearest rows before it as long as they share a prefix of at least
`depth` min-hashes. In dense regions the nearest rows are those with the
longest common prefixes, so the depth adapts to the region. Rows at the ends
of partitions are compared across the border in the same way.

Candidates whose signatures agree well enough are confirmed on their full
sets. First each row's best candidate is confirmed; then those candidates that
would join different components. Components of confirmed links and classes
give the result, so that large groups of copies cost no pairs but a few each.

A window loses pairs where more rows share a prefix than it holds. So each
row's chance to be missed is computed from the prefixes that its windows did
not cover, and rows above a limit are crowded. Crowded rows that share many
min-hashes in one of many drawn groups are tied to regions, and inside a region
all pairs of rows of different components are compared on their full sets, a
pair of blocks of rows a task.

Texts with fewer words than a shingle have one shingle, the whole sequence;
null texts and texts without words have the empty set and are linked with
nothing. Rows with a null id are kept apart: no component, kept. Repeated rows
give one row an id. A component is named by its smallest id, so ties of similarity
do not matter. An empty table gives an empty result. Other columns are not
touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hot_join, hot_keys, written
from .components import components, joined

#: Trees, min-hashes in a tree's signature, rows before a row that it is paired with in each tree.
TREES, LENGTH, NEAR = 16, 8, 4
#: Min-hashes that candidates must share from the start of a tree's signature.
DEPTH = 2
#: Chance of missing a link at the limit above which a row is crowded; groups of min-hashes, and their size, that tie crowded rows to regions.
MISSED, GROUPS, DEEP = 1e-5, 128, 8
#: Rows, and shingles, of a block of a region.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000
MIX = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: 1 for ASCII white space.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word between white space: a polynomial of its bytes, mixed with its length."""
    data = np.frombuffer(text, np.uint8)
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    length = edge[1::2] - edge[::2]
    if not len(length):
        return np.empty(0, np.uint64)
    first = np.cumsum(length) - length
    power = np.cumprod(np.full(int(length.max()), MIX, np.uint64))
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    sums = np.add.reduceat(data[inside].astype(np.uint64) * power[place], first)
    return _mixed(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's word shingles (A-Z lower-cased), sorted."""
    h = word_hashes((text or b"").lower())
    if not len(h):
        return h
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k if k < width else 0, np.uint64)
    for i in range(k):
        out = _mixed(out * np.uint64(MIX) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _functions(n: int) -> np.ndarray:
    """n odd 32-bit multipliers for min-hashing, always the same, as a column."""
    return (_mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(MIX)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def signature(own: np.ndarray, multipliers: np.ndarray, step: int = 512) -> np.ndarray:
    """The smallest 32-bit multiples of the upper halves of the set's hashes, a step of the set at a time to stay in cache."""
    upper = (own >> np.uint64(32)).astype(np.uint32)
    best = (multipliers * upper[:step]).min(axis=1)
    for i in range(step, len(upper), step):
        best = np.minimum(best, (multipliers * upper[i : i + step]).min(axis=1))
    return best


def _prints(width: int):
    fields = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _functions(TREES * LENGTH)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text in b.column(1).to_pylist():
                own = shingles(text, width)
                # two sums over the set tell sets apart; mixing again makes them independent of the hashes' own sums
                one = int(_mixed(own + np.uint64(MIX)).sum(dtype=np.uint64)) if len(own) else 0
                two = int(_mixed(own ^ np.uint64(MIX)).sum(dtype=np.uint64)) if len(own) else 0
                for column, x in zip(out, (len(own), one - (1 << 63), two - (1 << 63), signature(own, multipliers).astype(">u4").tobytes() if len(own) else None), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(fields)[1:], strict=True))], schema=fields)

    return run


def _common(a: bytes, b: bytes) -> int:
    """Min-hashes that two signatures of a tree share from the start."""
    n = 0
    while n < len(a) and a[n : n + 4] == b[n : n + 4]:
        n += 4
    return n // 4


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("part", pa.int32()), ("beyond", pa.int32())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of near rows of a sorted partition, its first and last rows with an empty b for the border, and what the windows did not cover."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    near: list[tuple[int, bytes, int]] = []
    seen = 0
    for batch in batches:
        rows = []
        for row in zip(*(batch.column(k).to_pylist() for k in ("tree", "key", "id")), strict=True):
            rows += _paired(row, near)
            if seen <= NEAR:
                rows.append((row[2], None, *row[:2], None))
            near = [*near[-NEAR:], row]
            seen += 1
        yield _rows([(*r[:4], part, r[4]) for r in rows], _FOUND)
    if seen > NEAR + 1:
        yield _rows([(r[2], None, r[0], r[1], part, None) for r in near[-min(NEAR + 1, seen - NEAR - 1) :]], _FOUND)


def _paired(row: tuple[int, bytes, int], near: list[tuple[int, bytes, int]]) -> list[tuple]:
    """Pairs with the window's rows; both ends of a prefix that reaches one row beyond the window, with its length."""
    tree, key, i = row
    out = []
    for n, (t, k, j) in enumerate(reversed(near)):
        common = _common(k, key) if t == tree else 0
        if common < DEPTH:
            break
        if n < NEAR:
            out.append((max(i, j), min(i, j), None, None, None))
        else:
            out += [(i, None, tree, None, common), (j, None, tree, None, common)]
    return out


def _rows(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=fields)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same across the borders of partitions, from their sorted end rows."""
    near: list[tuple[int, bytes, int]] = []
    for batch in batches:
        rows = []
        for row in zip(*(batch.column(k).to_pylist() for k in ("tree", "key", "a")), strict=True):
            rows += [(*r[:4], None, r[4]) for r in _paired(row, near)]
            near = [*near, row][-NEAR - 1 :]
        yield _rows(rows, _FOUND)


def candidates(prints: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a > b) of rows of (id, sig) that are near each other in some tree, and the ids of crowded rows."""
    size, schema = 4 * LENGTH, "a bigint, b bigint, tree int, key binary, part int, beyond int"
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.expr(f"substring(sig, {1 + t * size}, {size})").alias("key")) for t in range(TREES)]))
    rows = prints.filter("sig is not null").select("id", trees.alias("x")).select("x.tree", "x.key", "id")
    order = ["tree", "key", "id"]
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, schema)
    found = written(found, "neighbours")
    # a few rows a partition
    ends = found.filter("key is not null").select("tree", "key", "a").distinct().coalesce(1).sortWithinPartitions("tree", "key", "a")
    every = found.filter("key is null").unionByName(written(ends.mapInArrow(_borders, schema), "borders"))
    pairs = every.filter("b is not null and a <> b").select("a", "b").distinct()
    # a tree finds a pair that shares one min-hash more than its window left out
    beyond = every.filter("beyond is not null").groupBy(F.col("a").alias("id"), "tree").agg(F.max("beyond").alias("beyond"))
    share = F.lit(percent / 100)
    missed = F.when(F.col("beyond") < LENGTH, F.ln(1 - F.pow(share, F.col("beyond") + 1))).otherwise(0.0)
    least = float(np.log1p(-((percent / 100) ** DEPTH))) if percent < 100 else -1e9
    crowded = beyond.groupBy("id").agg((F.sum(missed) + (TREES - F.count(F.lit(1))) * F.lit(least)).alias("missed"))
    return pairs, crowded.filter(F.col("missed") > float(np.log(MISSED))).select("id")


def _deep_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of each row in each group of min-hashes."""
    rng = np.random.default_rng(7)
    groups = [rng.choice(TREES * LENGTH, DEEP, replace=False) for _ in range(GROUPS)]
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("id")
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), ">u4").reshape(b.num_rows, -1).astype(np.uint64)
        for g, own in enumerate(groups):
            key = np.full(b.num_rows, g + 1, np.uint64)
            for c in own:
                key = _mixed(key * np.uint64(MIX) + sig[:, c])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], names=["key", "id"])


def _compared(percent: int):
    """Links of one pair of blocks between rows of different components: what joins them, not all pairs."""

    def run(t: pa.Table) -> pa.Table:
        i, component, block = (t.column(k).to_numpy() for k in ("id", "component", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("own").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        row, several = np.repeat(np.arange(len(sets)), sizes), count[token] > 1
        place = (np.cumsum(count > 1) - 1)[token[several]]
        row = row[several]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        common, step = np.zeros((len(sets), len(sets)), np.float32), 2048
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, step):
            lo, hi = np.searchsorted(place, (at, at + step))
            x = np.zeros((len(sets), min(step, int(place[-1]) + 1 - at)), np.float32)
            x[row[lo:hi], place[lo:hi] - at] = 1
            common += x @ x.T
        common = common.astype(np.int64)
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        # blocks of their own are compared where they stand alone
        if len(np.unique(block)) > 1:
            linked &= block[:, None] != block[None, :]
        root, out = component.copy(), []
        for k in range(len(sets)):
            others = np.flatnonzero(linked[k] & (root != root[k]))
            for r, j in {int(root[j]): int(j) for j in others}.items():
                out.append((max(int(i[k]), int(i[j])), min(int(i[k]), int(i[j]))))
                root[root == r] = root[k]
        fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        return pa.Table.from_batches([_rows(out, fields)], schema=fields)

    return run


def _dense_links(own: DataFrame, firsts: DataFrame, crowded: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links among crowded rows that components do not join yet."""
    from pyspark.sql import Window as W

    crowded = written(crowded, "crowded")
    if crowded.isEmpty():
        return None
    keys = firsts.join(crowded, "id", "left_semi").select("id", "sig").mapInArrow(_deep_keys, "key bigint, id bigint")
    tied = keys.select("id", F.first("id").over(W.partitionBy("key").orderBy("id")).alias("b")).filter("id <> b").distinct()
    regions = components(tied.withColumnRenamed("id", "a"))
    members = regions.unionByName(regions.select(F.col("component").alias("id"), "component").distinct()).distinct().withColumnRenamed("component", "region")
    rows = members.join(found.hint("merge"), "id", "left").select("id", "region", F.coalesce("component", "id").alias("component"))
    rows = written(rows, "regions")
    open_ = rows.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("region")
    # a region may hold a large part of all rows
    hot = hot_keys(rows, "region")
    rows = written(hot_join(rows, open_, "region", hot, "left_semi"), "open")
    if rows.isEmpty():
        return None
    sets = own.join(rows, "id").dropDuplicates(["id"]).select("text", "id", "region", "component")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("id", "region", "component")), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "region", "component", "n", "own"])

    sets = written(sets.mapInArrow(shingled, "id bigint, region bigint, component bigint, n bigint, own binary"), "region_sets")
    blocks = sets.groupBy("region").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = hot_join(sets, blocks, "region", hot).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("region", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "component", "block", "own")
    return written(rows.groupBy("region", "x", "y").applyInArrow(_compared(percent), "a bigint, b bigint"), "dense")


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), ">u4").reshape(b.num_rows, -1) for k in ("sa", "sb"))
        agree = (x == y).sum(1).astype(np.int32) if b.num_rows else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(agree)], names=["a", "b", "agree"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t, width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], names=["id", "own"])

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a, b = (sets.select(F.col("id").alias(k), F.col("own").alias(f"x{k}")) for k in "ab")
    full = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "xa", "xb")
    return written(full.mapInArrow(_confirmer(percent), "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row an id: id, n_shingles, component (smallest id reachable over links, itself included), kept.

    width is the words of a shingle; two documents are linked if their sets'
    intersection is at least `percent` of their union.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = written(own.mapInArrow(_prints(width), "id bigint, n bigint, d1 bigint, d2 bigint, sig binary"), "prints")
    slim = prints.select("id", "n", "d1", "d2").distinct()
    # one class for each set; empty sets and null ids stand alone
    classes = prints.filter("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(F.min("id").alias("first"), F.first("sig").alias("sig"))
    classes = written(classes, "classes")
    firsts = classes.select(F.col("first").alias("id"), "sig")

    pairs, crowded = candidates(firsts, percent)
    a, b = (firsts.select(F.col("id").alias(k), F.col("sig").alias(f"s{k}")) for k in "ab")
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "sa", "sb")
    # an agreement six standard deviations below what the limit lets expect is no link
    n, share = TREES * LENGTH, percent / 100
    least = n * share - 6 * (n * share * (1 - share)) ** 0.5
    pairs = written(both.mapInArrow(_agreements, "a bigint, b bigint, agree int").filter(F.col("agree") >= least), "pairs")

    concerned = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = own.join(written(concerned, "concerned"), "id", "left_semi").mapInArrow(_sets(width), "id bigint, own binary")
    sets = written(sets.dropDuplicates(["id"]), "sets")
    # the best candidate of each row first, the smallest of equals; then only what would join different components
    best = pairs.groupBy("a").agg(F.max(F.struct("agree", -F.col("b"))).alias("x")).select("a", (-F.col("x.col2")).alias("b"))
    links = _confirmed(best, sets, percent)
    found = components(links)
    rest = pairs.select("a", "b").join(links.hint("merge"), ["a", "b"], "left_anti")
    ca, cb = (found.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    rest = rest.join(ca.hint("merge"), "a", "left").join(cb.hint("merge"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    found = joined(found, _confirmed(rest.select("a", "b"), sets, percent))
    dense = _dense_links(own, firsts, crowded, found, width, percent)
    if dense is not None:
        found = joined(found, dense)

    # classes get their first document's component, documents their class's
    of_class = classes.join(found.withColumnRenamed("id", "first").hint("merge"), "first", "left").select("n", "d1", "d2", F.coalesce("component", "first").alias("of_class"))
    of_class = written(of_class, "of_class")
    out = slim.join(of_class.hint("merge"), ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("of_class")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document, the smallest id, of each group of near-duplicates; all columns stay, rows with a null id too.

    Of rows that repeat an id the one with the smallest text stays.
    """
    out = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    gone = written(out.filter("not kept").select(F.col("id").alias("_tw_id")), "gone")
    repeated = written(docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_tw_id")).count().filter("count > 1").select("_tw_id"), "repeated")
    own = F.col(id_col).cast("long") == F.col("_tw_id")
    left = docs.join(gone, own, "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, own, "left_anti")
    several = left.join(repeated, own, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(text_col)).alias("_tw_row"))
    # nulls are never the smallest of several, so rows whose texts are all null are taken as they come
    bare = left.join(repeated, own, "left_semi").filter(F.col(text_col).isNull()).dropDuplicates([id_col])
    texts = several.filter("_tw_row is not null").select("_tw_row.*")
    return once.unionByName(texts).unionByName(bare.join(texts.select(F.col(id_col).cast("long").alias("_tw_id")), own, "left_anti"))
