"""What shows only on larger tables or odd keys."""

import datetime
import itertools
import math
import random
import time

import compare
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tidewater.operators import catalogue, donors, factors, models, networks, preferences, recommend, serving, strips, users, vectors
from tidewater.plans.registry import QUERIES, SQL

DAY = datetime.datetime(2024, 1, 1)


def shuffled(spark, run):
    """Bytes that a run writes to shuffles."""
    def now():
        time.sleep(1)  # the status store lags behind
        of = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(of.apply(i).totalShuffleWrite() for i in range(of.size()))

    before = now()
    run()
    return now() - before


def test_content_recommend_meets_sets_of_genres(spark):
    """Many items of few sets of genres: the same lists as by all items, and no row a user and item on the way."""
    words = "abcdef"
    draw = random.Random(4)
    items = [(i, draw.sample(words, 1 + i % 2)) for i in range(4_000)]
    seen = [(u, i) for u in range(60) for i in draw.sample(range(40 if u % 2 else 4_000), 20)] + [(99, i) for i in range(3_990)]
    content = spark.createDataFrame(items, "content_id long, genres array<string>")
    own = spark.createDataFrame(seen, "user_id long, item_id long")
    got = {}

    def run():
        for r in serving.content_recommend(own, content, n=2, factor=0.0).collect():
            got.setdefault(r.user_id, []).append((r["rank"], r.item_id))

    assert shuffled(spark, run) < 1_500_000
    for u in {u for u, _ in seen}:
        mine = {i for v, i in seen if v == u}
        w = {g: sum(g in items[i][1] for i in mine) for g in words}
        norm = sum(x * x for x in w.values()) ** 0.5
        rest = sorted((-round(sum(w[g] for g in gs) / norm / len(gs) ** 0.5, 9), i) for i, gs in items if i not in mine and any(w[g] for g in gs))
        assert sorted(got[u]) == [(k + 1, i) for k, (_, i) in enumerate(rest[:2])]


def test_halves_do_not_depend_on_the_order_of_equal_lines(spark):
    """Two lines of one order, number and time lie on both sides of the middle."""
    lines = [(1, i, float(r), DAY, 7, 1) for i, r in ((1, 5), (2, 1))]
    items = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "content_id long, genres array<string>")
    for rows in itertools.permutations([*lines, (1, 1, 5.0, DAY - datetime.timedelta(1), 6, 1), (1, 2, 1.0, DAY + datetime.timedelta(1), 8, 1)]):
        df = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts timestamp, l_orderkey long, l_linenumber int").coalesce(1)
        assert abs(preferences.genre_drift(df, items).first().js - 0.6931471805599453) < 1e-12
        order = ["ts", "l_orderkey", "l_linenumber", "item_id", "rating"]
        assert preferences.rating_drift(df, order).first().ks == 1.0


def test_short_and_long_series_have_the_same_lines(spark):
    """Fitted whole in a task or pass by pass; no stage holds the joins of several passes."""
    draw = random.Random(5)
    rows = [(k, DAY + datetime.timedelta(hours=t), draw.gauss(0, 1) + k * t / 50 + 20 * (t % 9 == 0)) for k in range(40) for t in range(10 + k)] + [(99, DAY, 1.0)] * 12
    df = spark.createDataFrame(rows, "key long, ts timestamp, value double")
    until = F.lit("2024-01-20").cast("timestamp")
    whole, passes = ({r.key: r for r in models.robust_trend(df, ["key"], until, passes=5, longest=n).collect()} for n in (100, 5))
    assert len(whole) == 41 and whole.keys() == passes.keys()
    for k, r in whole.items():
        assert r.n == passes[k].n and abs(r.slope - passes[k].slope) < 1e-9 and abs(r.intercept - passes[k].intercept) < 1e-8
    plan = models.robust_trend(df, ["key"], until)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 0 and plan.count("SortMergeJoin") <= 2


def test_constant_values_have_no_trend_in_either_engine(spark, tmp_path):
    """Sums of many equal fractions leave last bits, whose sign is no direction."""
    draw = random.Random(3)
    n, users = 300_000, 20_000  # enough rows for several threads
    order = draw.sample(range(n), n)
    pq.write_table(pa.table({"event_id": range(n), "ts": [DAY + datetime.timedelta(seconds=draw.randrange(2_500_000)) for _ in order], "user_id": [i % users for i in order], "event_type": ["view"] * n, "value": [25.0 * (i % users % 4) for i in order], "props": ['{"k": 1}'] * n}), f"{tmp_path}/events.parquet", row_group_size=20_000)
    assert compare.difference(QUERIES["evolution_state"](spark, str(tmp_path)), compare.views(str(tmp_path)), SQL["evolution_state"]) is None


def test_blocks_give_what_joins_give(spark):
    """Strips of a few entities; ties, users without a shared item and one rating of everything."""
    draw = random.Random(9)
    rows = [(u, i, float(draw.randrange(1, 6))) for u in range(60) for i in range(12) if draw.random() < 0.4 or u == 3] + [(100, 50, 2.0)]
    matrix = spark.createDataFrame(rows + [(u + 200, i, r) for u, i, r in rows if u < 9], "user_id long, item_id long, rating double")
    for common in (True, False):
        joined = users.pairwise_similarity(matrix, common=common)
        want = {(r.a, r.b): (r.shared, round(r.similarity, 9)) for r in joined.collect()}
        got = strips.pairs(matrix, common=common, rows=25)
        assert {(r.a, r.b): (r.shared, round(r.similarity, 9)) for r in got.collect()} == want and got.count() == len(want)
        near = {}
        for (a, b), (_, s) in want.items():
            near.setdefault(a, []).append((-s, b))
            near.setdefault(b, []).append((-s, a))
        first = strips.nearest(matrix, 4, common=common, digits=9, rows=25).collect()
        assert {(r.id, r["rank"]): (r.other, round(r.similarity, 9)) for r in first} == {(u, k + 1): (o, -s) for u, x in near.items() for k, (s, o) in enumerate(sorted(x)[:4])}
    scores = {(r.user_id, r.item_id): r.score for r in recommend.user_based_scores(matrix, users.pairwise_similarity(matrix, common=False)).collect()}
    direct = {(r.user_id, r.item_id): r.score for r in strips.unseen_scores(matrix, entries=40).collect()}
    assert scores.keys() == direct.keys() and all(abs(direct[k] - s) < 1e-9 for k, s in scores.items())


def test_overlap_of_lists(spark):
    """Equal lists, a list of nulls, groups and several strips."""
    draw = random.Random(2)
    lists = {(u % 2, u): frozenset(draw.sample(range(12), 3)) for u in range(40)} | {(1, 50): frozenset([1, 2]), (1, 51): frozenset([1, 2]), (0, 60): frozenset()}
    rows = [(g, u, i) for (g, u), x in lists.items() for i in (x or [None])]
    got = {r.g: r for r in strips.overlap(spark.createDataFrame(rows, "g long, user_id long, item_id long"), "g", rows=7).collect()}
    for g in (0, 1):
        own = [x for (h, _), x in lists.items() if h == g]
        want = sum(len(a & b) / max(1, len(a | b)) for a, b in itertools.combinations(own, 2))
        assert got[g].users == len(own) and abs(got[g].alike - want) < 1e-9


def test_neighbours_in_buckets_by_blocks(spark):
    """The neighbours of the approximate join, with copies and strips of a few rows, and no row a pair on the way."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(1_500)]
    rows += [(2_000 + i, rows[i % 3][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 10 = 0")
    got = {}

    def run():
        for r in catalogue.approx_knn(df, queries, n=4, width=1.0).collect():
            got[r.query_id, r["rank"]] = r.item_id, r.distance

    assert shuffled(spark, run) < 2_000_000
    own = lambda x: x.select("vec_id", array_to_vector("embedding").alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=1.0, numHashTables=5, seed=42).fit(own(df))
    met = {}
    for q, i, d in model.approxSimilarityJoin(own(queries), own(df), float("inf"), "d").selectExpr("datasetA.vec_id", "datasetB.vec_id", "d").collect():
        met.setdefault(q, []).append((d, i))
    assert got == {(q, k + 1): (i, d) for q, x in met.items() for k, (d, i) in enumerate([y for y in sorted(x) if y[1] != q][:4])}
    vectors_ = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.expr("array(floor(embedding[0]))").cast("array<double>").alias("h"))
    small = {tuple(r) for r in vectors.nearest_in_buckets(vectors_, vectors_, 3, rows=97).collect()}
    assert small == {tuple(r) for r in vectors.nearest_in_buckets(vectors_, vectors_, 3).collect()} and len(small) > 4_000


def test_exact_neighbours_by_blocks(spark):
    """Ties go to the smaller id over strips of a few rows; vectors without a direction take no part."""
    draw = random.Random(8)
    rows = [(i, [float(draw.randrange(-2, 3)) for _ in range(4)]) for i in range(200)] + [(300, [0.0] * 4), (301, None), (302, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.item_id, round(r.similarity, 9)) for r in recommend.knn(df, df.filter("vec_id % 5 = 0"), n=6).collect()}
    usable = {i: v for i, v in rows if v and any(v) and v[0] == v[0]}
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9)
    near = {q: sorted((-cosine(v, w), i) for i, w in usable.items() if i != q)[:6] for q, v in usable.items() if q % 5 == 0}
    assert got == {(q, k + 1): (i, -s) for q, x in near.items() for k, (s, i) in enumerate(x)}
    units = df.select(F.col("vec_id").alias("id"), networks.unit(F.col("embedding")).alias("v")).filter("v is not null")
    small = {(r.id, r["rank"]): r.other for r in vectors.nearest(units.filter("id % 5 = 0"), units, 6, rows=17).collect()}
    assert small == {k: i for k, (i, _) in got.items()}


def test_communities_of_copies(spark):
    """Copies vote as often as they occur without a row a pair of them; the same as over all pairs."""
    draw = random.Random(12)
    base = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(30)]
    base += [[x + draw.gauss(0, 0.4) for x in b] for b in base]
    rows = [(7 * k % 641, base[k % 60]) for k in range(300)] + [(700 + k, base[0]) for k in range(500)] + [(2_000, None), (2_001, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    assert shuffled(spark, lambda: got.update({r.id: (r.community, r.degree) for r in networks.vector_communities(df, "id", "v", rounds=3).collect()})) < 1_000_000
    want = networks.communities(df.select("id"), networks.similar_edges(df, "id", "v"), rounds=3)
    assert got == {r.id: (r.community, r.degree) for r in want.collect()} and got[2_000] == (2_000, 0) and len({c for c, _ in got.values()}) > 5


def test_metadata_similarity_of_classes(spark):
    """Members of the classes and their pairs give what all pairs of items give; copies add no pairs."""
    draw = random.Random(1)
    rows = [(i, draw.sample("abcd", 2), draw.choice("xy"), draw.choice("pq")) for i in range(200)] + [(900, ["z", "z"], "v", "w")]
    content = spark.createDataFrame(rows, "content_id long, genres array<string>, content_type string, creator string")
    out = catalogue.metadata_similarity(content, content.filter("content_id % 50 = 0").select("content_id")).collect()
    of = {r.content_id: r.class_id for r in out if r.content_id is not None}
    pairs = {(r.class_id, r.other): round(r.similarity, 9) for r in out if r.content_id is None}
    keys = {i: {*g, "type:" + t, "by:" + c} for i, g, t, c in rows}
    assert of.keys() == keys.keys() and all(of[i] == min(j for j in keys if keys[j] == k) for i, k in keys.items())
    want = {(q, i): round(len(keys[q] & k) / (len(keys[q]) * len(k)) ** 0.5, 9) for q in keys if q % 50 == 0 for i, k in keys.items() if i != q and keys[q] & k}
    assert {(q, i): pairs[of[q], of[i]] for q in keys if q % 50 == 0 for i in keys if i != q and (of[q], of[i]) in pairs} == want
    assert len(out) < 201 + 5 * 26


def test_gaps_ask_only_the_cells_that_a_bound_reaches(spark):
    """Coordinates along a line with a few far off: as by all donors, and no row an empty cell or a pair."""
    draw = random.Random(8)
    data = [(i, None if i % 3 == 0 else draw.random(), *(t + draw.gauss(0, 1) for _ in range(3))) for i in range(4_000) for t in [draw.expovariate(0.05)]]
    data = [(i, y, a, b, None if i % 4 == 1 else c) for i, y, a, b, c in data] + [(5_000 + i, None, -900.0, 900.0 + i, 0.0) for i in range(400)]
    df = spark.createDataFrame(data, "id long, y double, a double, b double, c double")
    got = {}
    assert shuffled(spark, lambda: got.update((r.id, r) for r in donors.impute_knn(df, "id", "y", ["a", "b", "c"], rows=2).collect())) < 8_500_000
    known = [r for r in data if r[1] is not None]
    for i, y, *x in data:
        if y is None and i % 20 == 0:
            near = []
            for j, z, *w in known:
                both = [(p - q) ** 2 for p, q in zip(x, w) if p is not None and q is not None]
                near.append(((sum(both) * 3 / len(both)) ** 0.5, j, z))
            assert abs(got[i].y - sum(z for _, _, z in sorted(near)[:5]) / 5) < 1e-9 and got[i].donors == 5


def test_domain_similarity_of_kinds(spark):
    """Many items of few names and years, some with vectors: the same lists as by all pairs, and no pair of items without a vector on the way."""
    draw = random.Random(6)
    words = ["red bolt", "hot ring", "red ring", "old plate", "the"]
    items = [(i, w, w.split(), draw.choice([1970, 1990, 2001, 2031]), draw.choice([[1.0, 0.0], [0.6, 0.8], [1.0], [0.0, 0.0]]) if i % 10 == 3 else None) for i in range(600) for w in [draw.choice(words)]]
    meta = {"warm": ["red", "hot"], "round": ["ring", "bolt"]}
    df = spark.createDataFrame(items, "content_id long, title string, genres array<string>, year int, embedding array<double>")
    got = {}

    def run():
        for r in catalogue.domain_similarity(df.filter("content_id % 2 = 0 or content_id % 20 = 3"), df.filter("content_id % 2 = 1"), meta).collect():
            got.setdefault(r.a, []).append((r["rank"], r.b, r.similarity))

    assert shuffled(spark, run) < 400_000

    def overlap(x, y):
        return len(x & y) / len(x | y) if x | y else 0.0

    def parts(i):
        _, title, genres, year, v = items[i]
        n = sum(x * x for x in v) ** 0.5 if v else 0
        return {m for m, w in meta.items() if {*w} & {*genres}}, {*title.split()} - {"the"}, year or None, [x / n for x in v] if n else None

    for a in [i for i in range(600) if i % 2 == 0 or i % 20 == 3]:
        ga, ta, ya, va = parts(a)
        near = []
        for b in range(1, 600, 2):
            gb, tb, yb, vb = parts(b)
            if not (ga & gb or ta & tb):
                continue
            s, w = 0.3 * overlap(ga, gb) + 0.2 * overlap(ta, tb), 0.5
            if ya and yb:
                s, w = s + 0.1 * max(0, 1 - abs(ya - yb) / 50), 0.6
            if va and vb and len(va) == len(vb):
                s, w = s + 0.4 * sum(x * y for x, y in zip(va, vb, strict=True)), w + 0.4
            if round(s / w, 9) > 0.4:
                near.append((-round(s / w, 9), b))
        assert [(k, b) for k, b, _ in sorted(got.get(a, []))] == [(k + 1, b) for k, (_, b) in enumerate(sorted(near)[:3])], a


def test_snapshots_are_dealt_by_user_to_tasks_of_bounded_rows(spark, monkeypatch):
    """Well-packed rows are not merged into few tasks, and consecutive snapshots are met without a join."""
    monkeypatch.setattr(preferences, "ROWS", 50, raising=False)
    lines = [(u, i, float(1 + (u + i) % 5), DAY + datetime.timedelta(days=100 * i)) for u in range(40) for i in range(5) if (u + i) % 7]
    items = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a", "c"]) for i in range(5)], "content_id long, genres array<string>")
    snaps = preferences.snapshots(spark.createDataFrame(lines, "user_id long, item_id long, rating double, ts timestamp"), items)
    for df in (snaps, preferences.stability(snaps), preferences.changes(snaps)):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    own = {}
    for u, i, r, ts in lines:
        first = min(t for v, _, _, t in lines if v == u)
        for g in ("a", "b" if i % 2 else "c"):
            own.setdefault(u, {}).setdefault((ts - first).days // 90, {}).setdefault(g, []).append(r / 5)
    got = {r.user_id: r.stability for r in preferences.stability(snaps).collect()}
    for u, periods in own.items():
        means = [{g: sum(v) / len(v) for g, v in x.items()} for _, x in sorted(periods.items())]
        length = lambda x: sum(v * v for v in x.values()) ** 0.5
        want = [sum(v * y.get(g, 0.0) for g, v in x.items()) / length(x) / length(y) for x, y in itertools.pairwise(means)]
        assert abs(got[u] - sum(want) / len(want)) < 1e-9


def test_density_clusters_make_no_rows_of_pairs(spark):
    """Groups clustered whole in tasks and as links of cells give the same; equal points of small groups are not joined with each other."""
    draw = random.Random(12)
    rows = [(g, 1000 * g + k, [draw.randrange(5) / 5, draw.randrange(5) / 5]) for g in range(6) for k in range(12 + 20 * g)]
    rows += [(None, 7001, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "user_id int, point bigint, features array<double>")
    whole, cells, both = ({r.point: (r.core, r.cluster) for r in networks.density_clusters(df, ["user_id"], eps=0.21, least=4, longest=n).collect()} for n in (1_000, 1, 50))
    assert whole == cells == both and len(set(whole.values())) > 2
    equal = spark.range(3_000).selectExpr("cast(id % 5 as int) user_id", "id point", "array(0.2D, 0.4D) features")
    assert shuffled(spark, lambda: networks.density_clusters(equal, ["user_id"]).count()) < 1_000_000


def test_factor_steps_copy_no_factors_to_rows(spark, monkeypatch):
    """Blocks of few profiles and slices of few rows give what one block gives; rows do not carry factors through shuffles."""
    draw = random.Random(14)
    triples = spark.createDataFrame([(draw.randrange(300), draw.randrange(20), draw.randrange(20, 40)) for _ in range(20_000)], "user_id long, item_id long, other long")
    users = spark.range(300).select(F.col("id").alias("user_id"), factors.start_factors(F.col("id"), 50, "u").alias("factors")).cache()
    items = spark.range(40).select(F.col("id").alias("item_id"), F.lit(0.1).alias("bias"), factors.start_factors(F.col("id"), 50, "i").alias("factors")).cache()
    assert list(users.first().factors) == list(users.select(F.array(*[factors.start_factor(F.col("user_id"), k, "u") for k in range(3)])).first()[0]) + list(users.first().factors)[3:]
    got = []

    def run():
        u, i = factors.bpr_step(users, items, triples, 50, 0.1, 0.01)
        got.append({("u", r.user_id): list(r.factors) for r in u.collect()} | {("i", r.item_id): [r.bias, *r.factors] for r in i.collect()})

    assert shuffled(spark, run) < 5_000_000
    monkeypatch.setattr(factors, "BLOCK", 60)
    monkeypatch.setattr(factors, "ROWS", 900)
    run()
    assert got[0].keys() == got[1].keys() and all(abs(x - y) < 1e-12 for k in got[0] for x, y in zip(got[0][k], got[1][k], strict=True))


def test_profile_vectors_are_summed_where_their_block_is(spark):
    """One block or many, repeated, short and partly null vectors; no row a dimension and event is shuffled."""
    draw = random.Random(15)
    vecs = [(i, [float(draw.randint(-4, 4)) for _ in range(8)]) for i in range(30)] + [(3, [1.0] * 8), (30, [2.0, None, 1.0]), (31, None), (32, [None, None])]
    seen = [(u, draw.randrange(34)) for u in range(20) for _ in range(6)] + [(50, 32), (51, 30), (None, 1), (1, None)]
    vectors = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    own = spark.createDataFrame(seen, "user_id long, item_id long")
    want = {}
    for u, i in sorted({x for x in seen if None not in x}):
        for k, x in [(k, x) for v, e in vecs if v == i and e for k, x in enumerate(e)]:
            want.setdefault(u, {}).setdefault(k, []).append(x)
    mean = {u: {k: (sum(y) / len(y) if (y := [x for x in xs if x is not None]) else None) for k, xs in d.items()} for u, d in want.items()}
    for block, share in ((4_096, 200_000), (4, 5)):
        got = {(r.user_id, r.pos): r.value for r in recommend.profile_embedding(own, vectors, block, share).collect()}
        assert got.keys() == {(u, k) for u, d in mean.items() for k in d}
        for u, d in mean.items():
            norm = sum(x * x for x in d.values() if x is not None) ** 0.5
            assert all((got[u, k] or 0.0) == (0.0 if x is None or not norm else pytest.approx(x / norm)) for k, x in d.items())
    many = spark.range(60_000).selectExpr("id % 3000 user_id", "cast(id / 3000 as long) item_id")
    wide = spark.createDataFrame([(i, [draw.random() for _ in range(64)]) for i in range(100)], "vec_id long, embedding array<double>")
    assert shuffled(spark, lambda: recommend.profile_embedding(many, wide).count()) < 4_000_000


def test_items_with_vectors_make_no_rows_of_pairs(spark):
    """All items have vectors: the lists of plain Python, some years and words missing, and a shuffle that no pair of items passes."""
    draw = random.Random(12)
    words = ["red bolt", "hot ring", "red ring", "old plate", "cold plate", "", "the"]
    items = [(i, w, w.split(), draw.choice([1970, 1990, 2001, None]), [draw.gauss(0, 1) for _ in range(4 if i % 50 else 2)]) for i in range(1_600) for w in [draw.choice(words)]]
    meta = {"warm": ["red", "hot"], "round": ["ring", "bolt"]}
    df = spark.createDataFrame(items, "content_id long, title string, genres array<string>, year int, embedding array<double>")
    got = {}

    def run():
        for r in catalogue.domain_similarity(df.filter("content_id % 2 = 0"), df.filter("content_id % 2 = 1"), meta).collect():
            got.setdefault(r.a, []).append((r["rank"], r.b, round(r.similarity, 6)))

    assert shuffled(spark, run) < 1_500_000
    overlap = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    own = [({m for m, w in meta.items() if {*w} & {*g}}, {*t.split()} - {"the"}, y, [x / sum(x * x for x in v) ** 0.5 for x in v]) for _, t, g, y, v in items]
    for a in range(0, 1_600, 40):
        near = []
        for b in range(1, 1_600, 2):
            (ga, ta, ya, va), (gb, tb, yb, vb) = own[a], own[b]
            if ga & gb or ta & tb:
                s = 0.3 * overlap(ga, gb) + 0.2 * overlap(ta, tb) + (0.1 * max(0, 1 - abs(ya - yb) / 50) if ya and yb else 0.0)
                s = s + 0.4 * sum(x * y for x, y in zip(va, vb, strict=True)) if len(va) == len(vb) else s / 0.6
                if round(s, 9) > 0.4:
                    near.append((-round(s, 9), b, round(s, 6)))
        assert sorted(got.get(a, [])) == [(k + 1, b, s) for k, (_, b, s) in enumerate(sorted(near)[:3])], a


def test_receivers_of_wide_cells_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    """No task gets many more receivers than a pack holds, and the answers are those of all donors."""
    draw = random.Random(15)
    data = [(i, None if i % 2 else draw.random(), draw.gauss(0, 1), draw.gauss(0, 1)) for i in range(6_000)]
    monkeypatch.setattr(donors, "PACK", 500)
    for name in ("_bounds", "_nearest"):
        def bounded(features, k, of=getattr(donors, name)):
            own = of(features, k)

            def run(asked, stored):
                assert asked.num_rows < 700
                return own(asked, stored)

            return run

        monkeypatch.setattr(donors, name, bounded)
    got = {r.id: r.y for r in donors.impute_knn(spark.createDataFrame(data, "id long, y double, a double, b double"), "id", "y", ["a", "b"]).collect()}
    assert len(got) == 6_000
    for i, _, a, b in data[1:400:2]:
        near = sorted(((a - p) ** 2 + (b - q) ** 2, y) for _, y, p, q in data if y is not None)[:5]
        assert abs(got[i] - sum(y for _, y in near) / 5) < 1e-9


@pytest.mark.parametrize(("unit", "width"), [(1.0, 4), (0.1, 8), (2000.0, 8)])
def test_sums_are_as_narrow_as_they_are_exact(spark, monkeypatch, unit, width):
    """Whole numbers that single precision holds are summed in it, others in double; what is chosen is measured in double."""
    draw = random.Random(21)
    rows = [(u, i, unit * draw.choice([1, 2, 3, 5])) for u in range(80) for i in range(15) if draw.random() < 0.6]
    own = strips._quotient

    def checked(dot, xx, yy, shared, room):
        assert dot.dtype.itemsize == width
        return own(dot, xx, yy, shared, room)

    monkeypatch.setattr(strips, "_quotient", checked)
    of = {}
    for u, i, r in rows:
        of.setdefault(u, {})[i] = r
    got = {}
    for r in strips.nearest(spark.createDataFrame(rows, "user_id long, item_id long, rating double"), 7, common=True, digits=9, rows=30).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, round(r.similarity, 9)))
    for u, x in of.items():
        near = []
        for v, y in of.items():
            both = x.keys() & y.keys()
            if u != v and both:
                near.append((-round(sum(x[k] * y[k] for k in both) / (sum(x[k] ** 2 for k in both) * sum(y[k] ** 2 for k in both)) ** 0.5, 9), v))
        want = [(k + 1, v, -s) for k, (s, v) in enumerate(sorted(near)[:7])]
        assert [s for _, _, s in sorted(got[u])] == pytest.approx([s for _, _, s in want], abs=2e-9)
        assert unit != 1.0 or sorted(got[u]) == want


def test_users_meet_only_the_raters_of_what_they_ask_for(spark, monkeypatch):
    """Few rated an asked item, so few are compared; lists of several items, some asked by nobody's neighbour."""
    draw = random.Random(22)
    rows = [(u, i, float(draw.choice([1, 2, 3, 5]))) for u in range(300) for i in [*range(12)] if draw.random() < 0.5] + [(u, 50 + u % 3, 4.0) for u in range(0, 300, 10)] + [(7, 99, 1.0)]
    asked = [(u, i) for u in range(300) for i in draw.sample([50, 51, 52, 99], 2)]
    own = strips._sums

    def checked(a, b, common, count=True):
        assert len(b[0]) <= 31
        return own(a, b, common, count)

    monkeypatch.setattr(strips, "_sums", checked)
    spark_rows = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    got = {}
    for r in strips.nearest_raters(spark.createDataFrame(asked, "user_id long, item_id long"), spark_rows, 3).collect():
        got.setdefault((r.user_id, r.item_id), []).append((r["rank"], r.neighbour, r.similarity))
    of, raters = {}, {}
    for u, i, r in rows:
        of.setdefault(u, {})[i] = r
        raters.setdefault(i, []).append(u)
    for u, item in asked:
        near = []
        for v in raters[item]:
            x, y = of.get(u, {}), of[v]
            both = x.keys() & y.keys()
            if u != v and both:
                near.append((-round(sum(x[k] * y[k] for k in both) / (sum(x[k] ** 2 for k in both) * sum(y[k] ** 2 for k in both)) ** 0.5, 9), v))
        assert sorted(got.get((u, item), [])) == [(k + 1, v, -s) for k, (s, v) in enumerate(sorted(near)[:3])]
