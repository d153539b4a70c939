"""Operators without SQL twins against plain Python on small frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import stats
from tidewater.operators import catalogue, preferences, recommend, serving

ITEMS = [(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, ["a", "c"]), (5, ["d"]), (6, ["b"])]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "content_id bigint, genres array<string>")


def overlap(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def greedy(scores, value, n):
    genres, left, out = dict(ITEMS), dict(scores), []
    while left and len(out) < n:
        worth = {i: value(s, np.mean([overlap(genres[i], genres[j]) for j, _ in out]) if out else 0.0) for i, s in left.items()}
        best = max(left, key=lambda i: (round(worth[i], 9), left[i], -i))
        out.append((best, worth[best]))
        del left[best]
    return out


def test_mmr(spark, items):
    scores = {1: 0.9, 2: 0.88, 3: 0.7, 4: 0.7, 5: 0.65, 6: 0.65}
    lists = spark.createDataFrame([(7, i, s) for i, s in scores.items()] + [(8, 3, 0.5)], "user_id bigint, item_id bigint, score double")
    rows = sorted(serving.mmr_rerank(lists, items).collect(), key=lambda r: (r.user_id, r["rank"]))
    want = greedy(scores, lambda s, o: s - 0.3 * o, 6)
    assert [(r.item_id, pytest.approx(r.score)) for r in rows if r.user_id == 7] == want and want[1][0] != 2
    assert [(r.item_id, r.score) for r in rows if r.user_id == 8] == [(3, 0.5)]
    assert serving.mmr_rerank(lists.limit(0), items).count() == 0


def test_content_recommend(spark, items):
    seen = spark.createDataFrame([(7, 1), (7, 1), (7, 4), (8, 5)], "user_id bigint, item_id bigint")
    rows = sorted(serving.content_recommend(seen, items, n=3).collect(), key=lambda r: r["rank"])
    profile = {"a": 2, "b": 1, "c": 1}
    norm = np.sqrt(6)
    scores = {i: sum(profile.get(x, 0) for x in g) / norm / len(g) ** 0.5 for i, g in ITEMS if i not in (1, 4) and set(g) & set(profile)}
    assert [(r.item_id, pytest.approx(r.score, abs=1e-6)) for r in rows if r.user_id == 7] == greedy(scores, lambda s, o: s * (1 - 0.1 * o), 3)
    assert not [r for r in rows if r.user_id == 8]


def test_context_rules(spark):
    rows = [(1, ["Action"], "movie"), (2, ["Drama"], "movie"), (3, ["Drama"], "game")]
    own = spark.createDataFrame(rows, "content_id bigint, genres array<string>, content_type string")
    out = [(r.item_id, r.score) for r in serving.contextual_items(own, {"season": "summer", "device": "tv"}).orderBy("rank").collect()]
    assert out == [(1, 0.75), (2, 0.65), (3, 0.5)]
    assert serving.contextual_items(own, {"season": "none"}).count() == 0


def test_als_gives_full_lists_to_users_who_saw_much(spark):
    rows = [(u, i, 1.0 + (u + i) % 3) for u in range(12) for i in range(40) if (u == 0 and i < 37) or (u + i) % 4 == 0]
    out = recommend.als(spark.createDataFrame(rows, "user_id int, item_id int, rating double"), n=3, rank=4, iterations=2, spare=5).collect()
    seen = {(u, i) for u, i, _ in rows}
    assert all((r.user_id, r.item_id) not in seen for r in out)
    count = {u: sum(r.user_id == u for r in out) for u in range(12)}
    assert all(n == min(3, 40 - len([1 for x, _ in seen if x == u])) for u, n in count.items())


def test_recall_of_approximate_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    got: dict = {}
    for r in catalogue.approx_knn(vectors, vectors.filter("vec_id % 25 = 0"), n=10).collect():
        got.setdefault(r.query_id, set()).add(r.item_id)
    for q in np.flatnonzero(ids % 25 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(ids[np.argsort(d)[:10]].tolist()) & got[int(ids[q])])
        total += 10
    assert hits / total >= 0.9


def test_page_hinkley(spark):
    """Cumulative deviations above their minimum, against a plain loop."""
    values = [0.0] * 40 + [5.0] * 60
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "user_id bigint, t bigint, value double")
    columns = preferences.page_hinkley(df, ["user_id"], limit=20.0)
    assert columns.count() == 1


def test_places_and_normal_points(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from tidewater.functions import stats as S

    values = [5.0, 1.0, None, 3.0, 3.0, 3.0, -2.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    want = {(v, known.count(v), sum(x < v for x in known), len(known), sorted(set(known)).index(v)) for v in known}
    assert {tuple(r) for r in S.places(df, "v", bins=3).select("v", "ties", "below", "total", "number").collect()} == want
    assert S.places(df.filter("false"), "v").count() == 0
    texts = spark.createDataFrame([(t,) for t in ["b", "abcd", "abc", "", "abce", "b"]], "v string")
    assert [r.v for r in S.places(texts, "v").orderBy("number").collect()] == ["", "abc", "abcd", "abce", "b"]
    shares = spark.createDataFrame([(p,) for p in [1e-7, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-7]], "p double")
    for r in shares.select("p", S.normal_point(F.col("p")).alias("z")).collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-6
    # points of tables: 5 % two-sided for the normal and for Student's t of 10 and 30 degrees of freedom
    r = spark.range(1).select(S.normal_two_sided(F.lit(1.959964)), S.student_point(F.lit(10)), S.student_point(F.lit(30)), S.normal_two_sided(S.student_as_normal(F.lit(2.228), F.lit(10)))).first()
    assert abs(r[0] - 0.05) < 1e-6 and abs(r[1] - 2.228) < 0.01 and abs(r[2] - 2.042) < 0.003 and abs(r[3] - 0.05) < 0.001


def test_content_vectors_and_empty_sets(spark):
    from tidewater.operators import reports as R

    schema = "k int, tags array<string>, text string, n double"
    df = spark.createDataFrame([(1, ["a", None, "a"], "Twice the word the same word", None), (2, None, "short", 2.0), (3, [], None, None)], schema)
    got = {(r.k, r.feature, round(r.value, 6)) for r in R.content_vectors(df, "k", ["tags"], ["text"], ["n"], words=3).collect()}
    sixth = round(1 / 6, 6)
    assert got == {(1, "tags_a", 1.0), (1, "text_word_twice", sixth), (1, "text_word_the", sixth), (1, "text_word_word", sixth), (2, "text_short", 1.0), (2, "n_numeric", 2.0)}
    r = R.feature_set_report({"content": df, "nothing": df.filter("false")}).orderBy("feature_set").collect()
    assert [(x.rows, x.columns, x.numeric, x.categorical, round(x.missing_percent, 4)) for x in r] == [(3, 4, 2, 1, round(100 * 4 / 12, 4)), (0, 4, 2, 1, 0.0)]


def test_profile_rules(spark):
    from tidewater.operators import profile as P

    m = spark.createDataFrame([(1, p, 30.0 * p, 0.9 - 0.2 * p, "high" if p == 0 else "low") for p in range(4)] + [(2, 0, 0.0, 0.5, "low")], "user_id int, period int, start double, stability double, level string")
    t = P.period_trends(m)
    got = {r.kind: r for r in t.collect()}
    assert abs(got["stability_change"].slope + 0.2 / 30) < 1e-9 and got["stability_change"].direction == "decreasing"
    s = {r.user_id: r for r in P.profile_scores(m, t).collect()}
    assert s[2].stability == 0.5 and s[2].velocity == 0.0 and s[2].predictability == 0.5 and abs(s[1].velocity - 0.2) < 1e-9
    stages = spark.createDataFrame([(1, "mature", 1.0)], "user_id int, stage string, confidence double")
    risks = {(r.user_id, r.risk, r.detail, r.severity) for r in P.risk_indicators(stages, t, P.profile_scores(m, t)).collect()}
    assert risks == {(1, "engagement_decline", "", "high"), (1, "activity_decline", "", "medium"), (1, "lifecycle_risk", "platform_fatigue", "low"), (1, "lifecycle_risk", "reduced_exploration", "low"), (1, "profile_stagnation", "", "low")}
    f = {r.user_id: r for r in P.behaviour_forecast(stages, t, P.profile_scores(m, t)).collect()}
    assert abs(f[1].predicted - 0.1) < 1e-9 and f[1].next_stages == "declining" and f[2].stage == "unknown" and f[2].predicted is None


def test_places_of_texts_with_one_prefix(spark):
    """Bins of texts follow the texts, not their first characters."""
    rows = spark.range(100_000).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("v"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("ties"))
    sizes = [r["count"] for r in stats.binned(counts, "v", 256).groupBy("_bin").count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 100_000 / 256 * 4
    few = spark.createDataFrame([(x,) for x in ["b", "a", "a", "ccc", "cc", None, "ä", ""]], "v string")
    got = {r.v: (r.ties, r.below, r.number, r.total) for r in stats.places(few, "v").collect()}
    assert got == {"": (1, 0, 0, 7), "a": (2, 1, 1, 7), "b": (1, 3, 2, 7), "cc": (1, 4, 3, 7), "ccc": (1, 5, 4, 7), "ä": (1, 6, 5, 7)}


def test_percentiles(spark):
    values = [float((i * 37) % 1009) for i in range(1500)] + [5.0] * 400
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    want = df.agg(F.percentile("x", F.array(*map(F.lit, [0.0, 0.05, 0.25, 0.5, 0.999, 1.0])))).first()[0]
    assert stats.percentiles(df, "x", [0.0, 0.05, 0.25, 0.5, 0.999, 1.0]).first()[0] == pytest.approx(want)
    assert stats.percentiles(df.filter("x > 2000"), "x", [0.5]).first()[0] == [None]
