"""Queries do the whole of what their names say."""

import datetime
import itertools
import random

import compare
import pytest

import __spark_entry__  # noqa: F401
from tidewater.operators import catalogue, preferences, strips
from tidewater.plans.registry import QUERIES, SQL

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rated(spark, tmp_path):
    """A folder with events of 40 users, some of whom share no item, and the summed ratings."""
    draw = random.Random(5)
    rows = [(n, DAY, u, "view", float(draw.randrange(0, 125)), '{"k":%d}' % (i + 50 * (u > 30))) for n, (u, i) in enumerate((u, i) for u in range(40) for i in range(12) if draw.random() < 0.4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    own = {}
    for _, _, u, _, value, props in rows:
        i = int(props[5:-1])
        own.setdefault(("user", u), {})[i] = own.setdefault(("item", i), {})[u] = min(5.0, 1 + value // 25)
    return str(tmp_path), own


def cosine(x, y, common):
    both = x.keys() & y.keys()
    length = lambda v: sum(r * r for k, r in v.items() if k in both or not common) ** 0.5
    return sum(x[k] * y[k] for k in both) / length(x) / length(y) if both else 0.0


def test_cosine_matrix_holds_users_and_items_and_every_pair(spark, rated):
    path, own = rated
    got = {(r.side, r.a, r.b): (r.shared, r.similarity) for r in QUERIES["cosine_similarity_matrix"](spark, path).collect()}
    want = {(s, a, b): (len(x.keys() & y.keys()), cosine(x, y, False)) for ((s, a), x), ((t, b), y) in itertools.combinations(sorted(own.items()), 2) if s == t}
    assert got.keys() == want.keys() and any(n == 0 for n, _ in want.values())
    assert all(got[k][0] == n and abs(got[k][1] - c) < 1e-6 for k, (n, c) in want.items())


def test_similarity_features_of_users_and_of_items(spark, rated):
    path, own = rated
    got = {(r.side, r.id): r for r in QUERIES["pairwise_similarity_features"](spark, path).collect()}
    near = {k: sorted((cosine(x, y, True) for o, y in own.items() if o[0] == k[0] and o != k and x.keys() & y.keys()), reverse=True)[:50] for k, x in own.items()}
    near = {k: v for k, v in near.items() if v}
    assert got.keys() == near.keys() and {s for s, _ in got} == {"user", "item"}
    assert all(abs(got[k].highest - v[0]) < 1e-6 and abs(got[k]["mean"] - sum(v) / len(v)) < 1e-4 and got[k].n == len(v) for k, v in near.items())


@pytest.mark.parametrize("common", [True, False])
@pytest.mark.parametrize("values", [[1.0, 4.0], [0.0, -2.0, 3.5]])
def test_few_entities_of_many_ratings_are_dealt_by_key(spark, monkeypatch, common, values):
    draw = random.Random(2)
    rows = [(e, k, draw.choice(values)) for e in range(9) for k in range(300) if draw.random() < 0.2 or e == k]
    matrix = spark.createDataFrame(rows, "item_id long, user_id long, rating double")
    got = [{(r.a, r.b): (r.shared, round(r.similarity, 9)) for r in strips.pairs(matrix, "item_id", "user_id", common=common).collect()}]
    near = [[tuple(r) for r in strips.nearest(matrix, 3, "item_id", "user_id", common=common, digits=6).orderBy("id", "rank").collect()]]
    monkeypatch.setattr(strips, "ENTRIES", 100)
    assert strips._few(strips.rated(matrix, "item_id", "user_id"))
    got.append({(r.a, r.b): (r.shared, round(r.similarity, 9)) for r in strips.pairs(matrix, "item_id", "user_id", common=common).collect()})
    near.append([tuple(r) for r in strips.nearest(matrix, 3, "item_id", "user_id", common=common, digits=6).orderBy("id", "rank").collect()])
    assert got[0] == got[1] and near[0] == near[1] and len(got[0]) == 36 and len(near[0]) == 27


def test_metadata_pairs_scale_numbers_and_blend_vectors(spark):
    """Every pair of items, with standardised numbers among the attributes and the cosine of the vectors where both have one."""
    draw = random.Random(3)
    rows = [(i, draw.sample("abc", 2) if i % 7 else None, draw.choice("xy"), draw.choice(["p", None]), draw.choice([None, 10, 20, 90]), draw.uniform(1, 9)) for i in range(40)]
    content = spark.createDataFrame(rows, "content_id long, genres array<string>, content_type string, creator string, duration int, popularity_score double")
    vectors = {i: [draw.gauss(0, 1) for _ in range(2 if i == 8 else 3)] for i in range(0, 40, 2)} | {6: [0.0, 0.0, 0.0]}
    asked = content.filter("content_id % 10 = 0").select("content_id")
    got = {(r.query_id, r.item_id): (r.similarity, r.blended) for r in catalogue.metadata_pairs(content, asked, spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()}

    def scaled(c):
        own = [r[c] for r in rows if r[c] is not None]
        mean = sum(own) / len(own)
        return [0.0 if r[c] is None else (r[c] - mean) / (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5 for r in rows]

    flat = [{**dict.fromkeys([("g", g) for g in r[1] or []] + [("t", r[2])] + [("c", r[3])] * (r[3] is not None), 1.0), "d": d, "s": s} for r, d, s in zip(rows, scaled(4), scaled(5), strict=True)]
    assert got.keys() == {(q, i) for q in range(0, 40, 10) for i in range(40) if i != q}
    for (q, i), (s, both) in got.items():
        want = cosine(flat[q], flat[i], False)
        assert abs(s - want) < 1e-9
        x, y = (dict(enumerate(vectors.get(k, []))) for k in (q, i))
        if len(x) == len(y) and any(x.values()) and any(y.values()):
            assert abs(both - 0.7 * cosine(x, y, False) - 0.3 * want) < 1e-9
        else:
            assert both is None


def test_evolution_series_names_the_features_drawn_and_their_change(spark):
    """Places by the mean value, ties by name; a change only where there are two values, told where it is above a tenth."""
    values = {"a": [0.9, 0.8], "b": [0.3, 0.7], "c": [0.5], "d": [0.6, 0.1, 0.4], "e": [0.5, 0.5], "f": [0.1, 0.2], "g": [0.05]}
    rows = [(u, 2 * n, g, v + u / 1000) for u in (1, 2) for g, own in values.items() for n, v in enumerate(own)]
    out = preferences.evolution_series(spark.createDataFrame(rows, "user_id long, period int, genre string, value double")).collect()
    assert sorted((r.user_id, r.period, r.genre, r.value) for r in out) == sorted(rows)
    got = {r.genre: (r.place, r.shown, r.change, r.direction) for r in out}
    assert len({(r.genre, r.place, r.shown, r.change, r.direction) for r in out}) == 7
    assert got["a"] == (1, True, -0.1, "stable") and got["b"] == (2, True, 0.4, "increased") and got["c"] == (3, True, None, None) and got["e"] == (4, True, 0.0, "stable")
    assert got["d"] == (5, True, -0.2, "decreased") and got["f"] == (6, False, 0.1, "stable") and got["g"] == (7, False, None, None)
