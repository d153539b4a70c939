"""Operators that learn, cluster or search, against plain Python."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewater.operators import donors, factors, isolation, models, networks
from tidewater.streaming import events as S

DAY = datetime.datetime(2024, 1, 1)


# --- mini-batches

def plain_steps(batches, rates, starts):
    """Profiles after each batch, row by row, with sums taken at its end."""
    users, items = {}, {}

    def known(profiles, key, side):
        return profiles.setdefault(key, {"bias": 0.0, "f": list(starts[side][key]), "n": 0, "updated": None})

    for batch in batches:
        sums = {}
        for u, i, rating, ts in batch:
            if u is None or i is None or rating is None:
                continue
            p, q = known(users, u, "user"), known(items, i, "item")
            guess = min(5.0, max(0.0, rates.base + p["bias"] + q["bias"] + sum(x * y for x, y in zip(p["f"], q["f"], strict=True))))
            decay = 1.0
            if p["updated"] is not None and ts is not None:
                decay = min(1.0, max(rates.least, rates.forgetting ** ((ts - p["updated"]).total_seconds() / 3600)))
            rate = rates.rate * decay
            for side, key, other in (("user", u, q["f"]), ("item", i, p["f"])):
                s = sums.setdefault((side, key), {"rates": 0.0, "pulls": 0.0, "moves": [0.0] * rates.rank, "n": 0, "last": None})
                s["rates"] += rate
                s["pulls"] += rate * (rating - guess)
                s["moves"] = [m + rate * (rating - guess) * o for m, o in zip(s["moves"], other, strict=True)]
                s["n"] += 1
                s["last"] = max((t for t in (s["last"], ts) if t), default=None)
        for (side, key), s in sums.items():
            x = (users if side == "user" else items)[key]
            shrink = rates.penalty * s["rates"]
            x["bias"] += s["pulls"] - shrink * x["bias"]
            x["f"] = [f + m - shrink * f for f, m in zip(x["f"], s["moves"], strict=True)]
            x["n"] += s["n"]
            x["updated"] = max((t for t in (x["updated"], s["last"]) if t), default=None)
    return users, items


def test_stream_of_minibatches(spark, tmp_path):
    draw = random.Random(1)
    rates = factors.Rates(rate=0.05, rank=4)
    schema = "user_id bigint, item_id bigint, rating double, ts timestamp"
    batches = [[(draw.randint(1, 6), draw.choice([1, 1, 1, 2, 3]), float(draw.randint(1, 5)), DAY + datetime.timedelta(hours=40 * b + draw.randint(0, 30))) for _ in range(25)] for b in range(3)]
    batches[1] += [(None, 1, 3.0, DAY), (1, None, 3.0, DAY), (1, 1, None, DAY), (2, 1, 4.0, None)]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = S.source(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema)
    users, items, last = factors.learn_stream(stream, f"{tmp_path}/state", f"{tmp_path}/check", rates, whole=2)
    assert last == 3
    ids = spark.range(1, 7).select(F.col("id"), *[F.array(*[factors.start_factor(F.col("id"), k, f"{s}_id") for k in range(4)]).alias(s) for s in ("user", "item")]).collect()
    starts = {s: {r["id"]: r[s] for r in ids} for s in ("user", "item")}
    order = [sorted({f for f in (tmp_path / "in").iterdir()}).index(f) for f in sorted((tmp_path / "in").iterdir(), key=lambda f: f.stat().st_mtime)]
    want = plain_steps([batches[i] for i in order], rates, starts)
    for table, plain, key in ((users, want[0], "user_id"), (items, want[1], "item_id")):
        got = {r[key]: r for r in table.at(last).collect()}
        assert got.keys() == plain.keys()
        for k, x in plain.items():
            assert got[k].bias == pytest.approx(x["bias"], abs=1e-12) and list(got[k].factors) == pytest.approx(x["f"], abs=1e-12)
            assert got[k].n == x["n"] and got[k].updated == x["updated"]
    # the last batch once more, as after a failure
    before = sorted(map(tuple, users.at(last).collect()))
    u, i = factors.minibatch_step(users.at(2), items.at(2), spark.createDataFrame(batches[order[2]], schema), rates)
    users.put(3, u)
    assert [(r[0], r[3]) for r in sorted(map(tuple, users.at(3).collect()))] == [(r[0], r[3]) for r in before]
    assert users.at(0).count() == 0


# --- pairwise ranking

def test_one_epoch_of_pairs(spark):
    users = spark.createDataFrame([(1, [0.1, 0.2]), (2, [-0.3, 0.4]), (3, [0.0, 1.0])], "user_id bigint, factors array<double>")
    items = spark.createDataFrame([(1, 0.5, [0.2, 0.1]), (2, 0.0, [-0.1, 0.3]), (3, -0.2, [0.4, -0.4]), (4, 0.0, [1.0, 1.0])], "item_id bigint, bias double, factors array<double>")
    triples = [(1, 1, 2), (1, 3, 2), (2, 1, 3), (2, 1, 2)]
    rate, penalty = 0.1, 0.01
    got_u, got_i = factors.bpr_step(users, items, spark.createDataFrame(triples, "user_id bigint, item_id bigint, other bigint"), 2, rate, penalty)
    p = {r.user_id: list(r.factors) for r in users.collect()}
    q = {r.item_id: [r.bias, *r.factors] for r in items.collect()}
    du, di = {}, {}
    for u, i, j in triples:
        x = q[i][0] - q[j][0] + sum(p[u][k] * (q[i][k + 1] - q[j][k + 1]) for k in range(2))
        g = 1 / (1 + math.exp(x))
        du.setdefault(u, []).append([g * (q[i][k + 1] - q[j][k + 1]) for k in range(2)])
        di.setdefault(i, []).append([g, g * p[u][0], g * p[u][1]])
        di.setdefault(j, []).append([-g, -g * p[u][0], -g * p[u][1]])
    for r in got_u.collect():
        want = [x + rate * (sum(m[k] for m in du[r.user_id]) / math.sqrt(len(du[r.user_id])) - penalty * x) for k, x in enumerate(p[r.user_id])] if r.user_id in du else p[r.user_id]
        assert list(r.factors) == pytest.approx(want)
    for r in got_i.collect():
        want = [x + rate * (sum(m[k] for m in di[r.item_id]) / math.sqrt(len(di[r.item_id])) - penalty * x) for k, x in enumerate(q[r.item_id])] if r.item_id in di else q[r.item_id]
        assert [r.bias, *r.factors] == pytest.approx(want)


def test_pairs_beat_popularity(spark):
    """Two halves of users that like two halves of the items, one of which is seen more."""
    draw = random.Random(2)
    ever = {(u, draw.randint(0, 19) + (20 if u % 2 else 0)) for u in range(60) for _ in range(30 if u % 2 else 12)}
    pairs = sorted(ever)
    held = {x for k, x in enumerate(pairs) if k % 6 == 0}
    train = spark.createDataFrame([x for x in pairs if x not in held], "user_id bigint, item_id bigint")
    users, items = factors.bpr_train(train, rank=4, epochs=8, rate=0.5)
    both = spark.createDataFrame(pairs, "user_id bigint, item_id bigint")
    drawn = factors.negatives(both, -1).collect()
    assert all((r.user_id, r.other) not in ever and (r.user_id, r.item_id) in ever for r in drawn) and len(drawn) > len(pairs) / 4
    triples = spark.createDataFrame([(u, i, j) for u, i in sorted(held) for j in range(40) if (u, j) not in ever], "user_id bigint, item_id bigint, other bigint")
    auc = factors.bpr_auc(users, items, triples).first().auc
    seen = {}
    for _, i in pairs:
        seen[i] = seen.get(i, 0) + 1
    rows = triples.collect()
    popular = sum(1.0 if seen.get(r.item_id, 0) > seen.get(r.other, 0) else 0.5 * (seen.get(r.item_id, 0) == seen.get(r.other, 0)) for r in rows) / len(rows)
    assert auc > popular + 0.05 and auc > 0.75


# --- gaps

def plain_knn(rows, k):
    """rows: (id, y, coordinates); filled y for missing ones, with the number of donors."""
    known = [(i, y, x) for i, y, x in rows if y is not None]
    mean = sum(y for _, y, _ in known) / len(known)
    out = {}
    for i, y, x in rows:
        if y is not None:
            out[i] = (y, None)
            continue
        near = []
        for j, z, w in known:
            shared = [(a - b) ** 2 for a, b in zip(x, w, strict=True) if a is not None and b is not None]
            if shared:
                near.append((math.sqrt(sum(shared) * len(x) / len(shared)), j, z))
        near = sorted(near)[:k]
        out[i] = (sum(z for _, _, z in near) / len(near), len(near)) if near else (mean, len(known))
    return out


@pytest.mark.parametrize("rows", [4, 64])
def test_impute_knn(spark, rows):
    draw = random.Random(4)
    data = []
    for i in range(500):
        x = [draw.choice([None, 0.0, draw.gauss(0, 1)]), draw.gauss(0, 10), draw.choice([None, float(draw.randint(0, 3))])]
        data.append((i, None if i % 6 == 0 else draw.random(), x))
    data += [(600 + i, 1.0 * i, [0.0, 0.0, 0.0]) for i in range(40)] + [(700 + i, None, [0.0, 0.0, 0.0]) for i in range(40)]
    data += [(800, None, [None, None, None]), (801, float("nan"), [50.0, 90.0, None]), (802, 2.0, [None, None, None])]
    df = spark.createDataFrame([(i, y, *x) for i, y, x in data], "id bigint, y double, a double, b double, c double").withColumn("ask", F.lit(1))
    got = {r.id: r for r in donors.impute_knn(df, "id", "y", ["a", "b", "c"], rows=rows).collect()}
    want = plain_knn([(i, None if y != y else y, x) if y is not None else (i, y, x) for i, y, x in data], 5)
    assert got.keys() == want.keys()
    for i, (y, n) in want.items():
        assert got[i].y == pytest.approx(y, abs=1e-9) and got[i].donors == n, i


def test_impute_knn_without_donors(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "id bigint, y double, a double")
    assert sorted(map(tuple, donors.impute_knn(df, "id", "y", ["a"]).collect())) == [(1, None, 0), (2, None, 0)]
    assert donors.impute_knn(df.limit(0), "id", "y", ["a"]).count() == 0


# --- isolation

def plain_paths(values, x, trees, size, seed):
    """Mean path length of x, walking down trees grown with the same draws."""
    draw, total = random.Random(seed), 0.0
    limit = max(1, math.ceil(math.log2(size)))

    def grow(part, depth):
        low, high = min(part), max(part)
        if depth == limit or low == high:
            return len(part)
        cut = draw.uniform(low, high)
        below, above = [v for v in part if v < cut], [v for v in part if v >= cut]
        if not below or not above:
            return len(part)
        return cut, grow(below, depth + 1), grow(above, depth + 1)

    for _ in range(trees):
        node, depth = grow(draw.sample(values, size), 0), 0
        while isinstance(node, tuple):
            node, depth = node[1 if x < node[0] else 2], depth + 1
        total += depth + isolation.mean_path(node)
    return total / trees


def test_isolation_forest(spark):
    draw = random.Random(6)
    rows = [(i, draw.gauss(0, 1)) for i in range(900)] + [(900 + i, draw.uniform(6, 60)) for i in range(40)] + [(990, None), (991, float("nan"))]
    df = spark.createDataFrame(rows, "id bigint, x double").withColumn("score", F.lit("clash"))
    got = {r.id: r for r in isolation.isolation_forest(df.select("id", "x"), "id", "x", trees=20, sample=64).collect()}
    values = [r.x for r in df.filter("x is not null and not isnan(x)").orderBy(F.xxhash64(F.lit(42), F.col("id").cast("string")), "x").limit(20 * 64).collect()]
    for i in (0, 1, 5, 77, 901, 930, 939):
        want = 2 ** (-plain_paths(values, rows[i][1], 20, 64, 42) / isolation.mean_path(64))
        assert got[i].score == pytest.approx(want, abs=1e-9)
    assert got[990].score is None and not got[990].is_outlier and not got[991].is_outlier
    flagged = [i for i, r in got.items() if r.is_outlier]
    assert 0.07 * 940 <= len(flagged) <= 0.1 * 940 + 1 and sum(i >= 900 for i in flagged) >= 38
    same = isolation.isolation_forest(spark.createDataFrame([(i, 1.0) for i in range(9)], "id bigint, x double"), "id", "x").collect()
    assert not any(r.is_outlier for r in same)
    assert isolation.isolation_forest(df.limit(0), "id", "x").count() == 0


# --- graphs and clusters

def plain_components(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    draw = random.Random(7)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    got = {r.id: r.component for r in networks.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == plain_components(edges)
    assert networks.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_dbscan(points, eps, least):
    """Labels of points in order: clusters are grown from the first core on."""
    near = [[j for j, q in enumerate(points) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= eps * eps] for p in points]
    core, label, n = [len(x) >= least for x in near], [None] * len(points), 0
    for i in range(len(points)):
        if label[i] is None and core[i]:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] is None:
                    label[j] = n
                    if core[j]:
                        todo += [k for k in near[j] if label[k] is None]
            n += 1
    return core, label


def test_density_clusters(spark):
    draw = random.Random(8)
    rows, want = [], {}
    for user in range(4):
        points = [[draw.gauss(draw.choice([0, 1.5, 3]), 0.25), draw.gauss(0, 0.3), draw.choice([0.0, 0.1])] for _ in range(70)]
        core, label = plain_dbscan(points, 0.3, 3)
        for k, p in enumerate(points):
            rows.append((user, 1000 * user + k, p))
            want[1000 * user + k] = (core[k], label[k])
    rows += [(9, 9001, None), (9, 9002, [None, 1.0, 1.0]), (9, 9003, [1.0, 1.0, 1.0])]
    want |= {9001: (False, None), 9002: (False, None), 9003: (False, None)}
    got = {r.point: (r.core, r.cluster) for r in networks.density_clusters(spark.createDataFrame(rows, "user_id int, point bigint, features array<double>"), ["user_id"]).collect()}
    assert got == want and len({c for _, c in want.values()}) > 3


def test_communities(spark):
    draw = random.Random(10)
    edges = sorted({tuple(sorted(draw.sample(range(15 * g, 15 * g + 15), 2))) for g in range(4) for _ in range(40)} | {(3, 20), (40, 50)})
    weighted = [(a, b, draw.choice([0.61, 0.7, 0.9])) for a, b in edges]
    label = {i: i for i in range(70)}
    for _ in range(4):
        votes = {i: {label[i]: 1.0} for i in label}
        for a, b, s in weighted:
            votes[a][label[b]] = votes[a].get(label[b], 0) + s
            votes[b][label[a]] = votes[b].get(label[a], 0) + s
        label = {i: min((-round(s, 9), x) for x, s in v.items())[1] for i, v in votes.items()}
    got = {r.id: r for r in networks.communities(spark.range(70), spark.createDataFrame(weighted, "a bigint, b bigint, similarity double"), rounds=4).collect()}
    assert {i: r.community for i, r in got.items()} == label
    assert got[69].degree == 0 and got[69].community == 69


def test_similar_edges(spark):
    """95 of 100 pairs at the threshold are found, all others are above it; far fewer than all pairs are met."""
    draw = random.Random(11)
    base = [[draw.gauss(0, 1) for _ in range(24)] for _ in range(40)]
    rows = [(10 * g + k, [x + draw.gauss(0, 0.7) for x in b]) for g, b in enumerate(base) for k in range(5)]
    rows += [(9000, [1e-200] * 24), (9001, [1e200] * 24), (9002, [0.0] * 24), (9003, None), (9004, [float("nan")] * 24)]

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    usable = [r for r in rows if r[1] and any(r[1]) and r[1][0] == r[1][0]]
    want = {(a, b): s for a, x in usable for b, y in usable if a < b and (s := cosine(x, y)) > 0.6}
    got = {(r.a, r.b): r.similarity for r in networks.similar_edges(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v").collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want) > 50 and (9000, 9001) in got
    assert all(s == pytest.approx(want[e]) for e, s in got.items())


# --- trends, importances, grid

def plain_fit(points, passes=30):
    """Slope, intercept and scale of one series, pass by pass."""
    n = len(points)
    mt, my = sum(t for t, _ in points) / n, sum(y for _, y in points) / n
    vt = sum((t - mt) ** 2 for t, _ in points)
    b = sum((t - mt) * (y - my) for t, y in points) / vt if vt else 0.0
    a, s = my - b * mt, 0.0
    s = math.sqrt(sum((y - my) ** 2 for _, y in points) / n)
    for _ in range(passes):
        rs = [y - a - b * t for t, y in points]
        inside = [abs(r) <= 1.35 * s for r in rs]
        ws = [1.0 if i else 1.35 * s / abs(r) for r, i in zip(rs, inside, strict=True)]
        w = sum(ws)
        wt, wy = (sum(x * p[k] for x, p in zip(ws, points, strict=True)) for k in (0, 1))
        wtt = sum(x * t * t for x, (t, _) in zip(ws, points, strict=True))
        wty = sum(x * t * y for x, (t, y) in zip(ws, points, strict=True))
        left = n - 1.35**2 * (n - sum(inside))
        below = wtt - wt * wt / w + 0.0001 * s
        b = (wty - wt * wy / w) / below if below else 0.0
        a = (wy - b * wt) / w
        s = math.sqrt(sum(r * r for r, i in zip(rs, inside, strict=True) if i) / left) if left > 0 else s
    return b, a


def test_robust_trend(spark):
    draw = random.Random(12)
    series = {}
    for key, slope in (("up", 0.02), ("down", -0.03), ("flat", 0.0)):
        series[key] = [(float(t), slope * t + 1 + draw.gauss(0, 0.05)) for t in range(0, 200, 4)]
        for k in (3, 17, 30):
            series[key][k] = (series[key][k][0], series[key][k][1] + 9)  # planted outliers
    series["same"] = [(float(t), 2.0) for t in range(12)]
    series["few"] = [(float(t), 1.0 * t) for t in range(5)]
    rows = [(k, DAY + datetime.timedelta(hours=t), y) for k, s in series.items() for t, y in s] + [("up", None, 1.0), ("up", DAY, None), ("up", DAY - datetime.timedelta(days=90), 50.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double")
    got = {r.key: r for r in models.robust_trend(df, ["key"], F.lit("2024-01-20").cast("timestamp")).collect()}
    assert got.keys() == {"up", "down", "flat", "same"}
    for k, r in got.items():
        b, a = plain_fit(series[k])
        assert r.slope == pytest.approx(b, abs=1e-6) and r.intercept == pytest.approx(a, abs=1e-6)
        assert r.n == len(series[k]) and r.forecast[6] == pytest.approx(a + b * (series[k][-1][0] + 7), abs=1e-4)
    assert abs(got["up"].slope - 0.02) < 0.002 and abs(got["down"].slope + 0.03) < 0.002
    assert (got["flat"].trend, got["same"].trend, got["same"].r2) == ("stable", "stable", 0.0)
    assert got["down"].trend in ("decreasing", "volatile")


def test_seasonal_forecast(spark):
    draw = random.Random(14)
    wave = lambda t: 0.4 * math.sin(2 * math.pi * t / 24 + 1)
    rows = [("day", DAY + datetime.timedelta(hours=t), 1 + wave(t) + draw.gauss(0, 0.01)) for t in range(24 * 20)] + [("short", DAY + datetime.timedelta(hours=t), 2.0) for t in range(12)] + [("few", DAY, 1.0), ("day", None, 1.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double")
    waves = {(r.key, r.period): r for r in models.seasonal_waves(df, ["key"]).collect()}
    assert waves.keys() == {("day", 24)} and waves["day", 24].amplitude == pytest.approx(0.4, abs=0.01) and waves["day", 24].r2 > 0.99
    out = {(r.key, r.step): r for r in models.seasonal_forecast(df, ["key"], F.lit("2024-01-25").cast("timestamp")).collect()}
    trend = models.robust_trend(df, ["key"], F.lit("2024-01-25").cast("timestamp")).filter("key = 'day'").first()
    w = waves["day", 24]
    tail = [v for k, _, v in rows if k == "day"][-21:-1]
    mean = sum(tail) / 20
    band = 1.96 * math.sqrt(sum((v - mean) ** 2 for v in tail) / 20)
    for step in range(1, 8):
        ts = rows[24 * 20 - 1][1] + datetime.timedelta(hours=step)
        seconds = (ts - datetime.datetime(1970, 1, 1)).total_seconds()
        want = trend.forecast[step - 1] + w.amplitude * math.sin(2 * math.pi * seconds / 86400 + w.phase) * w.r2
        assert out["day", step].value == pytest.approx(want, abs=1e-6) and out["day", step].band == pytest.approx(band)
        assert out["short", step].value == pytest.approx(2.0) and out["short", step].band == 0
    assert {k for k, _ in out} == {"day", "short"}


def test_planted_feature(spark):
    draw = random.Random(13)
    rows = [(x := draw.random(), draw.random(), draw.random(), 1.0 if i % 50 else None, 3 * x + 0.1 * draw.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double")
    forest = models.forest_importance(df, ["b", "a", "c", "d"], "y", trees=20).collect()
    assert forest[0].feature == "a" and forest[0].importance > 0.9 and [r["rank"] for r in forest] == [1, 2, 3, 4]
    told = models.feature_importance(df, ["b", "a", "c", "d"], "y").collect()
    best = min(told, key=lambda r: r["rank"])
    assert best.feature == "a" and best.correlation > 0.99 and best.mutual_information > 1


def test_weight_grid(spark):
    candidates = spark.createDataFrame([(u, i, float(i == u % 3), float(i == 0), None) for u in range(6) for i in range(4)], "user_id int, item_id int, x double, y double, z double")
    relevance = spark.createDataFrame([(u, u % 3, 1.0) for u in range(6)] + [(7, 1, 1.0), (8, 1, 0.0)], "user_id int, item_id int, relevance double")
    out = {r.combination: r for r in models.weight_grid(candidates, relevance, ["x", "y", "z"], [(0.2, 0.5, 0.3), (0.5, 0.2, 0.3), (0.6, 0.2, 0.2)], k=1).collect()}
    assert [out[i].ndcg for i in range(3)] == pytest.approx([2 / 7, 6 / 7, 6 / 7], abs=1e-8)
    assert [out[i].best for i in range(3)] == [False, True, False] and out[0].users == 7
    assert len(models.weight_combinations()) == 13
