"""Repair and prefix trie of conversations against SQL and plain Python."""

from __future__ import annotations

import random

import compare
import pytest

from tidewater.llm import chat_repair, prefix_trie, queries

LARGER = "/root/testdata/sf0.01"
SHARED = [("user", "Hi there."), ("assistant", "Hello!"), ("user", "Go on."), ("assistant", "Yes."), ("user", "And?"), ("assistant", "Done.")]
TAIL = "z " * 50_000 + "."


def odd_rows():
    """Bases with short and long heads, shared beginnings, nulls, ties, repeated rows, odd roles, negative ids, and one conversation of 300 turns."""
    draw = random.Random(5)
    out = [(c, k, *t) for c in (0, 1, 2, 3, 4, 5, 6, 17, 18, 19) for k, t in enumerate(SHARED[: 1 + c % 6])]
    out += [(100, 0, "system", "One rule."), (100, 1, "user", "Why?")]
    out += [(c, k, draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice(["A.", "B", "C!", "", " \t"])) for c in range(101, 130) for k in range(draw.randint(1, 12))]
    out += [(230, k, draw.choice(["user", "assistant", "tool"]), draw.choice([f"T{k}.", f"U{k}", "Same."])) for k in range(300)]
    out += [(-7, 0, "user", "Minus."), (-7, 1, "assistant", "Yes."), (-105, 3, "user", "Q?"), (-105, 3, "user", "Q?"), (-105, 3, "assistant", "A."), (-105, None, "user", "First.")]
    out += [(None, 0, "user", "No id."), (None, None, None, None), (300, None, "user", None), (300, None, None, "x"), (300, None, None, "x"), (301, 5, None, None), (302, 2, "user", TAIL), (302, 9, "assistant", TAIL)]
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def written(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "2 AS n", "'x' AS node", "3 AS seq", "'y' AS `rows`", "4 AS h", "5 AS base", "6 AS id", "7 AS i")
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{tmp_path}/conversations.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["op11_auction_repair", "op13_prefix_trie"])
def test_given_table(spark, name):
    assert compare.difference(queries.queries()[name](spark, LARGER), compare.views(LARGER), queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["op11_auction_repair", "op13_prefix_trie"])
def test_odd_rows(spark, tmp_path, name):
    sf_dir, con = written(spark, tmp_path, odd_rows())
    assert compare.difference(queries.queries()[name](spark, sf_dir), con, queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["op11_auction_repair", "op13_prefix_trie"])
def test_empty_table(spark, tmp_path, name):
    sf_dir, _ = written(spark, tmp_path, [])
    assert queries.queries()[name](spark, sf_dir).count() == 0


def test_repair_in_small_blocks(spark, tmp_path, monkeypatch):
    """Conversations of many blocks, which are folded and chained."""
    monkeypatch.setattr(chat_repair, "BLOCK_BITS", 2)
    monkeypatch.setattr(chat_repair, "LAYERS", 3)
    sf_dir, con = written(spark, tmp_path, odd_rows())
    assert compare.difference(queries.op11_auction_repair(spark, sf_dir), con, queries.oracle_sql()["op11_auction_repair"]) is None


def plainly(codes, counts, state, ends):
    """(cost, letters) of the cheapest edits, least letters first, by dynamic programming."""

    def closed(best):
        for q, to in ((0, 2), (1, 2), (3, 2), (2, 3), (3, 2)):
            if q in best:
                c, e = best[q]
                best[to] = min(best.get(to, (1 << 40, "")), (c + 5, e + "I"))
        return best

    best = closed({state: (0, "")})
    for code, n in zip(codes, counts, strict=True):
        new = {}
        for q, (c, e) in best.items():
            ways = [(q, 2 * n, "D" * n)]
            if code != "D":
                rest, cut = "D" * (n - 1), 2 * (n - 1) + 5 * code.isupper()
                ways.append((chat_repair.NEXT[q], cut + 1, "R" + rest))
                if (to := chat_repair.KEEP.get(code.lower(), {}).get(q)) is not None:
                    ways.append((to, cut, "K" + rest))
            for to, paid, letters in ways:
                new[to] = min(new.get(to, (1 << 40, "")), (c + paid, e + letters))
        best = closed(new)
    return min((c + ends[q], e) for q, (c, e) in best.items() if ends[q] is not None)


def test_auction_against_dynamic_programming(monkeypatch):
    draw = random.Random(9)
    for trial in range(400):
        monkeypatch.setattr(chat_repair, "LAYERS", draw.choice([1, 2, 5, 64]))
        codes = "".join(draw.choices("suaxSUAXD", k=draw.randint(1, 14)))
        counts = [draw.choice([1, 1, 1, 2, 3]) for _ in codes]
        ends = draw.choice([chat_repair.END, [3, None, 1, 0], [None, None, 0, None], [0, 7, 2, 4]])
        lattices, prices = chat_repair.swept(codes, counts, ends, [0, 1, 2, 3])
        for q in range(4):
            if prices[q] is not None:
                state, cost, audit, _ = chat_repair.traced(lattices, counts, q)
                assert (cost + ends[state], audit) == plainly(codes, counts, q, ends), (codes, counts, ends, q)
                assert prices[q] == cost + ends[state]


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "B"), (1, 3, "user", "B"), (1, 4, "user", "C."), (2, 0, "user", "Q?"), (2, 1, "assistant", "A."), (3, 0, "tool", " ")]
    out = sorted(tuple(r) for r in chat_repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect())
    # A. becomes the user's, the first B (truncated) and its copy go, C. becomes the assistant's
    assert out == [(1, 0, "system", "S."), (1, 1, "user", "A."), (1, 2, "assistant", "C."), (2, 0, "user", "Q?"), (2, 1, "assistant", "A.")]
    got = chat_repair.report(spark.createDataFrame(rows, SCHEMA)).filter("conv_id = 1").first()
    assert (got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit) == (0, 1, 1, 3, 6, "KRDDR")


def test_texts_of_an_inserted_turn(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "assistant", "B."), (1, 2, "user", "C.")] + [(2, k, "user", f"{k}.") for k in range(40)]
    out = chat_repair.repaired(spark.createDataFrame(rows, SCHEMA), conv_col="conv_id").collect()
    assert sorted(tuple(r)[1:] for r in out if r.conv_id == 1) == [(0, "user", "A."), (1, "assistant", "B.")]
    assert sorted((r.place, r.role) for r in out if r.conv_id == 2) == [(k, ("user", "assistant")[k % 2]) for k in range(40)]


def test_other_heads(spark):
    rows = [(c, k, "user", f"{k % 3}") for c in (10, 11, 12) for k in range(3)] + [(12, 3, "user", "own")]
    nodes = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), base=lambda c: c - c % 10, head=lambda c: c % 10, most=9).collect()
    assert sorted((r.depth, r.conv_id, r.n_convs, r.n_leaves, r.saved_tokens) for r in nodes) == [(0, 10, 3, 1, 6), (1, 10, 3, 1, 6), (2, 10, 3, 1, 4), (3, 10, 3, 1, 2), (4, 12, 1, 1, 0)]
    ends = {r.depth: (r.ref_conv, r.ref_pos) for r in nodes}
    assert ends[1] == (10, 0) and ends[4] == (12, 3)


def test_fingerprints_that_meet_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "P", 2)
    with pytest.raises(ArithmeticError):
        prefix_trie.trie(spark.createDataFrame(odd_rows(), SCHEMA), tries=1)
