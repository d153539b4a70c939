"""Conversation structure repair by an auction shortest-path algorithm.

A conversation's rows, in order, span a lattice: a layer before each row, with
a node for each state that the kept role initials can be in (nothing yet, after
s, after u, after a). Keep, rerole and delete lead to the next layer, insert
stays in its layer. The auction algorithm holds a price for each node and a
path from the origin: at the path's end it either extends along an arc whose
cost and head price equal the node's price, or raises that price to the
cheapest arc and contracts. Prices start as the least costs of the rows ahead,
so only what the order of roles costs is left to be bid. Converged prices make
every arc of every cheapest path tight; of the tight arcs that lead to the end,
the trace takes the one with the least letter.

Long conversations are split. Rows are numbered by ranges, and BLOCK of them
at most make a block, so one conversation may fill many tasks. Only blocks of
conversations with several of them take two further steps: a block's costs
from each state to each state are folded backwards into the prices at its end,
and the states that traces from its four entries end in are chained forwards.
Within a block, auctions run over LAYERS rows at a time. Texts take no part in
this; rows carry the SHA-256 of role and text. Equal rows at one turn are one
row with a count. Only the report's digest and audit of one conversation come
from one task: the digest reads rows one by one, the audit has a letter a row.

Null roles and texts are one space, hence illegal and blank; null turns come
first; a null conversation id is a conversation of its own. Rows of equal turn
stand in the order of the SHA-256 of role and text. Repeated rows are
duplicates of the first. Empty texts are blank; very long texts are hashed
whole. An empty table gives an empty result; columns other than the four are
not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import written

#: Rows of a block as a power of two, and of one auction.
BLOCK_BITS, LAYERS = 10, 64
#: Costs of edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, u, a. Where keeping an initial leads, and where an inserted or changed turn leads.
START, S, U, A = range(4)
KEEP = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
NEXT = (U, U, A, U)
NAME = {U: "u", A: "a"}
ROLES = {"u": "user", "a": "assistant"}
#: Prices behind a conversation's last row: nothing, or a reply, must come last.
END = [0, None, None, 0]
SPACE = " \t\n\x0b\f\r"


# --- the lattice of one block, in plain Python

def _least(code: str, n: int) -> int:
    """The cheapest edit of a row and its repetitions, whatever stands around it."""
    if code == "D":
        return DELETE * n
    keep = (code.lower() not in KEEP) * REROLE + code.isupper() * TRUNCATED
    return min(DELETE, keep) + DELETE * (n - 1)


class Lattice:
    """Some rows' lattice, with the prices behind it given for each state (None: no way).

    A row is a code and a count: D must be deleted, else s, u, a or x (another
    initial), in capitals if truncated; the count's further rows must go.
    """

    def __init__(self, codes: str, counts: list[int], ends: list[int | None]) -> None:
        m = self.layers = len(codes)
        self.end = 4 * (m + 1)
        arcs: list[list[tuple[int, str, int]]] = []
        for k in range(m + 1):
            for q in range(4):
                out = [(INSERT, "I", 4 * k + NEXT[q])]
                if k == m:
                    if ends[q] is not None:
                        out.append((ends[q], "", self.end))
                elif codes[k] == "D":
                    out.append((DELETE * counts[k], "D", 4 * k + 4 + q))
                else:
                    code, rest = codes[k].lower(), DELETE * (counts[k] - 1)
                    cut = TRUNCATED * codes[k].isupper() + rest
                    out += [(DELETE + rest, "D", 4 * k + 4 + q), (REROLE + cut, "R", 4 * k + 4 + NEXT[q])]
                    if q in KEEP.get(code, ()):
                        out.append((cut, "K", 4 * k + 4 + KEEP[code][q]))
                arcs.append(out)
        self.arcs = arcs
        leads = self._leading(lambda i, arc: True)
        self.arcs = [[arc for arc in out if leads[arc[2]]] for out in arcs]
        ahead, self.price = min((e for e in ends if e is not None), default=0), [0] * (self.end + 1)
        for k in range(m, -1, -1):
            ahead += _least(codes[k], counts[k]) if k < m else 0
            self.price[4 * k : 4 * k + 4] = [ahead] * 4

    def _leading(self, allowed) -> list[bool]:
        """Which nodes reach the end by allowed arcs."""
        leads = [False] * self.end + [True]
        for k in range(self.layers, -1, -1):
            for _ in range(3):  # inserts lead on inside a layer, two steps at most without a circle
                for i in range(4 * k, 4 * k + 4):
                    leads[i] = leads[i] or any(leads[arc[2]] and allowed(i, arc) for arc in self.arcs[i])
        return leads

    def auction(self, state: int) -> int | None:
        """The least cost from a state before the first row; prices stay for further auctions."""
        if not self.arcs[state]:
            return None
        price, arcs, end, path = self.price, self.arcs, self.end, [state]
        while (i := path[-1]) != end:
            best, head = min((cost + price[j], j) for cost, _, j in arcs[i])
            if price[i] < best:
                price[i] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        return price[state]

    def tight(self) -> list[list[tuple[int, str, int]]]:
        """Each node's arcs on cheapest ways to the end."""
        price = self.price
        fits = lambda i, arc: price[i] == arc[0] + price[arc[2]]
        leads = self._leading(fits)
        return [[arc for arc in out if leads[arc[2]] and fits(i, arc)] for i, out in enumerate(self.arcs)]


def swept(codes: str, counts: list[int], ends: list[int | None], entries: list[int]) -> tuple[list[Lattice], list[int | None]]:
    """The lattices of LAYERS rows at a time, with converged prices, and the price of each state before the first row (entries only)."""
    out = []
    for at in range((len(codes) - 1) // LAYERS * LAYERS, -1, -LAYERS):
        own = Lattice(codes[at : at + LAYERS], counts[at : at + LAYERS], ends)
        ends = [own.auction(q) if at or q in entries else None for q in range(4)]
        out.append(own)
    return out[::-1], ends


def traced(lattices: list[Lattice], counts: list[int], state: int) -> tuple[int, int, str, list[dict]]:
    """From a state: the state at the end, the cost, the edits' letters, and for each row with an effect what is inserted before it, how it is kept (K, u, a or not) and what comes behind."""
    cost, audit, steps, before, row = 0, [], [], "", 0
    for own in lattices:
        arcs, i = own.tight(), state
        while True:
            paid, letter, head = min(arcs[i], key=lambda arc: arc[1])
            if not letter:
                state = i % 4
                break
            cost += paid
            if letter == "I":
                audit.append("I")
                before += NAME[head % 4]
            else:
                audit.append("D" * counts[row] if letter == "D" else letter + "D" * (counts[row] - 1))
                kept = {"K": "K", "R": NAME.get(head % 4), "D": ""}[letter]
                if kept or before:
                    steps.append({"i": row, "before": before, "act": kept, "after": ""})
                before, row = "", row + 1
            i = head
    if before and steps and steps[-1]["i"] == row - 1:
        steps[-1]["after"] = before
    elif before:
        steps.append({"i": row - 1, "before": "", "act": "", "after": before})
    return state, cost, "".join(audit), steps


# --- blocks in Spark

STEPS = "array<struct<i:int,before:string,act:string,after:string>>"
_STEPS = pa.list_(pa.struct([("i", pa.int32()), ("before", pa.string()), ("act", pa.string()), ("after", pa.string())]))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, block, costs: from each state to each state, a row of four a state; -1 for no way."""
    for b in batches:
        costs = []
        for codes, counts in zip(b["codes"].to_pylist(), b["counts"].to_pylist(), strict=True):
            to = [swept(codes, counts, [0 if x == q else None for x in range(4)], [0, 1, 2, 3])[1] for q in range(4)]
            costs.append([-1 if to[x][q] is None else to[x][q] for q in range(4) for x in range(4)])
        yield pa.RecordBatch.from_arrays([b["conv"], b["block"], pa.array(costs, pa.list_(pa.int64()))], names=["conv", "block", "costs"])


def _folded(blocks: pd.DataFrame) -> pd.DataFrame:
    """conv, block, ends: the prices behind each block of one conversation."""
    blocks = blocks.sort_values("block")
    ends, out = END, []
    for costs in reversed(list(blocks["costs"])):
        out.append([-1 if e is None else e for e in ends])
        ways = [[costs[4 * q + x] + ends[x] for x in range(4) if costs[4 * q + x] >= 0 and ends[x] is not None] for q in range(4)]
        ends = [min(w, default=None) for w in ways]
    return pd.DataFrame({"conv": blocks["conv"], "block": blocks["block"], "ends": out[::-1]})


def _chained(blocks: pd.DataFrame) -> pd.DataFrame:
    """conv, block, entry: the state in which each block of one conversation is entered."""
    leads, state, out = {(b, e): x for b, e, x in zip(blocks["block"], blocks["entry"], blocks["leaves"], strict=True)}, START, []
    for b in sorted(set(blocks["block"])):
        out.append((blocks["conv"].iloc[0], b, state))
        state = leads[b, state]
    return pd.DataFrame(out, columns=["conv", "block", "entry"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, block, rows, entry, leaves, cost, audit, steps: one row, or one for each entry of a block among several."""
    for b in batches:
        own, out = [], []
        for k, (codes, counts, ends) in enumerate(zip(b["codes"].to_pylist(), b["counts"].to_pylist(), b["ends"].to_pylist(), strict=True)):
            entries = [0, 1, 2, 3] if ends else [START]
            lattices, prices = swept(codes, counts, [None if e < 0 else e for e in ends] if ends else END, entries)
            for q in entries:
                if prices[q] is not None:
                    own.append(k)
                    out.append((q, *traced(lattices, counts, q)))
        take = pa.array(own, pa.int64())
        q, leaves, cost, audit, steps = zip(*out, strict=True) if out else ([],) * 5
        columns = [*(b[c].take(take) for c in ("conv", "block", "rows")), pa.array(q, pa.int32()), pa.array(leaves, pa.int32()), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(steps, _STEPS)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "block", "rows", "entry", "leaves", "cost", "audit", "steps"])


ROWS = "array<struct<seq:bigint,turn:bigint,print:binary,initial:string,code:string,n:bigint>>"


def _order() -> list[Column]:
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("print")]


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv (text, empty for null), turn, role, text, print."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    out = rows.select(F.coalesce(F.col(conv_col).cast("long").cast("string"), F.lit("")).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return out.withColumn("print", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _blocks(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered rows (conv, turn, print, initial, kind, n, first) and blocks of them (conv, block, rows)."""
    bare = F.rtrim("text", F.lit(SPACE))
    kind = F.when(bare == "", "blank").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "full").otherwise("cut")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    slim = prepared.select("conv", "turn", "print", initial.alias("initial"), kind.alias("kind"))
    one = slim.groupBy("conv", "turn", "print", "initial", "kind").agg(F.count(F.lit(1)).alias("n"))
    # null turns come before all others
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = one.groupBy("conv", "print").agg(F.min(place).alias("seen"))
    one = one.join(seen.hint("merge"), ["conv", "print"]).withColumn("first", F.col("seen") == place).drop("seen")
    live = F.col("first") & (F.col("kind") != "blank")
    one = one.withColumn("code", F.when(~live, "D").when(F.col("kind") == "cut", F.upper("initial")).otherwise(F.col("initial")))
    numbered = written(one.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("seq", F.monotonically_increasing_id()), "rows")
    block = F.shiftright("seq", BLOCK_BITS).alias("block")
    blocks = numbered.groupBy("conv", block).agg(F.array_sort(F.collect_list(F.struct("seq", "turn", "print", "initial", "code", "n"))).alias("rows"))
    return numbered, written(blocks, "blocks")


def _edits(blocks: DataFrame) -> DataFrame:
    """conv, block, rows, cost, audit, steps of the cheapest edits with the least letters."""
    codes = F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes")
    lists = blocks.select("conv", "block", "rows", codes, F.transform("rows", lambda r: r["n"]).alias("counts"))
    several = written(blocks.groupBy("conv").count().filter("count > 1").select("conv"), "several")
    costs = lists.select("conv", "block", "codes", "counts").join(several.hint("merge"), "conv", "left_semi").mapInArrow(_costs, "conv string, block bigint, costs array<bigint>")
    ends = written(costs.groupBy("conv").applyInPandas(_folded, "conv string, block bigint, ends array<bigint>"), "ends")
    found = lists.join(ends.hint("merge"), ["conv", "block"], "left").mapInArrow(_traces, f"conv string, block bigint, rows {ROWS}, entry int, leaves int, cost bigint, audit string, steps {STEPS}")
    found = written(found, "traces")
    ways = found.join(several.hint("merge"), "conv", "left_semi").select("conv", "block", "entry", "leaves")
    entered = written(ways.groupBy("conv").applyInPandas(_chained, "conv string, block bigint, entry int"), "entries")
    through = found.join(entered.hint("merge"), ["conv", "block", "entry"], "left_semi")
    return found.join(several.hint("merge"), "conv", "left_anti").unionByName(through)


def _applied(edits: DataFrame, prepared: DataFrame) -> DataFrame:
    """Edits and texts of a conversation in one partition, in order, each edit before the rows that it is about."""
    at = edits.select("conv", F.explode("steps").alias("step"), "rows").withColumn("row", F.element_at("rows", F.col("step.i") + 1))
    acts = at.select("conv", "row.turn", "row.print", F.lit(0).alias("what"), F.col("step.before").alias("before"), F.col("step.act").alias("act"), F.col("step.after").alias("after"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast("string")
    texts = prepared.select("conv", "turn", "print", F.lit(1).alias("what"), none.alias("before"), none.alias("act"), none.alias("after"), "role", "text")
    return acts.unionByName(texts).repartition("conv").sortWithinPartitions(*_order(), "what")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str | None]]:
    """(conv, role, text) of repaired rows; a conversation starts with (conv, None, None)."""
    conv, key, act, after = None, None, "", ""
    for b in batches:
        for r in b.to_pylist():
            if r["conv"] != conv:
                conv, key = r["conv"], None
                yield conv, None, None
            if r["what"] == 0:
                key, act, after = (r["turn"], r["print"]), r["act"], r["after"]
                for x in r["before"] if act else r["before"] + after:
                    yield conv, ROLES[x], ""
            elif act and key == (r["turn"], r["print"]):
                yield conv, r["role"] if act == "K" else ROLES[act], r["text"]
                for x in after:
                    yield conv, ROLES[x], ""
                act = ""  # further rows of the key are repetitions


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, str]] = []
    conv, state, empty = None, hashlib.sha256(), True

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], names=["conv", "repaired_sha256"])
        out.clear()
        return done

    for c, role, text in _lines(batches):
        if role is None:
            if conv is not None:
                out.append((conv, state.hexdigest()))
            if len(out) >= 10_000:
                yield batch()
            conv, state, empty = c, hashlib.sha256(), True
        else:
            state.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
    if conv is not None:
        out.append((conv, state.hexdigest()))
    yield batch()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv", "place", "role", "text"])

    place = 0
    for c, role, text in _lines(batches):
        if role is None:
            place = 0
            continue
        out.append((c, place, role, text))
        place += 1
        if len(out) >= 1_000:
            yield batch()
    yield batch()


# --- the operator

def damage(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text with faults by crc32 of `conv:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes its `[.!?]` out, 3 repeats it, 4 makes it the user's. Null roles, texts, and ids in the hashed text, become one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    role = F.when(kind == 4, "user").otherwise(role)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.filter(kind != 0).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy")


def report(rows: DataFrame, ids: DataFrame | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A row's first fault counts: blank, duplicate (role and text seen before),
    truncated. illegal counts adjacent role initials other than su, ua, au. ids,
    one column of conversations, adds those of which no row is left.
    """
    prepared = _prepared(rows, conv_col, turn_col, role_col, text_col)
    numbered, blocks = _blocks(prepared)
    edits = written(_edits(blocks), "edits")
    n, live = F.col("n"), F.col("code") != "D"
    counted = numbered.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("kind") == "blank", n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("kind") != "blank", n - live.cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((live & (F.col("kind") == "cut")).cast("long")).alias("truncated"),
    )
    counted = counted.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    legal = ("su", "ua", "au")
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.zip_with(F.slice(initials, 1, F.size("rows") - 1), F.slice(initials, 2, F.size("rows") - 1), lambda x, y: F.concat(x, y))
    inside = F.size(F.filter(pairs, lambda p: ~p.isin(*legal))) + F.aggregate(F.transform("rows", lambda r: r["n"] - 1), F.lit(0).cast("long"), lambda x, y: x + y)
    last = F.lag(F.element_at(initials, -1)).over(W.partitionBy("conv").orderBy("block"))
    illegal = blocks.select("conv", (inside + F.coalesce((~F.concat(last, F.element_at(initials, 1)).isin(*legal)).cast("long"), F.lit(0))).alias("illegal"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
    audits = edits.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
    digests = _applied(edits, prepared).mapInArrow(_digests, "conv string, repaired_sha256 string")
    ids = rows.select(conv_col) if ids is None else ids.unionByName(rows.select(F.col(conv_col).alias(ids.columns[0])))
    out = ids.select(F.col(ids.columns[0]).cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    for part in (counted, illegal.groupBy("conv").agg(F.sum("illegal").alias("illegal")), audits, digests):
        out = out.join(part.hint("merge"), "conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repaired(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of repaired conversations: conv_id, place (from 0), role, text; inserted turns have empty texts."""
    prepared = _prepared(rows, conv_col, turn_col, role_col, text_col)
    out = _applied(written(_edits(_blocks(prepared)[1]), "edits"), prepared).mapInArrow(_turns, "conv string, place bigint, role string, text string")
    return out.select(F.expr("nullif(conv, '')").cast("long").alias("conv_id"), "place", "role", "text")
