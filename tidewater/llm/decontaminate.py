"""Benchmark decontamination with a generalised suffix automaton.

The test items are normalised to words and put into one suffix automaton a
block of items. Tasks stream the words of every document through it and keep
the length of the longest suffix that some item contains; wherever that length
reaches the window, the matched words are hit. Long items are cut into chunks
that overlap by a window less a word, which have the same windows. Automata are
built in tasks, a block of chunks each; benchmarks larger than one block are
handled block by block over all documents.

Nulls and empty texts have no words and no hits; an item without words has no
window; repeated items count once, items that share a window each; repeated documents are rows of their own
with equal results, whatever the number of blocks; very long texts are streamed
word by word; an empty table of documents gives an empty result, and one of
items no hits. Columns besides those named are not touched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORDS, words, written

#: Words of an item that make a window.
WINDOW = 13
#: Words of benchmark text in one automaton: 200,000 words take about 200 MB in a Python worker.
BLOCK_WORDS = 200_000
#: Words of a long item that start a window in one chunk.
CHUNK_WORDS = 20_000


class Automaton:
    """Suffix automaton of word sequences, with the items that own each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.go, self.link, self.long = [{}], [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in text]) for name, text in items if text]
        for _, text in coded:
            last = 0
            for w in text:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(t) for _, t in coded)])
        # the ancestor that holds the last `window` words of a state's strings
        self.base = list(range(len(self.go)))
        for v in sorted(range(1, len(self.go)), key=self.long.__getitem__):
            if self.long[self.link[v]] >= window:
                self.base[v] = self.base[self.link[v]]
        self.owners: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for name, text in coded:
            v = 0
            for n, w in enumerate(text, 1):
                v = self.go[v][w]
                if n >= window:
                    self.owners.setdefault(self.base[v], set()).add(name)
            if len(text) < window:
                self.short.setdefault(v, {}).setdefault(len(text), set()).add(name)
        # the nearest state on the way to the root, itself included, where a short item ends
        self.ends = [-1] * len(self.go)
        for v in sorted(range(1, len(self.go)), key=self.long.__getitem__):
            self.ends[v] = v if v in self.short else self.ends[self.link[v]]

    def _state(self, length: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.long.append(length)
        return len(self.go) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that p reaches by w and that holds nothing longer than p's longest plus w."""
        q = self.go[p][w]
        if self.long[q] == self.long[p] + 1:
            return q
        copy = self._state(self.long[p] + 1, dict(self.go[q]), self.link[q])
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.go[last]:
            return self._split(last, w)
        new, p = self._state(self.long[last] + 1, {}, 0), last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (end exclusive) inside windows, merged, and the items whose windows occur."""
        n = len(text)
        if n < self.shortest:
            return [], set()
        ids = np.fromiter((self.vocab.get(w, -1) for w in text), np.int64, n)
        # a word that no item has ends every match: only long enough runs of known words are walked
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set = set()
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start >= self.shortest:
                self._walk(ids[start:end].tolist(), start, spans, found)
        return merged(spans), found

    def _walk(self, ids: list[int], at: int, spans: list, found: set) -> None:
        go, link, long, window = self.go, self.link, self.long, self.window
        v = length = 0
        for i, w in enumerate(ids, at + 1):
            while v and w not in go[v]:
                v = link[v]
                length = long[v]
            if w in go[v]:
                v = go[v][w]
                length += 1
            else:
                length = 0
            if length >= window:
                spans.append((i - length, i))
                found |= self.owners[self.base[v]]
            u = self.ends[v]
            while u > 0:
                for k, names in self.short[u].items():
                    if k <= length:
                        spans.append((i - k, i))
                        found |= names
                u = self.ends[link[u]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_ranges(text: bytes) -> np.ndarray:
    """Start and end byte of every word."""
    inside = np.frombuffer(text.translate(WORDS), np.uint8) != 0x20
    return np.flatnonzero(np.diff(np.concatenate(([0], inside, [0])).astype(np.int8))).reshape(-1, 2)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text with the words of the ranges, and what stands between them, cut out."""
    at, out, done = byte_ranges(text), [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = int(at[b - 1][1])
    return b"".join([*out, text[done:]])


def _chunked(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = words(text)
                parts = [own[i : i + CHUNK_WORDS + window - 1] for i in range(0, max(1, len(own) - window + 1), CHUNK_WORDS)] if own else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array([len(p) for p in parts], pa.int64()), pa.array([b" ".join(p) for p in parts], pa.binary())], names=["item", "n", "words"])

    return run


def _built(window: int):
    def run(t: pa.Table) -> pa.Table:
        own = Automaton([(i, w.split()) for i, w in zip(t.column("item").to_pylist(), t.column("words").to_pylist(), strict=True)], window)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(vars(own))], pa.binary())})

    return run


def automata(items: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """(block, data): the automata of all items, a block a row; chunks are dealt to blocks by hash, half of block_words each on average where there are several."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).distinct()
    chunks = written(rows.mapInArrow(_chunked(window), "item string, n bigint, words binary"), "chunks")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    blocks = 1 if total <= block_words else -(-2 * total // block_words)
    chunks = chunks.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
    return written(chunks.groupBy("block").applyInArrow(_built(window), "block int, data binary"), "automata")


SCHEMA = "id bigint, print bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>, text string"
_FIELDS = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("text", pa.string())])


def _row(i: int | None, p: int, text: bytes | None, spans: list[tuple[int, int]], found: set, n_words: int, cut: bool) -> dict:
    left = without(text or b"", spans).decode(errors="replace") if cut and spans else None
    return {"id": i, "print": p, "n_words": n_words, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(x for x in found if x is not None), "text": left}


def _scan(docs: DataFrame, data: bytes, cut: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Automaton.__new__(Automaton)
        vars(held).update(pickle.loads(shared.value))
        for batch in batches:
            rows = []
            for i, p, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = words(text)
                rows.append(_row(i, p, text, *held.scan(own), len(own), cut))
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return docs.mapInArrow(run, SCHEMA)


def _whole(cut: bool):
    """The rows of documents with what all blocks found in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, p, text, spans, found in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                own = merged([(x["start"], x["end"]) for x in spans or ()])
                rows.append(_row(i, p, text, own, set(found or ()), len(words(text)), cut))
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return run


def benchmark_hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """One row a document: id, print (hash of its text), n_words, spans of hit words, items found, text.

    `text` is the document without its hit words where cut is asked for and
    there are any, else null.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).cast("binary").alias("text"))
    built = automata(items, item_col, item_text_col, window, block_words)
    blocks = [r.block for r in built.select("block").orderBy("block").collect()]

    def data(block: int) -> bytes:
        # one block at a time comes to the driver and goes to the tasks
        return bytes(built.filter(F.col("block") == block).first().data)

    if not blocks:
        return _scan(own, pickle.dumps(vars(Automaton([], window))), cut)
    if len(blocks) == 1:
        return _scan(own, data(blocks[0]), cut)
    every = None
    for b in blocks:
        part = _scan(own, data(b), False).filter(F.size("spans") > 0).dropDuplicates(["id", "print"])
        part = written(part.select("id", "print", "spans", "items"), "part")
        every = part if every is None else every.unionByName(part)
    every = written(every.groupBy("id", "print").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits")
    rows = own.alias("d").join(every.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.print") == F.col("w.print")), "left")
    return rows.select("d.id", "d.print", "d.text", "w.spans", "w.items").mapInArrow(_whole(cut), SCHEMA)


def judged(hits: DataFrame, coverage: int = 20) -> DataFrame:
    """Adds n_hit, n_items and contaminated: any word hit, and hit words times `coverage` reach all words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: int = 20) -> DataFrame:
    """docs without contaminated documents, and without the hit words of the others, one row for each row.

    All columns of docs stay; n_chars, if there, follows the text. A document is
    decided by its id and text, so repeated rows are decided alike.
    """
    hits = judged(benchmark_hits(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, window=window, cut=True), coverage)
    touched = hits.filter("n_hit > 0").select(F.col("id").alias("_tw_id"), F.col("print").alias("_tw_print"), F.col("contaminated").alias("_tw_out"), F.col("text").alias("_tw_left")).distinct()
    touched = written(touched, "touched")
    out = docs.join(touched, (docs[id_col].cast("long").eqNullSafe(F.col("_tw_id"))) & (F.xxhash64(docs[text_col]) == F.col("_tw_print")), "left").filter(~F.coalesce("_tw_out", F.lit(False)))
    out = out.withColumn(text_col, F.coalesce("_tw_left", text_col))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_tw_left").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
