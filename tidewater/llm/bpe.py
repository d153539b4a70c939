"""Byte-level BPE encoding and decoding by recursive queries of DuckDB inside each task.

Spark deals out the texts. A task splits each text into words by the
vocabulary's pattern and gives new words to a DuckDB connection of its own. A
recursive query holds the tokens of every word; in each step its token-position
rows meet the table of merges and each word contracts the leftmost of its pairs
with the lowest rank, until no word has a pair left. Words longer than LONG
bytes contract all places of that pair at once where this gives the same as one
after the other: only if no merge with the new token ranks before it. Decoding
joins token-position rows with the vocabulary and aggregates their bytes in
order.

Words of a text are split in two steps with the same result as the pattern
alone: first at white space, then by the pattern inside a piece, and only for
pieces that the task has not kept. A task keeps KEPT pieces at most, and sends
DuckDB BLOCK bytes or TOKENS tokens at a time, so memory follows the longest
text and word, not the partition. A word that stands in the vocabulary is one
token.

Null and empty texts have no tokens and decode to no bytes; very long texts
are encoded whole; a word of n bytes takes time in n times the number of its
contractions; ties of rank go to the left; repeated rows get equal results; an
empty table gives an empty result; other columns are not touched. Null arrays
of tokens decode to no bytes; null tokens and tokens outside the vocabulary
are an error.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limit on the vocabulary file that is broadcast, in bytes.
VOCAB_BYTES = 16 << 20
#: Bytes of words, and tokens, in one query; pieces that a task keeps besides those of the texts at hand; characters of texts, and lists, that are taken together.
BLOCK, TOKENS, KEPT, TEXTS, LISTS = 1 << 20, 1 << 18, 700_000, 2 << 20, 500
#: Bytes from which a word contracts several places in a step; pieces of more characters are not kept.
LONG = 64
#: White space as Unicode has it, which is what the pattern means.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Tokens are held in a text as single characters: the token's number and a bit more, without the range that is no text.
SHIFT, GAP, OVER = 256, 0xD800, 2048
CHARACTER = f"chr({{0}} + CASE WHEN {{0}} + {SHIFT} < {GAP} THEN {SHIFT} ELSE {SHIFT + OVER} END)"

#: Tokens, and merges: any two tokens whose bytes together are a token; `calm` tells that no merge with the new token ranks before it.
TABLES = f"""
CREATE TABLE vocab AS SELECT id, hex(bytes) AS x FROM given;
CREATE TABLE merges AS
  SELECT a.id AS l, b.id AS r, c.id AS rank
  FROM (SELECT id, x, unnest(range(2, len(x), 2)) AS k FROM vocab) c
  JOIN vocab a ON a.x = left(c.x, k) JOIN vocab b ON b.x = substr(c.x, k + 1);
CREATE TABLE merge AS
  SELECT l::BIGINT << 32 | r AS pair, {CHARACTER.format("l")} || {CHARACTER.format("r")} AS chars, rank, rank NOT IN (SELECT l FROM merges WHERE rank < l UNION SELECT r FROM merges WHERE rank < r) AS calm FROM merges;
"""

#: One place a word and step.
CONTRACT = f"""
WITH RECURSIVE t(word, w) USING KEY (word) AS (
  SELECT word, w FROM start
  UNION ALL
  SELECT word, substr(w, 1, k - 1) || {CHARACTER.format("rank")} || substr(w, k + 2)
  FROM t JOIN (
    SELECT word, min(rank::BIGINT << 32 | pos) AS best, (best >> 32)::INTEGER AS rank, (best & 4294967295)::INTEGER AS k
    FROM (SELECT word, substr(w, pos, 2) AS chars, pos FROM (SELECT word, w, unnest(range(1, length(w))) AS pos FROM t))
    JOIN merge USING (chars) GROUP BY word) USING (word))
SELECT word, w FROM t
"""

#: All places of the pair where it is calm: every second one of places that follow each other.
CONTRACT_LONG = """
WITH RECURSIVE t(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM start
  UNION ALL
  SELECT word, list(CASE WHEN c.pos IS NULL THEN id ELSE rank END ORDER BY p.pos)
  FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM t) p
  JOIN (SELECT DISTINCT word FROM cuts) USING (word)
  LEFT JOIN cuts c USING (word, pos)
  LEFT JOIN (SELECT word, pos + 1 AS pos, true AS gone FROM cuts) g USING (word, pos)
  WHERE gone IS NULL GROUP BY word)
SELECT word, ids FROM t
"""
CUTS = """(
    SELECT word, pos, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY word, island ORDER BY pos) AS nth, row_number() OVER (PARTITION BY word ORDER BY pos) AS place FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY word ORDER BY pos) AS island FROM (
          SELECT word, pos, rank, calm, min(rank) OVER (PARTITION BY word) AS least
          FROM (SELECT word, l::BIGINT << 32 | r AS pair, pos FROM (SELECT word, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, generate_subscripts(ids, 1) AS pos FROM t WHERE len(ids) > 1))
          JOIN merge USING (pair)) WHERE rank = least))
    WHERE CASE WHEN calm THEN nth % 2 = 1 ELSE place = 1 END)"""

#: Bytes of each list of tokens, aggregated in the order of the sorted rows, which one thread keeps.
JOINED = """
SELECT doc, count(x) AS known, string_agg(x, '') AS x FROM (
  SELECT doc, x FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM start) JOIN vocab USING (id) ORDER BY doc, pos)
GROUP BY doc
"""


def _lists(parts: list[bytes]) -> pa.ListArray:
    """Lists of tokens, each given by the four bytes of its tokens."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


class Codec:
    """The vocabulary in a DuckDB connection of one task. Tokens of a piece are held as four bytes each."""

    def __init__(self, data: bytes, pattern: str) -> None:
        import duckdb
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.whole = {b: i.to_bytes(4, sys.byteorder) for b, i in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.characters = {b: chr(i + SHIFT + OVER * (i + SHIFT >= GAP)) for b, i in enumerate(self.bytes.tolist())}
        self.words = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.con.register("given", pa.table({"bytes": pa.array(list(ranks), pa.binary()), "id": pa.array(list(ranks.values()), pa.int32())}))
        self.con.execute(TABLES)
        self.con.unregister("given")

    def _rows(self, given: pa.Table, sql: str) -> pa.Table:
        self.con.register("given", given)
        self.con.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT * FROM given")
        self.con.unregister("given")
        return self.con.sql(sql).to_arrow_table().combine_chunks()

    def _short(self, words: list[bytes]) -> tuple[list[int], list[int], bytes]:
        """Numbers of words, ends of their tokens, and the tokens, four bytes each."""
        starts = pa.array([w.decode("latin-1").translate(self.characters) for w in words], pa.string())
        got = self._rows(pa.table({"word": pa.array(range(len(words)), pa.int32()), "w": starts}), CONTRACT)
        texts = got["w"].to_pylist()
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int32)
        return got["word"].to_pylist(), np.cumsum([0, *map(len, texts)]).tolist(), (codes - SHIFT - OVER * (codes >= GAP)).astype(np.int32).tobytes()

    def _long(self, words: list[bytes]) -> tuple[list[int], list[int], bytes]:
        """The same for long words, whose tokens are lists."""
        starts = _lists([self.bytes[np.frombuffer(w, np.uint8)].tobytes() for w in words])
        got = self._rows(pa.table({"word": pa.array(range(len(words)), pa.int32()), "ids": starts}), CONTRACT_LONG.replace("cuts", CUTS))
        ids = got["ids"].chunk(0)
        return got["word"].to_pylist(), ids.offsets.to_pylist(), np.asarray(ids.values, np.int32).tobytes()

    def contracted(self, words: Iterable[str]) -> dict[str, bytes]:
        """The tokens of each distinct word."""
        coded = [(w, w.encode()) for w in words]
        out = {w: self.whole[b] for w, b in coded if b in self.whole}
        rest = [x for x in coded if x[1] not in self.whole]
        for contract, own in ((self._short, [x for x in rest if len(x[1]) <= LONG]), (self._long, [x for x in rest if len(x[1]) > LONG])):
            for group in _groups(own, lambda x: len(x[1]), BLOCK):
                numbers, ends, data = contract([b for _, b in group])
                out.update((group[k][0], data[4 * start : 4 * end]) for k, start, end in zip(numbers, ends, ends[1:]))
        return out

    def encode(self, texts: list[str]) -> pa.ListArray:
        pieces = [PIECE.findall(t) for t in texts]
        used = set().union(*pieces)
        new = {p: self.words.findall(p) for p in used - self.kept.keys()}
        tokens = self.contracted({w for ws in new.values() for w in ws})
        kept = self.kept
        for p, ws in new.items():
            kept[p] = tokens[ws[0]] if len(ws) == 1 else b"".join([tokens[w] for w in ws])
        out = _lists([b"".join([kept[p] for p in t]) for t in pieces])
        if len(kept) > KEPT:
            self.kept = {p: kept[p] for p in used}
        for p in [p for p in new if len(p) > LONG]:
            self.kept.pop(p, None)
        return out

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        """The bytes of each list; lists are cut into parts of TOKENS at most, and as many parts share a query."""
        values, ends = lists.values, lists.offsets.to_pylist()
        parts = [(doc, at, min(at + TOKENS, ends[doc + 1])) for doc in range(len(lists)) for at in range(ends[doc], ends[doc + 1], TOKENS)]
        out: list[list[str]] = [[] for _ in lists]
        for group in _groups(parts, lambda x: x[2] - x[1], TOKENS):
            # parts of a group follow each other
            first, last = group[0][1], group[-1][2]
            offsets = pa.array([x[1] - first for x in group] + [last - first], pa.int32())
            got = self._rows(pa.table({"doc": pa.array(range(len(group)), pa.int32()), "ids": pa.ListArray.from_arrays(offsets, values.slice(first, last - first))}), JOINED)
            joined = dict(zip(got["doc"].to_pylist(), zip(got["known"].to_pylist(), got["x"].to_pylist(), strict=True), strict=True))
            for k, (doc, start, end) in enumerate(group):
                known, x = joined.get(k, (0, ""))
                if known != end - start:
                    raise ValueError("a token is not in the vocabulary")
                out[doc].append(x)
        return [bytes.fromhex("".join(x)) for x in out]


def _vocabulary(spark: SparkSession, path: str | None) -> Broadcast:
    """The vocabulary file's bytes, read once by the driver; by default the public 50k ranks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        data = f.read(VOCAB_BYTES + 1)
    if len(data) > VOCAB_BYTES:
        raise ValueError(f"{path} has more than {VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _groups(values: list, size: Callable, most: int) -> Iterator[list]:
    """Consecutive values, `most` of size together at most; a larger one stands alone."""
    group, total = [], 0
    for v in values:
        if group and total + size(v) > most:
            yield group
            group, total = [], 0
        group.append(v)
        total += size(v)
    if group:
        yield group


def _uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with the collector of circular garbage at rest: there is none, and it would visit all pieces again and again."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row a document: id, ids (its tokens).

    The pattern is that of the public 50k vocabulary by default; another one has
    to begin a match at white space that follows other characters, too.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    data = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in _uncollected(batches):
            codec, at = codec or Codec(data.value, pattern), 0
            for texts in _groups(b.column(1).to_pylist(), lambda t: len(t or ""), TEXTS):
                ids = codec.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), ids], names=["id", "ids"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, ids array<int>")


def decode(tokens: DataFrame, *, id_col: str = "id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row a list of tokens: id, ids, decoded (bytes)."""
    data = _vocabulary(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or Codec(data.value, "")
            lists = pc.fill_null(b.column(1), pa.scalar([], pa.list_(pa.int32())))
            for at in range(0, len(lists), LISTS):
                part = lists.slice(at, LISTS)
                decoded = pa.array(codec.decode(pa.ListArray.from_arrays(part.offsets, part.values)), pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, LISTS) for c in b.columns), decoded], names=["id", "ids", "decoded"])

    return tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id bigint, ids array<int>, decoded binary")
