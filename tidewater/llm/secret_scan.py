"""Secret scans: fixed formats, and a token-efficiency test for random strings.

A byte-pair vocabulary packs ordinary text into few tokens and random strings
into many. A word-like run of characters with few characters to a token is
taken for a random string, unless it is a known identifier or digest: UUIDs,
plain hexadecimal of the usual digest lengths, numbers, and strings listed by
the caller. Runs of letters alone are tested where their case changes as in no
word, and must be denser in tokens; runs of letters of one case are not, as
rare words look the same.

Null and empty texts have no spans; positions are code points; the time grows
with a text's length; spans that start at one place stand in the order of KINDS;
repeated rows get equal results; an empty table gives an
empty result; other columns are not touched.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed formats, in the order in which kinds at one place are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
#: A candidate for the test: a run of at least this many characters, with a letter and either a digit or several capitals after small letters.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER, RISE = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z][A-Z].*[a-z][A-Z]", re.S)
#: Characters a token under which a run with digits, and one without, is random: 99.9 % of random letters of both cases are under 2.
RATIO, LETTERS = 2.2, 2.0
#: Identifiers and digests that are no secrets: UUID; MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal; hexadecimal numbers.
KNOWN = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:sha(?:1|224|256|384|512)[-_:]?|md5[-_:]?)?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})|0[xX][0-9a-fA-F]+|[0-9]+(?:[-_/=+][0-9]+)*[-_/=+]?")
#: Runs longer than this are encoded in pieces of this size, which keeps the merge loop linear.
PIECE = 256
#: Limit on the vocabulary file that is broadcast, in bytes.
VOCAB_BYTES = 16 << 20


def vocabulary_path() -> str:
    """The public byte-level vocabulary of 50k ranks, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _ranks(spark: SparkSession, path: str | None) -> bytes:
    """The vocabulary file's bytes, read once by the driver."""
    with open(path or vocabulary_path(), "rb") as f:
        data = f.read(VOCAB_BYTES + 1)
    if len(data) > VOCAB_BYTES:
        raise ValueError(f"{path} has more than {VOCAB_BYTES} bytes")
    return data


def encoder(data: bytes) -> Callable[[str], int]:
    """A function that counts the tokens of a string under the vocabulary."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    own = tiktoken.Encoding("scan", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return lambda s: sum(len(own.encode_ordinary(s[i : i + PIECE])) for i in range(0, len(s), PIECE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats: leftmost, non-overlapping by kind; failing matches are dropped without another try."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24] if _has_hex(text) else []
    return sorted(out)


#: A run of 24 is found quickly by this before each run of a text is visited; runs are maximal in both.
LONG_HEX = re.compile(r"[0-9a-f]{24}")


def _has_hex(text: str) -> bool:
    return LONG_HEX.search(text) is not None


def random_spans(text: str, taken: list[tuple[int, int, int]], count: Callable[[str], int], ratio: float, known: frozenset[str]) -> list[tuple[int, int, int]]:
    """Runs with fewer than `ratio` characters a token that are no known identifier and overlap no fixed format (`taken`, in order)."""
    out, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][2])
            k += 1
        run = m[0]
        limit = ratio if DIGIT.search(run) else min(ratio, LETTERS) if RISE.search(run) else 0.0
        if reach <= m.start() and limit and LETTER.search(run) and not KNOWN.fullmatch(run) and run not in known and len(run) < limit * count(run):
            out.append((m.start(), 3, m.end()))
    return out


FOUND = "array<struct<start:int,kind:int,end:int>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _spans(data: bytes, ratio: float, known: frozenset[str]) -> Callable[[Iterable[str | None]], Iterator[list[tuple[int, int, int]]]]:
    # the encoder is built for the first run that needs it
    held: list[Callable[[str], int]] = []

    def count(run: str) -> int:
        if not held:
            held.append(encoder(data))
        return held[0](run)

    def run(texts: Iterable[str | None]) -> Iterator[list[tuple[int, int, int]]]:
        for t in texts:
            found = base_spans(t) if t else []
            yield sorted(found + random_spans(t, found, count, ratio, known)) if t else found

    return run


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ratio: float = RATIO, known: Iterable[str] = ()) -> DataFrame:
    """One row a document: id and spans, an array of (start, kind number in KINDS, end)."""
    data = docs.sparkSession.sparkContext.broadcast(_ranks(docs.sparkSession, vocabulary))
    known = frozenset(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _spans(data.value, ratio, known)
        for b in batches:
            found = [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in find(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _FOUND)], names=["id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id bigint, spans {FOUND}")


def redact_secrets(docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None, ratio: float = RATIO, known: Iterable[str] = (), mark: str = "[secret]") -> DataFrame:
    """docs with every span of their texts replaced by the mark; n_chars, if there, follows. Overlapping spans become one mark."""
    data = docs.sparkSession.sparkContext.broadcast(_ranks(docs.sparkSession, vocabulary))
    known, at = frozenset(known), docs.columns.index(text_col)

    def clean(text: str, found: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for s, _, e in found:
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _spans(data.value, ratio, known)
        for b in batches:
            texts, columns = b.column(at).to_pylist(), list(b.columns)
            left = [clean(t, f) if f else t for t, f in zip(texts, find(texts), strict=True)]
            columns[at] = pa.array(left, b.schema.field(at).type)
            if count_at is not None:
                counts = [n if t is u else len(u) for n, t, u in zip(columns[count_at].to_pylist(), texts, left, strict=True)]
                columns[count_at] = pa.array(counts, b.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
