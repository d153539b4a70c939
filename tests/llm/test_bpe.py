"""Byte-pair encoding against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
import public_tokenizers
import pyarrow as pa
import tiktoken
from test_operators import LARGER, ODD, none, odd, table  # noqa: F401

from tidewater.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def decoded(codec, ids):
    return codec.decode(pa.array(ids, pa.list_(pa.int32())))


def check(rows, docs, library):
    assert len(rows) == len(docs)
    text = {d.doc_id: d.text or "" for d in docs}
    for r in rows:
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids), r.doc_id
        assert r.ids_sha256 == sha(" ".join(map(str, ids)).encode())
        assert r.decoded_sha256 == sha(text[r.doc_id].encode())


def test_given_table(spark, library):
    check(queries.op12_byte_bpe(spark, LARGER).collect(), table(spark, "documents", LARGER).collect(), library)


def test_odd_rows(spark, odd, none, library):  # noqa: F811
    got = {r.id: r for r in bpe.decode(bpe.encode(odd)).collect()}
    for i, text in ODD:
        assert got[i].ids == library.encode_ordinary(text or "") and bytes(got[i].decoded) == (text or "").encode()
    assert bpe.encode(odd).count() == len(ODD)
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_words_of_all_kinds(library):
    """Contractions, runs of one character, long words without spaces, white space of all kinds, and blocks that overflow."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    draw = random.Random(3)
    texts = ["don't  stop\n\n x\x1cy\x85z  ", "a" * 700, "ab" * 200 + "aba" * 100, "the" * 150, "<|endoftext|>", "日本" * 60]
    texts += ["".join(draw.choices("thein ers", k=600)), "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=900))]
    texts += ["".join(draw.choices(" \n\t'stla19!é　\xa0\x1c\U0001f600", k=4000)) for _ in range(3)]
    got = codec.encode(texts).to_pylist()
    assert got == [library.encode_ordinary(t) for t in texts]
    assert decoded(codec, got) == [t.encode() for t in texts]
    assert codec.encode(texts).to_pylist() == got  # now from what is kept


def test_blocks_and_kept_pieces(library, monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "TOKENS", 7)
    monkeypatch.setattr(bpe, "KEPT", 5)
    texts = [f"some words {i} and more of the same kind, number {i * i}" for i in range(30)] + [""]
    got = codec.encode(texts).to_pylist()
    assert got == [library.encode_ordinary(t) for t in texts]
    assert codec.encode(["some words"]).to_pylist() == [library.encode_ordinary("some words")] and len(codec.kept) == 2
    assert decoded(codec, got) == [t.encode() for t in texts]


def test_unknown_token(spark):
    tokens = spark.createDataFrame([(1, [5]), (2, None), (3, [60_000])], "id bigint, ids array<int>")
    assert bytes(bpe.decode(tokens.filter("id = 2")).first().decoded) == b""
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(tokens).collect()
