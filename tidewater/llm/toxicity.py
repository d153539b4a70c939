"""Toxicity by multiple-instance learning.

Only documents are labelled. A document is a bag of sentences; a logistic
model of a sentence's words and of their first letters (which inflected and
invented forms share) gives its probability, and the document's is their
noisy-or: 1 - product of (1 - p). Features whose share of toxic documents
differs clearly from that of the others take part. The model is trained through the noisy-or on
a bounded sample of labelled documents, so that it learns which sentences make
a document toxic, and then scores every sentence of every document.

Null and empty texts have no sentence and score 0; of equally bad sentences the
first is the worst; very long texts are scored whole, sentence by sentence;
repeated rows score alike; without labels of both kinds every score is 0; an
empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORDS, labelled_sample

#: A sentence ends at these characters.
SENTENCE = re.compile(rb"[^.!?\n]+")
#: Documents of each label in the training sample, and features in the model, at most.
PER_CLASS, MAX_FEATURES = 4000, 20_000
#: Bytes of a word's start that are features, and the standard errors by which a feature's shares must differ.
STARTS, CLEAR = (4, 5, 6), 6.0


def features(text: bytes) -> set[bytes]:
    """The words of a sentence, and the starts of longer words, marked by a star."""
    own = set(text.translate(WORDS).split())
    for n in STARTS:
        own |= {w[:n] + b"*" for w in own if len(w) > n and w[-1] != 42}
    return own


def sentences(text: bytes | None) -> list[tuple[int, int, set[bytes]]]:
    """Start and end byte, and the features, of each sentence that has words."""
    out = []
    for m in SENTENCE.finditer(text or b""):
        own = features(m[0])
        if own:
            out.append((m.start(), m.end(), own))
    return out


def clear(rows: list[tuple[int, bytes]]) -> list[bytes]:
    """Features whose shares of toxic and other documents differ by more than CLEAR standard errors, clearest first."""
    total = Counter(y for y, _ in rows)
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for y, text in rows:
        seen[y].update(set().union(*(own for *_, own in sentences(text))))
    found = []
    for w in seen[0].keys() | seen[1].keys():
        share = (seen[0][w] + seen[1][w]) / len(rows)
        error = (share * (1 - share) * (1 / total[0] + 1 / total[1])) ** 0.5
        z = abs(seen[1][w] / total[1] - seen[0][w] / total[0]) / max(error, 1e-12)
        if z > CLEAR:
            found.append((-z, w))
    return [w for _, w in sorted(found)[:MAX_FEATURES]]


def fit(rows: list[tuple[int, bytes]], weight: dict[int, float], *, rounds: int = 300, rate: float = 0.1, pull: float = 1e-4) -> tuple[float, dict[bytes, float]]:
    """Bias and feature weights that maximise the likelihood of the labels of rows (label, text) under the noisy-or, by full-batch Adam with a pull of the weights to 0.

    Only the texts and the numbers of the kept features are held, not every sentence's features.
    """
    kept = clear(rows)
    number = {w: i for i, w in enumerate(kept)}
    of_bag, of_sentence, of_word, n = [], [], [], 0
    for b, (_, text) in enumerate(rows):
        for *_, own in sentences(text):
            of_bag.append(b)
            known = [number[w] for w in own & number.keys()]
            of_word += known
            of_sentence += [n] * len(known)
            n += 1
    of_bag, of_sentence, of_word = (np.array(x, np.int32) for x in (of_bag, of_sentence, of_word))
    y = np.array([label for label, _ in rows], float)
    scale = np.array([weight[int(label)] for label in y]) / len(rows)
    w, bias = np.zeros(len(kept)), -8.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(of_sentence, w[of_word], n), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(of_bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows))
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        # d loss / d z: p for clean bags, -p (1 - P) / P for toxic ones
        by_bag = np.where(y > 0, -np.exp(clean) / toxic, 1.0) * scale
        by_sentence = p * by_bag[of_bag]
        g = np.append(np.bincount(of_word, by_sentence[of_sentence], len(kept)) + pull * w, by_sentence.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, bias = w - step[:-1], bias - step[-1]
    return float(bias), {x: float(w[i]) for x, i in number.items()}


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 4, remainder: int = 2, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, dict[bytes, float]]:
    """The model from a sample of at most per_class labelled documents a class, fitted in one task."""
    sample, counts = labelled_sample(docs, labels, label, modulus=modulus, remainder=remainder, per_class=per_class, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
        rows = sorted(x for x in rows if x[1] and x[1].translate(WORDS).split())
        have = Counter(y for y, _ in rows)
        if len(have) < 2:
            return
        total = sum(counts.values())
        weight = {y: (counts[y] / total) / (have[y] / len(rows)) for y in have}
        bias, words = fit(rows, weight)
        yield pa.RecordBatch.from_arrays([pa.array([b"", *words], pa.binary()), pa.array([bias, *words.values()], pa.float64())], names=["word", "weight"])

    rows = sample.coalesce(1).mapInArrow(run, "word binary, weight double").collect()
    model = {bytes(r.word): r.weight for r in rows}
    return model.pop(b"", -30.0), model


def score(docs: DataFrame, model: tuple[float, dict[bytes, float]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, score, and its worst sentence (code points start, end; probability), null without sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("worst", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, words = shared.value
        for b in batches:
            rows = [(i, *judge(text, bias, words)) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, fields, strict=True)], schema=fields)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id bigint, score double, start int, end int, worst double")


def judge(text: bytes | None, bias: float, words: dict[bytes, float]) -> tuple[float, int | None, int | None, float | None]:
    """Noisy-or over the sentences, and the worst of them."""
    known, clean, best = words.keys(), 0.0, None
    plain = np.log1p(-1 / (1 + np.exp(-bias)))
    for start, end, own in sentences(text):
        hit = known & own
        if not hit:
            clean += plain
            z = bias
        else:
            z = max(-30.0, min(30.0, bias + sum(sorted(words[w] for w in hit))))
            clean += np.log1p(-1 / (1 + np.exp(-z)))
        if best is None or z > best[0]:
            best = (z, start, end)
    if best is None:
        return 0.0, None, None, None
    z, start, end = best
    at = len(text[:start].decode(errors="replace"))
    return float(-np.expm1(clean)), at, at + len(text[start:end].decode(errors="replace")), float(1 / (1 + np.exp(-z)))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose score stays under the threshold; all columns stay."""
    bias, words = train(docs, labels, id_col=id_col, text_col=text_col)
    shared, at = docs.sparkSession.sparkContext.broadcast((bias, words)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, words = shared.value
        for b in batches:
            texts = (None if t is None else t.encode() for t in b.column(at).to_pylist())
            yield b.filter(pa.array([judge(t, bias, words)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
