"""License scans by a positional index of words weighted by rarity.

Licence templates are word lists with mandatory key phrases. A first pass
counts in how many documents each template word stands. Of each template the
words of highest IDF are indexed with their places, so many that no place with
the share of its weight that a match needs can do without some of them. The
second pass looks up each document's words, intersects the postings by relative
position of template and document, and where they weigh enough verifies the
place on all words and its key phrases, word for word. Fixed phrases are
labelled without any threshold.

Null and empty texts have no words and no labels; a template found at several
places gives one label; very long texts are read whole, and what is held beside
their words does not grow with them, as a place that a template has passed is
forgotten; words of equal IDF are indexed in their order, and templates with
equal labels give it once; repeated rows get equal results; an empty table gives
an empty result; other columns are not touched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import received, sent, words

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed licence templates: label, notice, key phrases that must stand in the matched place.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge to any person obtaining a copy",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "version 2 1")),
    ("lgpl-3.0", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license", "version 3")),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3")),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
)


def _templates(rows) -> list[tuple[str, list[bytes], list[list[bytes]]]]:
    return [(label, words(text.encode()), [words(k.encode()) for k in keys]) for label, text, keys in rows]


def word_counts(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents, and documents with each licence word: a row a word comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            counts[b""] += b.num_rows
            for text in b.column(0).to_pylist():
                counts.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts.pop(b"", 0), counts


def places(text: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    out, i, k = [], -1, len(phrase)
    while True:
        try:
            i = text.index(phrase[0], i + 1)
        except ValueError:
            return out
        if text[i : i + k] == phrase:
            out.append(i)


class Index:
    """Postings of each template's words of highest IDF, with their places in it.

    The words left out of the postings weigh less than half of the share that a
    match needs, so every place with that share has postings that agree on it
    and weigh the rest: `need`.
    """

    def __init__(self, templates, n_docs: int, counts: dict[bytes, int], share: float):
        self.templates, self.share = templates, share
        self.weight = {w: math.log((1 + n_docs) / (1 + counts.get(w, 0))) + 1 for _, t, _ in templates for w in t}
        self.postings: dict[bytes, list[tuple[int, int, float]]] = {}
        self.total = [sum(self.weight[w] for w in t) for _, t, _ in templates]
        self.need: list[float] = []
        for n, (_, text, _) in enumerate(templates):
            left = self.total[n]
            for i in sorted(range(len(text)), key=lambda i: (-self.weight[text[i]], i)):
                if left < share * self.total[n] / 2:
                    break
                self.postings.setdefault(text[i], []).append((n, i, self.weight[text[i]]))
                left -= self.weight[text[i]]
            self.need.append(share * self.total[n] - left - 1e-9)
        #: A template can stand at as many places that reach beyond a word as it has words; votes are cleared of others at twice that.
        self.room = 1000 + 2 * sum(len(t) for _, t, _ in templates)

    def agreement(self, text: list[bytes], n: int, at: int) -> float:
        """The share of a template's weight that stands in a text from a place on."""
        own = self.templates[n][1]
        first, last = max(0, -at), min(len(own), len(text) - at)
        return sum(self.weight[own[j]] for j in range(first, last) if text[at + j] == own[j]) / self.total[n]

    def match(self, text: list[bytes]) -> tuple[list[str], float]:
        """Labels of the templates found, and the largest share of a template's weight that its postings agree on or that was verified."""
        votes: dict[tuple[int, int], float] = {}
        labels, best = set(), 0.0
        for i, w in enumerate(text):
            for n, j, weight in self.postings.get(w, ()):
                got = votes.get((n, i - j), 0.0) + weight
                part = got / self.total[n]
                if got >= self.need[n]:
                    part, got = self.agreement(text, n, i - j), -math.inf  # looked at once
                    if part >= self.share:
                        label, own, keys = self.templates[n]
                        window = text[max(i - j, 0) : i - j + len(own)]
                        if label not in labels and all(places(window, k) for k in keys):
                            labels.add(label)
                best = max(best, part)
                votes[n, i - j] = got
            if len(votes) > self.room:
                votes = {(n, at): v for (n, at), v in votes.items() if at + len(self.templates[n][1]) > i}
        return sorted(labels), min(best, 1.0)


SCHEMA = "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double"
_FIELDS = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, share: float = 0.5) -> DataFrame:
    """One row a document: id, word count, places of the fixed phrases, labels, score (1 where a fixed phrase stands, else the best template's share)."""
    known = _templates(templates)
    n_docs, counts = word_counts(docs, text_col, frozenset(w for _, t, _ in known for w in t))
    shared = sent(docs.sparkSession, Index(known, n_docs, counts, share))
    phrases = [(words(p.encode()), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(shared)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = words(text)
                found = [(at, label) for p, label in phrases for at in places(own, p)]
                base = {label for _, label in found}
                labels, score = index.match(own)
                rows.append({"id": i, "n_words": len(own), "n_base": len(found), "first_word": min((x for x, _ in found), default=None), "last_word": max((x for x, _ in found), default=None), "base_labels": sorted(base), "labels": sorted(base | set(labels)), "score": 1.0 if base else score})
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
