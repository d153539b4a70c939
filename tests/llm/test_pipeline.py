"""The corpus pipeline stage by stage against plain Python."""

from __future__ import annotations

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import toxicity
from tidewater.llm.base import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Name, what went in, what came out."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return {x[0]: x[1:] for x in out}


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
    for name, (before, after, columns, kept) in stages.items():
        assert len(after) <= len(before) and len(after) > 0
        assert kept[: len(columns)] == columns and (name == "mixing" or kept == columns)


def test_toxic_documents_go(spark, stages):
    before, after, *_ = stages["toxicity"]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] < 0.3}
    assert set(after) <= set(before)


def test_one_of_each_group_stays(stages):
    before, after, *_ = stages["near_dedup"]
    groups = brute.near([(r.doc_id, r.text) for r in before], 5)
    assert set(after) == {r for r in before if groups[r.doc_id][1] == r.doc_id}


def test_contaminated_documents_go(spark, stages):
    before, after, *_ = stages["decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    judged = brute.contamination([(r.doc_id, r.text) for r in before], [(i.item_id, i.text) for i in items])
    assert {r.doc_id for r in after} == {i for i, j in judged.items() if not j[-1]}
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        assert (r.text == texts[r.doc_id]) == (judged[r.doc_id][1] == 0)
    left = brute.contamination([(r.doc_id, r.text) for r in after], [(i.item_id, i.text) for i in items])
    assert sum(j[1] for j in left.values()) <= 13 * sum(1 for j in judged.values() if j[1] and not j[-1])


def test_secrets_are_replaced(stages):
    before, after, *_ = stages["secrets"]
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(texts)
    for r in after:
        found = brute.secrets(texts[r.doc_id])
        assert not brute.secrets(r.text) or r.text == texts[r.doc_id] and not found or all("[secret]" in r.text for _ in found)
        if found:
            assert texts[r.doc_id][found[0][0] : found[0][2]] not in r.text and r.n_chars == len(r.text)


def test_mix_follows_the_targets(stages):
    before, after, *_ = stages["mixing"]
    sizes: dict = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.SPACED.findall(r.text or ""))
    goal, got = brute.targets(sizes), {}
    for r in after:
        assert 1 <= r.copies <= 3
        got[r.source] = got.get(r.source, 0) + r.taken
    for s, t in goal.items():
        largest = max(len(brute.SPACED.findall(r.text or "")) for r in before if r.source == s)
        assert abs(got.get(s, 0) - t) <= largest / 2 + 1


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    want = stages["mixing"][1]
    assert sorted(map(str, got.collect())) == sorted(map(str, want))


def test_odd_documents_pass(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text here", "en", "a", 14), (3, "same text here", "en", "a", 14), (None, "no id at all", "en", "b", 12)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("id", F.lit(1))
    clashing = docs.selectExpr("*", "7 AS copies", "'s' AS size", "'t' AS taken", "'u' AS target", "'v' AS _id", "1 AS print")
    for rows in (docs, docs.limit(0), clashing):
        out = rows
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, out, SF), "odd")
            assert name == "mixing" or out.columns == rows.columns
        assert out.count() == len([r for r in out.collect() if r.copies > 0]) and out.count() <= 4
        assert len(set(out.columns)) == len(out.columns)
