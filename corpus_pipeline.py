"""The corpus pipeline: five stages over documents, each by one operator of tidewater.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; the next stage
reads it from Parquet. All but the last return the columns of documents, and
further columns that come with documents; the last adds copies, size, taken and
target, which replace columns of those names.

Documents with a null or empty text pass all stages; the mix draws them like
others, though they add no words. Of rows that repeat a doc_id one stays; of
near-duplicates the smallest doc_id stays, and the mix breaks ties of rank by
doc_id. An empty table gives an empty result; very long texts are processed
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, lsh_forest, mixing, secret_scan, toxicity
from tidewater.llm.base import written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return lsh_forest.drop_near_duplicates(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the benchmark go; fewer hit words are cut out."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secret_scan.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of their copies; those it takes none of go."""
    return mixing.mix(docs, carry=True).filter("copies > 0").drop("source_size")


STAGES = [("toxicity", toxic), ("near_dedup", dedup), ("decontamination", decontaminated), ("secrets", secrets), ("mixing", mixed)]

#: Training, min-hashing and hash order are not expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
