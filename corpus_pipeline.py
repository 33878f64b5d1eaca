"""Corpus pipeline: documents to training windows.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept. All but the last return the columns of documents.

1. ``quality``: documents whose probability of the highest grade is too low go (fitted on the labels of the given documents).
2. ``rules``: documents that fail a rule of the full policy go.
3. ``near_duplicates``: one document of each group of near-duplicates (five words, similarity 0.8) stays.
4. ``packing``: what is left is packed into windows of 1024 tokens with lexically similar neighbours.

Null and empty texts fail the rules (too few words), so they end there. Rows with a null id pass through; of rows that
repeat an id and a text one reaches the windows. Further columns are carried through the filters. Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.lineage import stored
from sensorloom.llm import minhash, packing, quality, rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rated = quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.selected(docs, quality.train(docs, rated))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_rows(docs, rules.POLICIES["full-1"])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, shingle=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("rules", rules_stage),
    ("near_duplicates", near_duplicates_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # the classifier, MinHash and the tokenizer have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
