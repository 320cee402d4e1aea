"""Documents to training tokens: five stages, each on all that the one before it kept.

1. quality: the factorisation machine drops the rows that it rejects.
2. exact: of equal texts one row stays.
3. near: of texts linked by a similarity of 5-word shingles of 0.8 or more one row stays.
4. benchmark: rows that hold a benchmark item at an edit similarity of 0.8 or more go.
5. tokens: BPE ids, their decoding, and digests of both.

Stages 1 to 4 return the columns of documents. Each result is written as Parquet and read again.

Null text counts as empty; a text without words is linked with nothing and holds no item, so such rows meet stages 1, 2 and 5
alone. Rows with a null id are judged by their texts like others. Of rows that are equal in id and text one stays after
stage 2; of equal texts the largest id stays, of linked texts the smallest. Empty tables give empty results, without
labels every row scores 0.5 or near it and goes. Texts of any length are handled whole. Further columns pass through stages 1 to 4, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bindscape.llm import bpe_automaton, cgk_decontam, common, extendible_dedup, jaccard_join, quality_fm


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_fm.keep_good(docs, quality_fm.train(docs, common.table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return extendible_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cgk_decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.bpe_digests(docs, bpe_automaton.default_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: The classifier and the edit search have no SQL; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
