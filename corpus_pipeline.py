"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each group of near copies stays.
3. repeated_passages: sentences of repeated spans are cut out of text.
4. contamination: documents that hold too much of the benchmark go.
5. packing: what is left is tokenised and packed into sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the
shared folder and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, jaccard_join, packing, substring_dedup
from sparkloom.llm import quality as classifier
from sparkloom.llm.common import held, release, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contamination", contamination),
    ("packing", pack),
]

#: The classifier's weights and the tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), held()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before, docs)  # the stage's own tables, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
