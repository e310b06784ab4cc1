"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, embedding_dedup, jaccard_join, packing, quality, quotes, substring_dedup, suffix_dedup, url_filter, warc
from sparkloom.llm.common import table
from sparkloom.llm.oracles import ORACLES
from sparkloom.llm.spans import NULL_ID

#: doc_id, with the stand-in of a null id taken back
DOC = f"CASE WHEN doc_id > {NULL_ID + 1} - 1 THEN doc_id END AS doc_id"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.selectExpr(DOC, "start AS start_word", "end AS end_word", "end - start AS n_words")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.selectExpr(DOC, "start AS start_byte", "end AS end_byte")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    held = [
        op1_suffix_array_dedup,
        op2_quotation_linking,
        op3_url_filters,
        op4_benchmark_decontamination,
        op5_warc_derivatives,
        op6_jaccard_join,
        op7_packing,
        op8_embedding_dedup,
        op9_substring_dedup,
        op10_quality_classifier,
    ]
    return {f.__name__: f for f in held}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
