"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelsmith.llm import (
    chat_roles,
    decontaminate,
    langid,
    merkle,
    mixing,
    packing,
    quality,
    quality_rules,
    simhash,
    suffix_dedup,
    toxicity,
    vector_codes,
    wordpiece,
)
from panelsmith.llm.common import read
from panelsmith.llm.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(langid.document_evidence(read(spark, sf_dir, "documents"), "doc_id"))


@query("language_id_pages")
def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(langid.page_evidence(read(spark, sf_dir, "pages")))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_chat_format")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_roles.format_chats(read(spark, sf_dir, "conversations"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packing.tokenizer_path(f"{packing.VOCABULARY}.json")
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), path)


@query("op8_quality_rules", quality_rules.sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.contamination(*tables, slop=decontaminate.SLOP)


@query("op11_vector_codes", vector_codes.sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


@query("op12_merkle_manifest", merkle.sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(read(spark, sf_dir, "documents"))


@query("op13_mixing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))
