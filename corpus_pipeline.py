"""Corpus pipeline: the stages run in order over ``documents``, each on what the one before kept.

Every stage but the last takes and returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.llm import decontaminate, langid, packing, simhash, suffix_dedup
from panelsmith.llm.common import read
from panelsmith.session import drop_table, scratch_path, scratch_scope

ORACLE_SQL = None  # likelihoods, suffix classes and tokens have no SQL form; the stages are tested apart


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is uncertain, or which have no letters, go."""
    return langid.identified_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the least id."""
    return simhash.one_row_per_component(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; the document stays, ``n_chars`` follows its text."""
    out = suffix_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language identification", language_id),
    ("near-duplicate removal", near_dedup),
    ("repeated passages", passage_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is written once and read by the next.

    Of a stage only its output stays, until the next one has read it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage", keep=True)
        with scratch_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
