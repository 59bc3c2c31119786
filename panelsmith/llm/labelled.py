"""Bounded samples of labelled documents, and the held-out rule of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import raw_text


def remainder(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids are never held out nor learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(folds)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """``text`` and ``y`` of about ``rows`` labelled documents (all, if there are fewer).

    Only rows outside the held-out fold. The choice goes by a hash of the id, so at most about ``rows``
    labels are broadcast, whatever the size of the tables. Ids labelled twice with different values are
    left out, and so are NULL labels.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(folds) != held_out))
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("_y"))
        .where("y = _y")
        .select("doc_id", F.col("y").cast("int").alias("y"))
    )
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < (rows << 20) // total)
    return (
        docs.select("doc_id", raw_text().alias("text"))
        .join(F.broadcast(known), "doc_id")
        .select("text", "y")
    )
