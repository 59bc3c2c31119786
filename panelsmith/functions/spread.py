"""Joins to a one-row-per-key table that stay balanced when one key holds much of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAX_HOT = 256


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` inner-joined with ``lookup`` (one row per key, ``count`` = rows it has in ``rows``).

    Keys holding at least 1/256 of all rows are hot. At most 256 keys can be, so their list is safe
    to broadcast. Rows of a hot key are salted over up to 256 tasks, against as many copies of its
    one lookup row; all other keys are joined as they are.
    """
    total = lookup.agg(F.sum(count)).first()[0] or 0
    share = max(1, total // _MAX_HOT)
    salts = F.ceil(F.col(count) / F.lit(share)).cast("int")
    hot = lookup.where(F.col(count) > F.lit(share)).select(key, salts.alias("_salts"))
    every_column = [F.col(f"`{c}`") for c in rows.columns]
    salted_rows = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*every_column), F.coalesce("_salts", F.lit(1))))
        .drop("_salts")
    )
    copies = F.when(F.col(count) > F.lit(share), salts).otherwise(F.lit(1))
    salted_lookup = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1))
    )
    return salted_rows.join(salted_lookup, [key, "_salt"]).drop("_salt")
