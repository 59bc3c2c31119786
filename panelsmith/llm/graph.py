"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones) are linked to its least neighbour."""
    if large:
        pairs = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = links
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, pairs["u"] == least["u_"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("u_").alias("u"), F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v: longs, any order) -> ``node``, ``root``: the least node of its component.

    Large and small stars in turn, until every node hangs on its component's least node; the number
    of rounds grows with the logarithm of the longest path. Nodes without links are not returned.
    Every round is written to the shared folder, and only one number per round comes to the driver.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links, seen = cut_lineage(links.distinct()), None
    while True:
        links = cut_lineage(_star(_star(links, True), False))
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
