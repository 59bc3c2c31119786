"""Places of rows in a global order, counted per group, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.session import cut_lineage


def with_places(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` inside its group) and ``total`` (rows of the group).

    ``group`` columns are not null; rows that tie in ``order`` are numbered in any order. The rows are sorted
    over all tasks by (group, order), so a group may hold any share of them; a table with one row per group
    and task turns places inside a task into places inside the group. ``rows`` is read twice (the bounds of
    the sort are sampled), so pass a written table.
    """
    keys = [F.col(g) for g in group]
    sort = [*keys, *(F.col(o) if isinstance(o, str) else o for o in order)]
    numbered = cut_lineage(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_id", 33))
    edges = numbered.groupBy(*group, "_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*group)
    before = every.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edges.select(
        *group,
        "_task",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(every).alias("total"),
    )
    placed = numbered.join(offsets, [*group, "_task"])
    return placed.withColumn("place", F.col("_id") + F.col("_shift")).drop("_id", "_task", "_shift")
