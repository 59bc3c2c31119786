"""Ranks, running totals and expansions that never put one unbounded group into one task.

A plain ``row_number() over (order by …)`` sorts the whole table in a single task. The helpers here
cut the order into many buckets, total each bucket (pre-aggregated on the map side), turn the small
table of bucket totals into offsets and rank only inside the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions.scalar import hash_key


def hash_rank(
    df: DataFrame,
    id_col: str,
    seed: int,
    strata: list[str] | None = None,
    rank: str = "rank",
    size: str = "stratum_size",
) -> DataFrame:
    """Seeded random permutation: 1-based rank by (md5(id:seed), id) and the size, per stratum.

    md5 spreads ids evenly over the buckets, so a stratum may hold any share of the rows; there are
    about as many buckets as rows in one. The join and the window share one shuffle on (strata, bucket).
    """
    strata = strata or []
    digits = 1 + int(math.log(max(df.count(), 1), 256))
    keyed = df.withColumn("_key", hash_key(id_col, seed)).withColumn(
        "_bucket", F.substring("_key", 1, digits)
    )
    totals = keyed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    stratum = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    before = stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *strata,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(stratum).alias(size),
    )
    local = Window.partitionBy(*strata, "_bucket").orderBy("_key", id_col)
    return (
        keyed.join(offsets, [*strata, "_bucket"])
        .withColumn(rank, F.col("_offset") + F.row_number().over(local))
        .drop("_key", "_bucket", "_offset")
    )


def _quantile_cuts(df: DataFrame, key: str, n_buckets: int) -> list[float]:
    points = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.agg(F.percentile_approx(key, points, 10 * n_buckets).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def bucket_by_value(df: DataFrame, key: str, n_buckets: int, bucket: str) -> DataFrame:
    """Number of the approximate-quantile interval ``key`` falls into, ascending.

    The cuts steer only the balance of the buckets. Results stay exact for any cuts.
    """
    cuts = _quantile_cuts(df, key, n_buckets)
    if not cuts:
        return df.withColumn(bucket, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    binned = Bucketizer(splits=splits, inputCol=key, outputCol=bucket, handleInvalid="keep")
    return binned.transform(df).withColumn(bucket, F.col(bucket).cast("int"))


def running_totals(
    df: DataFrame,
    key: str,
    values: list[str],
    descending: bool = False,
    n_buckets: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sum ``cum_<v>`` of each value in the order of ``key``, and ``total_<v>``.

    With ``by`` every group has its own order and totals; all groups share the buckets, whose cuts come
    from the rows of all of them, so no (group, bucket) holds more than a bucket does.

    ``key`` is a double, unique per row of a group: group by it first; ``by`` is without NULL. ``df`` is read several times, so pass a
    materialised table. The result also has the column ``key_bucket`` (see :func:`next_in_order`). By
    default both the number of buckets and the rows in one grow with the square root of the rows.
    """
    direction = F.desc if descending else F.asc
    every = Window.partitionBy(F.lit(0), *by)
    if n_buckets is None:
        n_buckets = max(1, math.isqrt(df.count()) // 8)
    bucketed = bucket_by_value(df, key, n_buckets, "key_bucket")
    sums = bucketed.groupBy(*by, "key_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = every.orderBy(direction("key_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by,
        "key_bucket",
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(every).alias(f"total_{v}") for v in values],
    )
    inside = Window.partitionBy(*by, "key_bucket").orderBy(direction(key))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.join(offsets, [*by, "key_bucket"])
        .withColumns({f"cum_{v}": F.col(f"_o_{v}") + F.sum(v).over(upto) for v in values})
        .drop(*[f"_o_{v}" for v in values])
    )


def next_in_order(
    df: DataFrame, key: str, value: Column, name: str, descending: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """``value`` of the following row in the order of ``key``, NULL for the last row (of its group).

    ``df`` comes from :func:`running_totals` with the same ``by``. Inside a bucket this is a window; across buckets it is the
    first row of the next bucket, from a table with one row per bucket.
    """
    direction = F.desc if descending else F.asc
    every = Window.partitionBy(F.lit(0), *by)
    valued = df.withColumn("_value", value)
    first = F.max_by if descending else F.min_by
    heads = valued.groupBy(*by, "key_bucket").agg(first("_value", key).alias("_head"))
    following = every.orderBy(direction("key_bucket"))
    next_heads = heads.select(*by, "key_bucket", F.lead("_head").over(following).alias("_next_head"))
    inside = Window.partitionBy(*by, "key_bucket").orderBy(direction(key))
    return (
        valued.join(next_heads, [*by, "key_bucket"])
        .withColumn(name, F.coalesce(F.lead("_value").over(inside), "_next_head"))
        .drop("_value", "_next_head")
    )


def repeat_rows(df: DataFrame, times: Column, index: str, chunk: int = 65_536) -> DataFrame:
    """Each row ``times`` times, with a 0-based ``index``; rows with ``times`` <= 0 vanish.

    Expands in two steps with a shuffle in between, so that one row with a huge count is spread over
    the cluster and no single array exceeds ``chunk`` entries by much.
    """
    wide = (
        df.withColumn("_times", times.cast("long"))
        .where(F.col("_times") > 0)
        .withColumn(
            "_start", F.explode(F.expr(f"sequence(0L, _times - 1, CAST({chunk} AS BIGINT))"))
        )
    )
    return (
        wide.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in wide.columns]))
        .withColumn(
            index,
            F.explode(F.expr(f"sequence(_start, least(_start + {chunk}, _times) - 1, 1L)")),
        )
        .drop("_times", "_start")
    )
