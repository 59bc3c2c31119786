"""Entity-grouped, stratified splits that repeat for a seed in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.ordering import hash_rank
from panelsmith.functions.spread import spread_join
from panelsmith.session import cut_lineage
from panelsmith.sources.tables import SPLITS, TableError


def entity_stats(df: DataFrame, entity: str, time: str, label: str) -> DataFrame:
    """Per entity: greatest label and number of non-null times."""
    return df.groupBy(entity).agg(
        F.max(label).alias("max_label"), F.count(time).alias("n_times")
    )


def assign_splits(
    stats: DataFrame,
    entity: str,
    train_size: float = 0.7,
    val_size: float = 0.15,
    seed: int = 42,
    stratum: str | None = "max_label",
) -> DataFrame:
    """``stats`` with a ``split`` column: exact quotas of a seeded permutation, per stratum 0 and 1.

    Entities whose stratum is neither 0 nor 1 belong to no split.
    """
    if not 0 < train_size + val_size < 1:
        raise TableError("train_size + val_size must lie between 0 and 1")
    chosen = stats.where(F.col(stratum).isin(0, 1)) if stratum else stats
    ranked = hash_rank(chosen, entity, seed, [stratum] if stratum else None)
    n_train = F.floor(F.col("stratum_size").cast("double") * F.lit(float(train_size)))
    n_val = F.floor(F.col("stratum_size").cast("double") * F.lit(float(val_size)))
    split = (
        F.when(F.col("rank") <= n_train, SPLITS[0])
        .when(F.col("rank") <= n_train + n_val, SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return ranked.withColumn("split", split).drop("rank", "stratum_size")


def split_grouped(
    df: DataFrame,
    entity: str,
    label: str,
    train_size: float = 0.7,
    val_size: float = 0.15,
    seed: int = 42,
    stratify: bool = True,
) -> DataFrame:
    """All rows of ``df`` with the ``split`` of their entity.

    The entity table is materialised once: it feeds the ranks, the hot-entity list and the join.
    """
    df = df.withColumn(entity, F.col(entity).cast("string"))
    stats = cut_lineage(
        df.groupBy(entity).agg(
            F.max(label).alias("_max_label"), F.count(F.lit(1)).alias("_n_rows")
        )
    )
    assigned = assign_splits(
        stats, entity, train_size, val_size, seed, "_max_label" if stratify else None
    )
    return spread_join(df, assigned, entity, "_n_rows").drop("_max_label", "_n_rows")


def split_frames(df: DataFrame, split: str = "split") -> dict[str, DataFrame]:
    return {name: df.where(F.col(split) == name).drop(split) for name in SPLITS}


def semi_filter(df: DataFrame, keys: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is (or, with ``keep=False``, is not) among ``keys``.

    The different keys of a partition are hashed and the rows pass by, so a task holds keys, never sorted rows.
    """
    among = keys.select(key).distinct().hint("shuffle_hash")
    return df.join(among, key, "left_semi" if keep else "left_anti")


def feature_columns(df: DataFrame, label: str, keys: list[str]) -> list[str]:
    """Every column that is neither the label nor a key."""
    return [c for c in df.columns if c != label and c not in keys]


def split_xy(df: DataFrame, label: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Features and label as two keyed frames."""
    return df.select(*keys, *feature_columns(df, label, keys)), df.select(*keys, label)
