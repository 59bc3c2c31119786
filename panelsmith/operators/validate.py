"""Content checks and profiles of a panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsmith.sources.tables import TableError

_CHECKS = [
    "required_columns",
    "time_numeric",
    "label_numeric",
    "time_not_negative",
    "label_binary",
    "unique_entity_time",
]


def panel_violations(df: DataFrame, entity: str, time: str, label: str) -> DataFrame:
    """One row per check in the order it applies: (seq, check_name, n_bad).

    A check that cannot run because an earlier schema check failed is left out.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    absent = [c for c in (entity, time, label) if c not in types]
    schema_rows = [(0, _CHECKS[0], len(absent))]
    if not absent:
        numeric = {c: isinstance(types[c], T.NumericType) for c in (time, label)}
        schema_rows += [(1, _CHECKS[1], int(not numeric[time]))]
        schema_rows += [(2, _CHECKS[2], int(not numeric[label]))]
    result = spark.createDataFrame(schema_rows, "seq int, check_name string, n_bad long")
    if any(n for _, _, n in schema_rows):
        return result
    entries = [
        F.struct(
            F.lit(seq).alias("seq"),
            F.lit(_CHECKS[seq]).alias("check_name"),
            F.col(f"n{seq}").alias("n_bad"),
        )
        for seq in (3, 4)
    ]
    content = df.agg(
        F.count_if(F.col(time) < 0).alias("n3"),
        F.count_if(F.coalesce(~F.col(label).isin(0, 1), F.lit(True))).alias("n4"),
    ).select(F.inline(F.array(*entries)))
    duplicates = (
        df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
        .groupBy(entity, time)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("n_bad"))
        .select(F.lit(5).alias("seq"), F.lit(_CHECKS[5]).alias("check_name"), "n_bad")
    )
    return result.unionByName(content).unionByName(duplicates)


def validate_panel(df: DataFrame, entity: str, time: str, label: str) -> DataFrame:
    """``df`` itself, or an error naming the first violated check."""
    violated = panel_violations(df, entity, time, label).where("n_bad > 0").orderBy("seq").first()
    if violated is not None:
        raise TableError(f"check {violated['check_name']} failed: {violated['n_bad']} violations")
    return df


def shared_entities(df: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities that occur in more than one split."""
    pairs = df.select(entity, split).distinct()
    return pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("n_splits")).where("n_splits > 1")


def check_disjoint(df: DataFrame, entity: str, split: str) -> DataFrame:
    if not shared_entities(df, entity, split).isEmpty():
        raise TableError("some entities occur in more than one split")
    return df


def split_summary(df: DataFrame, entity: str, label: str, split: str = "split") -> DataFrame:
    """Rows, entities and share of entities that are ever positive, per split."""
    per_entity = df.groupBy(split, entity).agg(
        F.count(F.lit(1)).alias("n"), F.max(label).alias("ever")
    )
    return per_entity.groupBy(split).agg(
        F.sum("n").alias("n_rows"),
        F.count(entity).alias("n_entities"),
        F.avg(F.col("ever").cast("double")).alias("positive_rate"),
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") / total)


def profile_missing(df: DataFrame) -> DataFrame:
    """NULL count and percentage of every column that has any: (column_name, n_missing, pct)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_missing"))
        for i, c in enumerate(df.columns)
    ]
    return (
        counts.select("_rows", F.inline(F.array(*entries)))
        .where("n_missing > 0")
        .select(
            "column_name",
            "n_missing",
            (F.col("n_missing") * F.lit(100.0) / F.col("_rows")).alias("pct_missing"),
        )
    )


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Row-wise concatenation by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
