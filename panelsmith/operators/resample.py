"""Synthetic minority oversampling, neighbourhood cleaning and class weights."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.ordering import hash_rank, repeat_rows
from panelsmith.functions.scalar import hash_key, hash_uniform
from panelsmith.operators.neighbors import knn_join
from panelsmith.operators.stages import FittedColumns
from panelsmith.session import cut_lineage
from panelsmith.sources.tables import TableError


def _class_sizes(df: DataFrame, label: str) -> dict[int, int]:
    rows = df.where(F.col(label).isNotNull()).groupBy(label).count().limit(3).collect()
    if len(rows) != 2:
        raise TableError(f"column {label} must have exactly two classes")
    return {row[label]: row["count"] for row in rows}


def _minority(sizes: dict[int, int]) -> int:
    return min(sizes, key=lambda c: (sizes[c], -c))


def smote(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    label: str,
    ratio: float,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """``df`` plus int(ratio * n_majority - n_minority) synthetic minority rows.

    Returns (id, vec, label, synthetic_no). Original rows have no synthetic_no, synthetic rows no id.
    Each lies on the segment between a minority row and one of its k nearest minority rows; base rows
    take turns in a seeded order, the neighbour and the place on the segment come from
    md5(base id:synthetic_no:seed).
    """
    sizes = _class_sizes(df, label)
    minority = _minority(sizes)
    n_minority = sizes[minority]
    n_majority = sum(sizes.values()) - n_minority
    n_synthetic = int(n_majority * ratio - n_minority)
    if n_synthetic <= 0:
        raise TableError(f"ratio {ratio} does not exceed the present class ratio")
    if n_minority <= k:
        raise TableError(f"{n_minority} minority rows have no {k} neighbours each")

    rows = df.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col), label)
    base = rows.where(F.col(label) == F.lit(minority))
    neighbors = (
        knn_join(base, base, id_col, vec_col, k, exclude_self=True, carry_neighbor=[vec_col])
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("rank", f"neighbor_{vec_col}"))).alias("_near"))
    )  # k entries per row
    turns = hash_rank(base, id_col, seed, rank="_turn", size="_n").join(neighbors, id_col)
    turn = F.col("_turn") - 1
    times = F.lit(n_synthetic // n_minority) + (turn < n_synthetic % n_minority).cast("long")
    drawn = (
        repeat_rows(turns, times, "_i")
        .withColumn("synthetic_no", F.col("_i") * n_minority + turn)
        .withColumn("_key", hash_key(id_col, seed, "synthetic_no"))
        .withColumn("_pick", F.floor(hash_uniform(F.col("_key"), 1) * k).cast("int"))
        .withColumn("_u", hash_uniform(F.col("_key"), 9))
        .withColumn("_to", F.col("_near")[F.col("_pick")][f"neighbor_{vec_col}"])
    )
    synthetic = drawn.select(
        F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col),
        F.zip_with(vec_col, "_to", lambda x, y: x + F.col("_u") * (y - x)).alias(vec_col),
        label,
        "synthetic_no",
    )
    return rows.withColumn("synthetic_no", F.lit(None).cast("long")).unionByName(synthetic)


def edited_nearest_neighbours(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    label: str,
    k: int = 3,
    candidates: str = "not_minority",
) -> DataFrame:
    """``df`` without the rows that have a neighbour of another class among their k nearest.

    Only majority rows can be dropped, or any row with ``candidates="all"``.
    """
    if candidates not in ("not_minority", "all"):
        raise ValueError("candidates must be 'not_minority' or 'all'")
    queries = df
    if candidates == "not_minority":
        queries = df.where(F.col(label) != F.lit(_minority(_class_sizes(df, label))))
    neighbors = knn_join(
        queries,
        df,
        id_col,
        vec_col,
        k,
        exclude_self=True,
        carry_query=[label],
        carry_neighbor=[label],
    )
    mixed = neighbors.where(F.col(label) != F.col(f"neighbor_{label}")).select(id_col).distinct()
    return df.join(mixed, id_col, "left_anti")


def smote_enn(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    label: str,
    ratio: float,
    k_smote: int = 5,
    k_enn: int = 3,
    seed: int = 42,
) -> DataFrame:
    """SMOTE, then cleaning of the enlarged set. ``row_key`` identifies original and synthetic rows."""
    enlarged = smote(df, id_col, vec_col, label, ratio, k_smote, seed).withColumn(
        "row_key",
        F.coalesce(
            F.concat(F.lit("r:"), F.col(id_col).cast("string")),
            F.concat(F.lit("s:"), F.col("synthetic_no").cast("string")),
        ),
    )
    return edited_nearest_neighbours(cut_lineage(enlarged), "row_key", vec_col, label, k_enn)


class ClassWeights(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Row weights by class: n / (2 n_class) if "balanced", an explicit weight per class, or 1."""

    label = Param(Params._dummy(), "label", "label column")
    weights = Param(Params._dummy(), "weights", "balanced, a weight per class, or empty for 1")
    column = Param(Params._dummy(), "column", "name of the weight column")

    def __init__(
        self,
        label: str = "label",
        weights: str | dict[int, float] | None = "balanced",
        column: str = "weight",
    ) -> None:
        super().__init__()
        self._set(label=label, weights=weights or {}, column=column)

    def _fit(self, df: DataFrame) -> ClassWeightsModel:
        label, weights = self.getOrDefault(self.label), self.getOrDefault(self.weights)
        if weights == "balanced":
            sizes = _class_sizes(df, label)
            n = sum(sizes.values())
            weights = {c: n / (2 * size) for c, size in sizes.items()}
        by_class = {str(c): float(w) for c, w in weights.items()}
        return ClassWeightsModel([label, self.getOrDefault(self.column)], by_class)


class ClassWeightsModel(FittedColumns):
    """Rows to be scored may come without the label; their weight is 1."""

    def _transform(self, df: DataFrame) -> DataFrame:
        label, column = self.getColumns()
        expression = F.lit(1.0)
        if label in df.columns:
            for c, w in self.getValues().items():
                expression = F.when(F.col(label) == F.lit(int(c)), F.lit(w)).otherwise(expression)
        return df.withColumn(column, expression)


def class_weights(
    df: DataFrame,
    label: str,
    weights: str | dict[int, float] | None = "balanced",
    column: str = "weight",
) -> DataFrame:
    return ClassWeights(label, weights, column).fit(df).transform(df)
