"""Reading and writing panels, split files, metrics, parameters and models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsmith.functions.scalar import nan_to_null

SPLITS = ("train", "val", "test")


class TableError(ValueError):
    """A table does not have the shape an operator needs."""


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TableError(f"required columns are absent: {missing}")


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: nan_to_null(c) for c in floating}) if floating else df


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    file_format: str | None = None,
    nan_as_null: bool = True,
) -> DataFrame:
    """Parquet or CSV (with header), NaN as NULL.

    Pass ``schema`` for large CSV files: without it Spark reads the file once more to infer types.
    Where a table is known to hold no NaN, ``nan_as_null=False`` lets filters on floating-point columns
    reach the parquet scan.
    """
    file_format = file_format or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.format(file_format)
    if file_format == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise FileNotFoundError(f"no table at {path}") from e
        raise
    return normalise_missing(df) if nan_as_null else df


def load_table(
    spark: SparkSession,
    path: str,
    entity: str,
    label: str,
    schema: T.StructType | str | None = None,
    file_format: str | None = None,
) -> DataFrame:
    """A panel with its entity key as string; the label may have at most two distinct values."""
    df = read_table(spark, path, schema, file_format)
    require_columns(df, [entity, label])
    values = df.where(F.col(label).isNotNull()).select(label).distinct().limit(3).count()
    if values > 2:
        raise TableError(f"column {label} has more than two distinct values")
    return df.withColumn(entity, F.col(entity).cast("string"))


def write_splits(
    df: DataFrame, folder: str, split: str = "split", file_format: str = "csv"
) -> dict[str, str]:
    """One table per split below ``folder``, written in one pass over ``df``.

    The ``split=<name>`` directories are plain tables of their own, without the split column.
    """
    writer = df.write.mode("overwrite").partitionBy(split).format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.save(folder)
    return {name: f"{folder.rstrip('/')}/{split}={name}" for name in SPLITS}


def load_splits(
    spark: SparkSession,
    paths: dict[str, str],
    entity: str,
    schema: T.StructType | str | None = None,
    file_format: str = "csv",
) -> dict[str, DataFrame]:
    """Train, validation and test tables: same column set, string keys, no shared entity."""
    frames = {
        name: read_table(spark, path, schema, file_format) for name, path in paths.items()
    }
    column_sets = {name: set(df.columns) for name, df in frames.items()}
    first = next(iter(column_sets.values()))
    if any(columns != first for columns in column_sets.values()):
        raise TableError("the split files have different columns")
    for df in frames.values():
        require_columns(df, [entity])
    frames = {
        name: df.withColumn(entity, F.col(entity).cast("string")) for name, df in frames.items()
    }
    tagged = None
    for name, df in frames.items():
        keys = df.select(entity).distinct().withColumn("split", F.lit(name))
        tagged = keys if tagged is None else tagged.unionByName(keys)
    shared = tagged.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not shared.isEmpty():
        raise TableError("some entities occur in more than one split")
    return frames


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON object per model; NULL values are kept as null."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """Best hyperparameters as one JSON object; lists and maps keep their structure."""
    row = spark.createDataFrame([_as_doubles(params)], schema=_params_schema(params))
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _as_doubles(params: dict) -> dict:
    """Entries of lists and maps as floats (None stays), keys of maps as strings."""

    def number(value: object) -> float | None:
        return None if value is None else float(value)

    def plain(value: object) -> object:
        if isinstance(value, dict):
            return {str(k): number(v) for k, v in value.items()}
        return [number(v) for v in value] if isinstance(value, (list, tuple)) else value

    return {k: plain(v) for k, v in params.items()}


def _params_schema(params: dict) -> T.StructType:
    def data_type(value: object) -> T.DataType:
        if isinstance(value, bool):
            return T.BooleanType()
        if isinstance(value, int):
            return T.LongType()
        if isinstance(value, float):
            return T.DoubleType()
        if isinstance(value, dict):
            return T.MapType(T.StringType(), T.DoubleType())
        if isinstance(value, (list, tuple)):
            return T.ArrayType(T.DoubleType())
        return T.StringType()

    return T.StructType([T.StructField(k, data_type(v)) for k, v in params.items()])


def model_path(folder: str, name: str) -> str:
    """Where the best model goes: ``best_model_<name>``, lower case, blanks as underscores."""
    return f"{folder.rstrip('/')}/best_model_{name.lower().replace(' ', '_')}"


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    path = model_path(folder, name)
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
