"""Projection, encoding and simple filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsmith.operators.stages import ColumnsEstimator, ColumnsTransformer, FittedColumns
from panelsmith.sources.tables import TableError, require_columns



def drop_columns_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; an absent one is an error (Spark's own ``drop`` would ignore it)."""
    require_columns(df, columns)
    return df.drop(*columns)


def drop_columns_if_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in (exclude or [])
    ]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in numeric_columns(df)])


def missing_indicators(df: DataFrame, columns: list[str], suffix: str = "_missing") -> DataFrame:
    """A 0/1 column per input column: 1 where it is NULL."""
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in columns})


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns)


def count_dropped(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """What :func:`drop_nulls` keeps and drops, as one row (n_kept, n_dropped)."""
    complete = F.lit(True)
    for c in columns or df.columns:
        complete = complete & F.col(f"`{c}`").isNotNull()
    return df.agg(F.count_if(complete).alias("n_kept"), F.count_if(~complete).alias("n_dropped"))


def normalize_names(df: DataFrame) -> DataFrame:
    """Names as unique, dot-free strings: dots become underscores, repeats get a number."""
    taken: set[str] = set()
    names = []
    for raw in df.columns:
        name = base = str(raw).replace(".", "_")
        number = 1
        while name.lower() in taken:
            number += 1
            name = f"{base}_{number}"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def concat_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two frames side by side, aligned by key; rows of ``left`` are all kept."""
    return left.join(right, keys, "left")


def concat_rows(top: DataFrame, bottom: DataFrame) -> DataFrame:
    return top.unionByName(bottom)


def forward_fill(
    df: DataFrame,
    entity: str,
    time: str,
    columns: list[str],
    width: int = 65_536,
    levels: int = 2,
) -> DataFrame:
    """Last non-null value so far, per entity in time order.

    ``time`` is an integer, unique per entity (see ``validate_panel``). A window covers at most
    ``width`` time steps of an entity: rows are filled inside (entity, time bucket), and what earlier
    buckets end with is carried in by the same procedure over one row per bucket. An entity holding
    a third of all rows is thereby spread over many tasks. Rows without entity or time are kept.
    """
    return _fill_from_earlier(df, entity, time, columns, width, levels, include_current=True)


def _fill_from_earlier(
    df: DataFrame,
    entity: str,
    time: str,
    columns: list[str],
    width: int,
    levels: int,
    include_current: bool,
) -> DataFrame:
    end = 0 if include_current else -1
    if levels <= 1:
        window = Window.partitionBy(entity).orderBy(time)
        window = window.rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})
    bucket = f"{time}_bucket"
    bucketed = df.withColumn(bucket, F.floor(F.col(time) / F.lit(width)))
    window = Window.partitionBy(entity, bucket).orderBy(time)
    window = window.rowsBetween(Window.unboundedPreceding, end)
    filled = bucketed.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})
    carried = {c: f"{c}_carried" for c in columns}
    ends = bucketed.groupBy(entity, bucket).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time))).alias(carried[c])
            for c in columns
        ]
    )
    starts = _fill_from_earlier(
        ends, entity, bucket, list(carried.values()), width, levels - 1, include_current=False
    )
    return (
        filled.join(starts, [entity, bucket], "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(carried[c])) for c in columns})
        .drop(bucket, *carried.values())
    )


class DropStrict(ColumnsTransformer):
    def _transform(self, df: DataFrame) -> DataFrame:
        return drop_columns_strict(df, self.getColumns())


class DropIfPresent(ColumnsTransformer):
    def _transform(self, df: DataFrame) -> DataFrame:
        return drop_columns_if_present(df, self.getColumns())


class DropNulls(ColumnsTransformer):
    """Rows with a NULL in any column, or in any of the given ones, are dropped."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return drop_nulls(df, self.getColumns() or None)


class NormalizeNames(ColumnsTransformer):
    def _transform(self, df: DataFrame) -> DataFrame:
        return normalize_names(df)


class MeanImputer(ColumnsEstimator):
    """NULL becomes the column mean; one aggregate fits all columns."""

    def _fit(self, df: DataFrame) -> MeanImputerModel:
        columns = self.getColumns()
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(columns)}
        empty = [c for c, m in means.items() if m is None]
        if empty:
            raise TableError(f"columns without any value cannot be imputed: {empty}")
        return MeanImputerModel(columns, means)


class MeanImputerModel(FittedColumns):
    def _transform(self, df: DataFrame) -> DataFrame:
        means = self.getValues()
        return df.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in self.getColumns()}
        )


class OneHot(ColumnsEstimator):
    """A 0/1 column ``<column>_<value>`` per distinct non-null value; the column itself is dropped.

    NULL and values unseen when fitting give zeros; existing columns of the same names are replaced.
    """

    def _fit(self, df: DataFrame) -> OneHotModel:
        columns = self.getColumns()
        if not columns:
            return OneHotModel(columns, {})
        sets = df.agg(
            *[F.collect_set(F.col(f"`{c}`").cast("string")).alias(f"v{i}") for i, c in enumerate(columns)]
        ).first()
        return OneHotModel(columns, {c: sorted(sets[f"v{i}"]) for i, c in enumerate(columns)})


class OneHotModel(FittedColumns):
    def _transform(self, df: DataFrame) -> DataFrame:
        for c, values in self.getValues().items():
            text = F.col(c).cast("string")
            encoded = {
                f"{c}_{v}": F.when(text == F.lit(v), 1).otherwise(0) for v in values
            }
            df = df.withColumns(encoded).drop(c)
        return df
