"""Shared parts of the ``pyspark.ml`` stages: column lists and fitted values as saved params."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable


class HasColumns(Params):
    columns = Param(
        Params._dummy(), "columns", "columns to work on", TypeConverters.toListString
    )

    def getColumns(self) -> list[str]:
        return self.getOrDefault(self.columns)


class HasValues(Params):
    values = Param(Params._dummy(), "values", "fitted values, JSON-like")

    def getValues(self) -> dict:
        return self.getOrDefault(self.values)


class ColumnsTransformer(Transformer, HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer known by its column list alone."""

    def __init__(self, columns: list[str] | None = None) -> None:
        super().__init__()
        self._set(columns=list(columns or []))


class ColumnsEstimator(Estimator, HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, columns: list[str] | None = None) -> None:
        super().__init__()
        self._set(columns=list(columns or []))


class FittedColumns(Model, HasColumns, HasValues, DefaultParamsReadable, DefaultParamsWritable):
    """A model that consists of a column list and fitted values per column."""

    def __init__(self, columns: list[str] | None = None, values: dict | None = None) -> None:
        super().__init__()
        self._set(columns=list(columns or []), values=values or {})
