"""Helpers shared by the corpus operators: tables, ids and texts as they expect them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a NULL document id inside the operators: it sorts after every real id.
NO_ID = 2**63 - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(column: str = "doc_id") -> Column:
    """The id as a long; NULL becomes ``NO_ID`` so that joins and comparisons keep the row."""
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(NO_ID).cast("long"))


def id_of(column: str) -> Column:
    """The inverse of ``key_of``."""
    return F.when(F.col(column) != F.lit(NO_ID).cast("long"), F.col(column))


def raw_text(column: str = "text") -> Column:
    """UTF-8 bytes of a text; NULL becomes the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit("").cast("binary"))


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def table_of(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def row_mark(df: DataFrame) -> Column:
    """A 64-bit hash of all columns, in which a NULL counts in its place.

    What follows from a row's content alone holds for all rows of a mark.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def without_marks(df: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of ``df`` whose mark is not in ``marks`` (one column); rows and columns stay as they are."""
    name = "_mark"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    marked = df.withColumn(name, row_mark(df))
    gone = marks.toDF(name).distinct()
    return marked.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
