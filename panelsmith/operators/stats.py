"""The tables behind correlation, histogram and Q-Q plots."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.functions.ordering import repeat_rows, running_totals
from panelsmith.functions.scalar import normal_quantile
from panelsmith.session import cut_lineage, scratch_path


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are present; NULL, not an error, for a constant one."""
    spread = F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b))
    return F.try_divide(F.regr_sxy(a, b), spread)


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs in one aggregate: (i, j, feature_i, feature_j, r), i < j.

    Rows with a NULL in a pair are left out of that pair only. r is NULL for a constant column.
    """
    pairs = [(i, j) for j in range(len(columns)) for i in range(j)]
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    row = df.agg(
        *[
            pearson(x[i], x[j]).alias(f"r_{i}_{j}")
            for i, j in pairs
        ]
    )
    entries = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.lit(columns[i]).alias("feature_i"),
            F.lit(columns[j]).alias("feature_j"),
            F.col(f"r_{i}_{j}").alias("r"),
        )
        for i, j in pairs
    ]
    return row.select(F.inline(F.array(*entries)))


def correlated_columns(correlations: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Columns with |r| above the threshold against any earlier column; flagged columns flag too."""
    return (
        correlations.groupBy(F.col("feature_j").alias("feature"))
        .agg(F.max(F.abs("r")).alias("max_abs_r"))
        .where(F.col("max_abs_r") > F.lit(threshold))
    )


def kept_correlations(correlations: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Absolute correlations among the columns that :func:`correlated_columns` does not flag."""
    flagged = correlated_columns(correlations, threshold)
    kept = correlations
    for side in ("feature_i", "feature_j"):
        kept = kept.join(flagged.select(F.col("feature").alias(side)), side, "left_anti")
    return kept.select("feature_i", "feature_j", F.abs("r").alias("abs_r"))


def histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins on [min, max], the last one closed: (variable, bin, lower, upper, n).

    NULLs are skipped, empty bins are listed, a constant column gets the range +-0.5. One pass finds
    the ranges, one counts: each row is turned into its bin numbers, so only counts are shuffled.
    """
    row = df.agg(
        *[F.min(F.col(f"`{c}`").cast("double")).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(f"`{c}`").cast("double")).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    ranges = []
    for i, c in enumerate(columns):
        low, high = row[f"a{i}"], row[f"b{i}"]
        if low is not None:
            ranges.append((c, low, high) if low < high else (c, low - 0.5, high + 0.5))
    entries = []
    for c, low, high in ranges:
        x = F.col(f"`{c}`").cast("double")
        number = F.floor((x - F.lit(low)) / F.lit((high - low) / bins))
        number = F.least(F.greatest(number, F.lit(0)), F.lit(bins - 1)).cast("int")
        entries.append(
            F.struct(F.lit(c).alias("variable"), F.when(x.isNotNull(), number).alias("bin"))
        )
    edges = [
        (c, b, low + b * (high - low) / bins, low + (b + 1) * (high - low) / bins)
        for c, low, high in ranges
        for b in range(bins)
    ]
    spark = df.sparkSession
    frame = spark.createDataFrame(edges, "variable string, bin int, lower double, upper double")
    if not entries:
        return frame.withColumn("n", F.lit(0).cast("long"))
    counts = (
        df.select(F.inline(F.array(*entries)))
        .where("bin IS NOT NULL")
        .groupBy("variable", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return frame.join(counts, ["variable", "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """Ordered sample against normal quantiles at Filliben's medians: (rank, theoretical, sample).

    Equal values are grouped first, ranks come from running counts over value buckets, and each group
    is expanded to its ranks over many tasks; a value shared by a third of all rows is no hot spot.
    """
    x = F.col(f"`{column}`").cast("double")
    values = cut_lineage(
        df.where(x.isNotNull())
        .groupBy((x + 0.0).alias("sample"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(values, "sample", ["n"])
    points = repeat_rows(ranked, F.col("n"), "_i")
    rank = (F.col("cum_n") - F.col("n") + F.col("_i") + 1).cast("long")
    size = F.col("total_n").cast("double")
    top = F.pow(F.lit(0.5), F.lit(1.0) / size)
    median = (
        F.when(rank == F.col("total_n"), top)
        .when(rank == 1, F.lit(1.0) - top)
        .otherwise((rank.cast("double") - F.lit(0.3175)) / (size + F.lit(0.365)))
    )
    return points.select(
        rank.alias("rank"), normal_quantile(median).alias("theoretical"), "sample"
    )


def qq_line(points: DataFrame) -> DataFrame:
    """Least-squares line through the Q-Q points: (slope, intercept, r)."""
    return points.agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        pearson(F.col("theoretical"), F.col("sample")).alias("r"),
    )


def feature_names(model: PipelineModel) -> list[str] | None:
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            return stage.getInputCols()
    return None


def _named(model: PipelineModel, n_features: int) -> list[str]:
    return feature_names(model) or [f"Feature {i}" for i in range(n_features)]


def _top(df: DataFrame, n: int | None) -> DataFrame:
    ordered = df.orderBy(F.desc("importance"), "feature")
    return ordered if n is None else ordered.limit(n)


def feature_importance(spark: SparkSession, model: PipelineModel, top: int | None = None) -> DataFrame:
    """(feature, importance) of the last pipeline stage, greatest first; all, or the ``top`` ones."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        raise AttributeError(f"{type(last).__name__} has no feature importances")
    weights = last.featureImportances.toArray()
    rows = list(zip(_named(model, len(weights)), map(float, weights), strict=True))
    return _top(spark.createDataFrame(rows, "feature string, importance double"), top)


def split_count_importance(spark: SparkSession, model: PipelineModel, top: int | None = None) -> DataFrame:
    """(feature, importance): number of tree nodes that split on each feature used.

    The nodes are read from the saved form of the tree model, which is an ordinary table.
    """
    last = model.stages[-1]
    path = scratch_path(spark, "trees")
    last.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    names = list(enumerate(_named(model, last.numFeatures)))
    features = spark.createDataFrame(names, "feature_index int, feature string")
    counts = (
        nodes.where(F.col("nodeData.leftChild") >= 0)
        .groupBy(F.col("nodeData.split.featureIndex").alias("feature_index"))
        .agg(F.count(F.lit(1)).alias("importance"))
    )
    return _top(counts.join(features, "feature_index").select("feature", "importance"), top)
