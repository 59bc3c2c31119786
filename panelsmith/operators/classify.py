"""Classifiers Spark ML lacks: Gaussian naive Bayes with priors and smoothing, and k nearest neighbours.

Both add ``prediction`` (int) and ``p1``, the probability of class 1.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.operators.neighbors import knn_join
from panelsmith.operators.stages import FittedColumns, HasColumns
from panelsmith.session import cut_lineage
from panelsmith.sources.tables import TableError


class _NaiveBayesParams(HasColumns):
    label = Param(Params._dummy(), "label", "label column, 0 or 1")
    varSmoothing = Param(Params._dummy(), "varSmoothing", "share of the greatest variance to add")
    priors = Param(Params._dummy(), "priors", "class probabilities, or None for those observed")


class GaussianNaiveBayes(
    Estimator, _NaiveBayesParams, DefaultParamsReadable, DefaultParamsWritable
):
    """Per class mean and variance of every column, out of one aggregate."""

    def __init__(
        self,
        columns: list[str] | None = None,
        label: str = "label",
        var_smoothing: float = 1e-9,
        priors: list[float] | None = None,
    ) -> None:
        super().__init__()
        self._set(columns=list(columns or []), label=label, varSmoothing=var_smoothing)
        self._set(priors=list(priors) if priors is not None else [])

    def _fit(self, df: DataFrame) -> GaussianNaiveBayesModel:
        columns, label = self.getColumns(), self.getOrDefault(self.label)
        x = [F.col(f"`{c}`").cast("double") for c in columns]
        rows = (
            df.where(F.col(label).isin(0, 1))
            .groupBy(F.col(label).cast("int").alias("c"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
                *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)],
            )
            .collect()
        )
        classes = {row["c"]: row for row in rows}
        if set(classes) != {0, 1}:
            raise TableError("naive Bayes needs rows of both classes")
        total = sum(row["n"] for row in rows)
        share = {c: row["n"] / total for c, row in classes.items()}
        epsilon = 0.0
        for i in range(len(columns)):
            # variance of the whole column from the class moments
            mean = sum(share[c] * classes[c][f"m{i}"] for c in (0, 1))
            spread = [classes[c][f"v{i}"] + (classes[c][f"m{i}"] - mean) ** 2 for c in (0, 1)]
            epsilon = max(epsilon, share[0] * spread[0] + share[1] * spread[1])
        epsilon *= self.getOrDefault(self.varSmoothing)
        priors = self.getOrDefault(self.priors) or [share[0], share[1]]
        if abs(sum(priors) - 1) > 1e-8 or len(priors) != 2:
            raise ValueError("priors must be two numbers that sum to 1")
        values = {
            "priors": list(priors),
            "means": [[classes[c][f"m{i}"] for i in range(len(columns))] for c in (0, 1)],
            "variances": [
                [classes[c][f"v{i}"] + epsilon for i in range(len(columns))] for c in (0, 1)
            ],
        }
        return GaussianNaiveBayesModel(columns, values)


class GaussianNaiveBayesModel(FittedColumns):
    def _log_likelihood(self, c: int) -> Column:
        fitted = self.getValues()
        means, variances = fitted["means"][c], fitted["variances"][c]
        prior = fitted["priors"][c]
        constant = math.log(prior) if prior > 0 else -math.inf
        constant -= 0.5 * sum(math.log(2 * math.pi * v) for v in variances)
        terms = [
            (F.col(f"`{name}`").cast("double") - F.lit(m))
            * (F.col(f"`{name}`").cast("double") - F.lit(m))
            / F.lit(2 * v)
            for name, m, v in zip(self.getColumns(), means, variances, strict=True)
        ]
        result = F.lit(constant)
        for term in terms:
            result = result - term
        return result

    def _transform(self, df: DataFrame) -> DataFrame:
        gap = self._log_likelihood(0) - self._log_likelihood(1)
        return (
            df.withColumn("_gap", gap)
            .withColumn("p1", F.lit(1.0) / (F.lit(1.0) + F.exp("_gap")))
            .withColumn("prediction", (F.col("_gap") < 0).cast("int"))
            .drop("_gap")
        )


def knn_votes(neighbors: DataFrame, id_col: str, label: str, weights: str = "distance") -> DataFrame:
    """(id, p1, prediction) from neighbour rows (id, distance, label).

    With distance weights a vote counts 1/d; where neighbours at distance 0 exist only those vote.
    A tie goes to class 0.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'")
    positive = F.col(label) == 1
    if weights == "uniform":
        p1 = F.count_if(positive).cast("double") / F.count(F.lit(1))
    else:
        at_zero = F.col("distance") == 0
        inverse = F.try_divide(F.lit(1.0), F.col("distance"))
        n_zero = F.count_if(at_zero)
        p1 = F.when(n_zero > 0, F.count_if(at_zero & positive).cast("double") / n_zero).otherwise(
            F.coalesce(F.sum(F.when(positive, inverse)), F.lit(0.0)) / F.sum(inverse)
        )
    return (
        neighbors.groupBy(id_col)
        .agg(p1.alias("p1"))
        .withColumn("prediction", (F.col("p1") > 0.5).cast("int"))
    )


def knn_classify(
    queries: DataFrame,
    train: DataFrame,
    id_col: str,
    vec_col: str,
    label: str,
    k: int = 5,
    weights: str = "distance",
    p: int = 2,
    exclude_self: bool = False,
) -> DataFrame:
    """(id, p1, prediction) of every query row from its k nearest training rows."""
    neighbors = knn_join(
        queries, train, id_col, vec_col, k, p, exclude_self, carry_neighbor=[label]
    )
    return knn_votes(neighbors, id_col, f"neighbor_{label}", weights)


class _KnnParams(HasColumns):
    label = Param(Params._dummy(), "label", "label column, 0 or 1")
    idCol = Param(Params._dummy(), "idCol", "unique row id")
    k = Param(Params._dummy(), "k", "number of neighbours")
    weights = Param(Params._dummy(), "weights", "uniform or distance")
    p = Param(Params._dummy(), "p", "Minkowski exponent, 1 or 2")


class KnnClassifier(Estimator, _KnnParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the training rows as a materialised table; scoring is a kNN join against it."""

    def __init__(
        self,
        columns: list[str] | None = None,
        label: str = "label",
        id_col: str = "id",
        k: int = 5,
        weights: str = "distance",
        p: int = 2,
    ) -> None:
        super().__init__()
        self._set(
            columns=list(columns or []), label=label, idCol=id_col, k=k, weights=weights, p=p
        )

    def _fit(self, df: DataFrame) -> KnnClassifierModel:
        kept = df.select(
            F.col(self.getOrDefault(self.idCol)).alias("id"),
            _vector(self.getColumns()),
            F.col(self.getOrDefault(self.label)).cast("int").alias("y"),
        )
        model = KnnClassifierModel(cut_lineage(kept, keep=True))
        return self._copyValues(model)


class KnnClassifierModel(Model, _KnnParams, MLWritable, MLReadable):
    def __init__(self, train: DataFrame | None = None) -> None:
        super().__init__()
        self.train = train

    def _transform(self, df: DataFrame) -> DataFrame:
        id_col = self.getOrDefault(self.idCol)
        queries = df.select(F.col(id_col).alias("id"), _vector(self.getColumns()))
        scores = knn_classify(
            queries,
            self.train,
            "id",
            "vec",
            "y",
            self.getOrDefault(self.k),
            self.getOrDefault(self.weights),
            self.getOrDefault(self.p),
        )
        return df.join(scores.withColumnRenamed("id", id_col), id_col)

    def write(self) -> MLWriter:
        return _KnnWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KnnReader()


class _KnnWriter(MLWriter):
    def __init__(self, model: KnnClassifierModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.train.write.parquet(f"{path}/train")


class _KnnReader(MLReader):
    def load(self, path: str) -> KnnClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KnnClassifierModel(self.sparkSession.read.parquet(f"{path}/train"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _vector(columns: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("vec")
