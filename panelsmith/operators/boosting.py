"""Boosted trees judged after every round, and cut where patience with the held-out rows runs out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.operators.evaluate import compare_models
from panelsmith.session import drop_table, scratch_path
from panelsmith.sources.tables import TableError

#: Whether a greater value is better.
METRICS = {"error": False, "logloss": False, "auc": True}


@dataclass
class _Tree:
    """Nodes by number; a leaf is its own child on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            low = x[rows, self.feature[at]] <= self.threshold[at]
            to = np.where(low, self.left[at], self.right[at])
            if (to == at).all():
                return self.value[at]
            at = to


def _trees(model: GBTClassificationModel, spark: SparkSession) -> list[_Tree]:
    """The trees of a model, which the driver holds anyway, from its saved form."""
    path = scratch_path(spark, "staged-trees")
    model.write().save(path)
    node = F.col("nodeData")
    rows = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            node["id"].alias("id"),
            node["prediction"].alias("value"),
            node["leftChild"].alias("left"),
            node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"),
            node["split"]["leftCategoriesOrThreshold"].alias("threshold"),
            node["split"]["numCategories"].alias("categories"),
        )
        .collect()
    )
    drop_table(spark, path)
    sizes = np.bincount([r["treeID"] for r in rows], minlength=model.getNumTrees)
    trees = [
        _Tree(np.zeros(n, np.int64), np.zeros(n), np.arange(n), np.arange(n), np.zeros(n)) for n in sizes
    ]
    for r in rows:
        tree, i = trees[r["treeID"]], r["id"]
        tree.value[i] = r["value"]
        if r["left"] >= 0:
            if r["categories"] >= 0:
                raise ValueError("staged scoring knows numeric features only")
            tree.left[i], tree.right[i] = r["left"], r["right"]
            tree.feature[i], tree.threshold[i] = r["feature"], r["threshold"][0]
    return trees


def staged_metrics(
    model: GBTClassificationModel, df: DataFrame, metric: str = "error"
) -> DataFrame:
    """(round, value): the metric of the first ``round`` trees on ``df``, for every round, ascending from 1.

    One scoring pass: a row's margins after every round are the running sums of its trees' votes. Error
    and logarithmic loss are added up per task, so a task passes on one row; the AUC counts rows by round
    and margin. Rows without a label are left out; without any labelled row the values are NULL.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    spark, label = df.sparkSession, model.getLabelCol()
    trees, weights = _trees(model, spark), np.array(model.treeWeights)
    n_rounds = len(trees)
    rows = df.where(F.col(label).isNotNull()).select(
        vector_to_array(model.getFeaturesCol()).alias("x"), F.col(label).cast("double").alias("y")
    )

    def margins(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        votes = np.stack([t.predict(x) for t in trees], axis=1) * weights
        return votes.cumsum(1), batch.column(1).to_numpy(zero_copy_only=False)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_rounds + 1)
        for batch in batches:
            if batch.num_rows:
                margin, y = margins(batch)
                if metric == "error":
                    loss = (margin > 0) != (y[:, None] == 1)
                else:  # the score is the logistic function of twice the margin
                    loss = np.logaddexp(0.0, -2 * margin * np.where(y == 1, 1, -1)[:, None])
                total += np.r_[len(y), loss.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["s"])

    def every_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margin, y = margins(batch)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(1, n_rounds + 1, dtype=np.int32), len(y))),
                        pa.array(margin.ravel()),
                        pa.array(np.repeat(y, n_rounds)),
                    ],
                    names=["round", "s", "y"],
                )

    if metric == "auc":
        long = rows.mapInArrow(every_round, "round int, s double, y double")
        above = (F.col("s") > 0).cast("int")
        areas = compare_models(long.withColumn("z", above), "round", "y", "z", "s").areas
        return (
            spark.range(1, n_rounds + 1)
            .select(F.col("id").cast("int").alias("round"))
            .join(areas.select("round", F.col("auc").alias("value")), "round", "left")
            .orderBy("round")
        )
    partial = rows.mapInArrow(sums, "s array<double>")
    added = partial.groupBy(F.lit("all")).agg(Summarizer.sum(array_to_vector("s")).alias("s")).first()
    n, *losses = added["s"].toArray().tolist() if added else [0.0] * (n_rounds + 1)
    values = [(i, loss / n if n else None) for i, loss in enumerate(losses, 1)]
    return spark.createDataFrame(values, "round int, value double").orderBy("round")


def best_round(values: list[float], patience: int, greater_is_better: bool = False) -> int:
    """The round (from 1) to keep: the best one seen when ``patience`` rounds have brought nothing better."""
    best = 0
    for i, value in enumerate(values):
        if value > values[best] if greater_is_better else value < values[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` trees."""
    if not 1 <= n <= model.getNumTrees:
        raise ValueError(f"a model of {model.getNumTrees} trees has no first {n}")
    java, context = model._java_obj, SparkSession.active().sparkContext
    ml, gateway = context._jvm.org.apache.spark.ml, context._gateway
    trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = ml.classification.GBTClassificationModel(
        java.uid(), trees, weights, java.numFeatures(), java.numClasses()
    )
    return model._copyValues(GBTClassificationModel(cut))


class PatientBoosting(Estimator):
    """Boosting that stops after ``patience`` rounds without a better ``metric`` on held-out rows.

    Rows with a true ``validation`` column are held out. Spark grows all rounds; the model is cut at the
    best one, found from one scoring pass, so it equals training that stops there. Ties keep the
    earlier round. ``staged`` holds the values per round of the last fit.
    """

    def __init__(
        self, trees: GBTClassifier, validation: str, patience: int = 20, metric: str = "error"
    ) -> None:
        super().__init__()
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {sorted(METRICS)}")
        if patience < 1:
            raise ValueError("patience must be at least 1")
        self.trees, self.validation, self.patience, self.metric = trees, validation, patience, metric
        self.staged: list[float] = []

    def _fit(self, df: DataFrame) -> GBTClassificationModel:
        held = F.coalesce(F.col(self.validation), F.lit(False))
        model = self.trees.fit(df.where(~held))
        rows = staged_metrics(model, df.where(held), self.metric).collect()  # one row per round
        self.staged = [r["value"] for r in rows]
        if None in self.staged:
            raise TableError(f"the held-out rows give no {self.metric}")
        return first_rounds(model, best_round(self.staged, self.patience, METRICS[self.metric]))
