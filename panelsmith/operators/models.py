"""Model training on assembled columns with Spark ML, and scoring."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.scalar import above
from panelsmith.operators.classify import GaussianNaiveBayes, KnnClassifier
from panelsmith.operators.scale import StandardScaler

FEATURES = "features"
#: Rows per partition of a training table, and its least number of partitions.
ORDERED_ROWS, ORDERED_PARTITIONS = 50_000, 16
_MAX_DEPTH = 30  # the deepest tree Spark grows


def fixed_order(df: DataFrame) -> DataFrame:
    """``df`` dealt out and sorted by its content.

    Tree sampling goes by partition and row number. The partitions here follow from the rows alone
    (their number from the row count), so that training repeats on any cluster and for any file layout.
    """
    n = max(ORDERED_PARTITIONS, -(-df.count() // ORDERED_ROWS))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.repartition(n, *columns).sortWithinPartitions(*columns)


def random_forest(
    label: str,
    n_trees: int = 300,
    max_depth: int | None = 20,
    max_features: str = "sqrt",
    min_samples_split: int = 5,
    min_samples_leaf: int = 2,
    weight: str | None = None,
    seed: int = 42,
) -> RandomForestClassifier:
    """A node of fewer than min_samples_split rows cannot be forbidden to split; half that size as the
    least leaf has the nearest effect."""
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol=FEATURES,
        numTrees=n_trees,
        maxDepth=min(max_depth or _MAX_DEPTH, _MAX_DEPTH),
        featureSubsetStrategy=max_features or "all",
        minInstancesPerNode=max(min_samples_leaf, min_samples_split // 2),
        maxBins=64,
        maxMemoryInMB=1024,
        cacheNodeIds=False,
        seed=seed,
    )
    return forest.setWeightCol(weight) if weight else forest


def boosted_trees(
    label: str,
    max_depth: int = 6,
    learning_rate: float = 0.05,
    n_rounds: int = 200,
    subsample: float = 0.8,
    colsample: float = 0.8,
    validation: str | None = None,
    validation_tol: float = 1e-4,
    weight: str | None = None,
    seed: int = 42,
) -> GBTClassifier:
    """With a boolean ``validation`` column training stops when the error on those rows stalls."""
    trees = GBTClassifier(
        labelCol=label,
        featuresCol=FEATURES,
        maxDepth=max_depth,
        stepSize=learning_rate,
        maxIter=n_rounds,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(float(colsample)),
        validationTol=validation_tol,
        maxMemoryInMB=1024,
        seed=seed,
    )
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return trees.setWeightCol(weight) if weight else trees


def logistic_regression(
    label: str,
    total_weight: float,
    c: float = 1.0,
    penalty: str = "l2",
    l1_ratio: float = 0.0,
    max_iter: int = 1000,
    tol: float = 1e-4,
    weight: str | None = None,
) -> LogisticRegression:
    """Inverse regularisation ``c`` as usual elsewhere; Spark averages the loss over the row weights,
    hence ``total_weight`` (the number of rows where there are none)."""
    mixing = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty]
    regression = LogisticRegression(
        labelCol=label,
        featuresCol=FEATURES,
        regParam=1.0 / (c * total_weight),
        elasticNetParam=mixing,
        maxIter=max_iter,
        tol=tol,
        standardization=False,
    )
    return regression.setWeightCol(weight) if weight else regression


def total_weight(df: DataFrame, weight: str | None = None) -> float:
    measure = F.sum(weight) if weight else F.count(F.lit(1))
    return float(df.agg(measure.alias("w")).first()["w"])


def scaled_pipeline(
    classifier: Estimator,
    features: list[str],
    scale: bool = True,
    weights: Estimator | None = None,
) -> Pipeline:
    """Weights, scaler, classifier; the whole fitted pipeline is what gets stored and scored."""
    stages: list = [weights] if weights else []
    if scale:
        stages.append(StandardScaler(features))
    if not isinstance(classifier, (GaussianNaiveBayes, KnnClassifier)):
        stages.append(VectorAssembler(inputCols=features, outputCol=FEATURES))
    return Pipeline(stages=[*stages, classifier])


def score(
    model: PipelineModel, df: DataFrame, threshold: float = 0.5, inclusive: bool = False
) -> DataFrame:
    """``df`` with ``p1`` and the ``pred`` it gives at the threshold."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("p1", vector_to_array("probability")[1])
    out = out.withColumn("pred", above("p1", threshold, inclusive))
    return out.drop("probability", "rawPrediction", "prediction", FEATURES)
