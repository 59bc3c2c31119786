"""From a panel to the best model: split, preprocess, resample, train, compare, test, save."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith import presets
from panelsmith.operators import models
from panelsmith.operators.boosting import PatientBoosting
from panelsmith.operators.classify import GaussianNaiveBayes, KnnClassifier
from panelsmith.operators.evaluate import classification_metrics, compare_models, select_best
from panelsmith.operators.resample import ClassWeights, smote_enn
from panelsmith.operators.split import split_frames, split_grouped
from panelsmith.operators.stats import corr_matrix, feature_importance, kept_correlations
from panelsmith.operators.tune import entity_folds, random_search, sample_params
from panelsmith.operators.validate import class_distribution, union_all, validate_panel
from panelsmith.session import cut_lineage, scratch_scope
from panelsmith.sources.tables import save_model, write_metrics, write_params, write_splits

ROW_ID = "row_id"
GROUP = "entity_key"
HELD_OUT = "held_out"
BOOSTED = "Boosted Trees"
#: Rounds without a smaller validation error after which boosting stops.
PATIENCE = 20
F1 = presets.METRIC_NAMES[3]

Build = Callable[[dict, DataFrame], Pipeline]


def resample_rows(
    df: DataFrame, features: list[str], label: str, ratio: float, k_smote: int, seed: int = 42
) -> DataFrame:
    """SMOTE + ENN on feature columns; returns (row_id, features..., label)."""
    vectors = df.select(
        ROW_ID, F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("vec"), label
    )
    kept = smote_enn(vectors, ROW_ID, "vec", label, ratio, k_smote, seed=seed)
    return kept.select(
        F.col("row_key").alias(ROW_ID),
        *[F.col("vec")[i].alias(c) for i, c in enumerate(features)],
        label,
    )


def builders(features: list[str], label: str, seed: int = 42) -> dict[str, Build]:
    """Pipeline makers of the five model families, by name; all take a dict of hyperparameters."""

    def forest(params: dict, _: DataFrame) -> Pipeline:
        forest = models.random_forest(label, weight="weight", seed=seed, **params)
        return models.scaled_pipeline(forest, features, weights=ClassWeights(label, "balanced"))

    def bayes(params: dict, _: DataFrame) -> Pipeline:
        return models.scaled_pipeline(GaussianNaiveBayes(features, label, **params), features)

    def knn(params: dict, _: DataFrame) -> Pipeline:
        return models.scaled_pipeline(KnnClassifier(features, label, ROW_ID, **params), features)

    def logistic(params: dict, train: DataFrame) -> Pipeline:
        weights = ClassWeights(label, params.get("class_weight", "balanced"))
        total = models.total_weight(weights.fit(train).transform(train), "weight")
        rest = {k: v for k, v in params.items() if k != "class_weight"}
        regression = models.logistic_regression(label, total, weight="weight", **rest)
        return models.scaled_pipeline(regression, features, weights=weights)

    def boosted(params: dict, train: DataFrame) -> Pipeline:
        rest = {k: v for k, v in params.items() if k != "patience"}
        trees = models.boosted_trees(label, seed=seed, **rest)
        if HELD_OUT in train.columns:
            trees = PatientBoosting(trees, HELD_OUT, params.get("patience", PATIENCE))
        return models.scaled_pipeline(trees, features, scale=False)

    return {
        "Random Forest": forest,
        "Naive Bayes": bayes,
        "KNN": knn,
        "Logistic Regression": logistic,
        BOOSTED: boosted,
    }


# --- fixed values: hyperparameters of the untuned models --------------------------------------
DEFAULT_PARAMS: dict[str, dict] = {
    "Random Forest": {
        "n_trees": 100,
        "max_depth": 20,
        "min_samples_split": 2,
        "min_samples_leaf": 1,
    },
    "Naive Bayes": {"var_smoothing": 1e-9},
    "KNN": {"k": 5, "weights": "distance", "p": 2},
    "Logistic Regression": {"c": 1.0, "penalty": "l2", "max_iter": 1000, "tol": 1e-4},
    BOOSTED: {
        "max_depth": 6,
        "learning_rate": 0.05,
        "n_rounds": 200,
        "subsample": 0.8,
        "colsample": 0.8,
    },
}
# --- end of fixed values ----------------------------------------------------------------------


def train_and_evaluate(
    name: str, pipeline: Pipeline, train: DataFrame, held_out: DataFrame, label: str
) -> tuple[DataFrame, PipelineModel]:
    """Fit, score the held-out rows once, and return the metrics row and the whole fitted pipeline."""
    model = pipeline.fit(models.fixed_order(train))
    metrics = evaluate_model(name, model, held_out, label)
    return metrics, model


def _scored(model: PipelineModel, held_out: DataFrame, label: str) -> DataFrame:
    return cut_lineage(models.score(model, held_out).select(label, "p1", "pred"))


def evaluate_model(
    name: str, model: PipelineModel, held_out: DataFrame, label: str
) -> DataFrame:
    metrics = classification_metrics(_scored(model, held_out, label), label, "pred", "p1")
    return metrics.withColumn("model", F.lit(name))


def importances(spark: SparkSession, trained: dict[str, PipelineModel]) -> DataFrame:
    """(model, feature, importance) of the models that have importances."""
    tables = [
        feature_importance(spark, model).withColumn("model", F.lit(name))
        for name, model in trained.items()
        if hasattr(model.stages[-1], "featureImportances")
    ]
    empty = spark.createDataFrame([], "model string, feature string, importance double")
    return union_all([empty, *tables])


@dataclass
class TrainingRun:
    """``metrics``: one row per trained model; ``test_metrics``: the best one on the test rows.

    ``distributions``: class counts of the training rows before and after resampling.
    ``correlations``: the absolute feature correlations left when columns that depend on earlier ones
    are taken out.
    ``confusion`` and ``importances``: cells of every model on the validation rows, and the importances of
    those that have them. ``roc`` and ``pr``: the curves of every model on the validation rows; they have a
    row per distinct score, so they are tables in the run's folder and None without one.
    """

    metrics: DataFrame
    best: str
    model: PipelineModel
    test_metrics: DataFrame
    distributions: DataFrame
    correlations: DataFrame
    confusion: DataFrame
    importances: DataFrame
    roc: DataFrame | None = None
    pr: DataFrame | None = None
    errors: dict[str, str] = field(default_factory=dict)
    path: str | None = None


def train_and_select(
    panel: DataFrame | dict[str, DataFrame],
    entity: str,
    time: str,
    label: str,
    preprocess: Callable[[DataFrame], PipelineModel],
    params: dict[str, dict] | None = None,
    search: dict[str, tuple[dict, int]] | None = None,
    ratio: float = 0.4,
    k_smote: int = 6,
    n_folds: int = 5,
    seed: int = 42,
    folder: str | None = None,
) -> TrainingRun:
    """The whole flow. ``preprocess`` is fitted on the training split only and applied to all three.

    ``panel`` is the whole panel, which is validated and split by entity, or the three given splits
    (``train``, ``val``, ``test``, as from ``load_splits``), each of which is validated. (entity, time) must
    be unique, since it names the rows.

    Families in ``search`` (space, number of draws) are tuned by cross-validation first, those in
    ``params`` are trained with fixed values. A family that fails is skipped and listed in ``errors``.
    The best by validation F1 is scored on the test split and, given a ``folder``, saved there with the
    splits, the metrics and the tuned parameters.
    Tables written on the way are removed at the end, but for the rows a nearest-neighbour model keeps.
    """
    first = next(iter(panel.values())) if isinstance(panel, dict) else panel
    with scratch_scope(first.sparkSession):
        return _train_and_select(
            panel, entity, time, label, preprocess, params, search, ratio, k_smote, n_folds, seed, folder
        )


def _train_and_select(
    panel, entity, time, label, preprocess, params, search, ratio, k_smote, n_folds, seed, folder
) -> TrainingRun:
    params = DEFAULT_PARAMS if params is None else params
    if isinstance(panel, dict):
        parts = [validate_panel(df, entity, time, label).withColumn("split", F.lit(n)) for n, df in panel.items()]
        split = cut_lineage(union_all(parts))
    else:
        split = cut_lineage(split_grouped(validate_panel(panel, entity, time, label), entity, label, seed=seed))
    spark = split.sparkSession
    if folder:
        write_splits(split, f"{folder}/splits")
    row_id = F.concat_ws(":", F.col(entity), F.col(time).cast("string"))
    frames = {
        name: df.withColumn(ROW_ID, row_id).withColumnRenamed(entity, GROUP)
        for name, df in split_frames(split).items()
    }
    preprocessing = preprocess(frames["train"])
    ready = {name: _spread(preprocessing.transform(df)) for name, df in frames.items()}
    features = [c for c in ready["train"].columns if c not in (ROW_ID, GROUP, label)]
    resampled = _spread(resample_rows(ready["train"], features, label, ratio, k_smote, seed))
    distributions = _held(
        union_all(
            [
                class_distribution(df, label).withColumn("stage", F.lit(stage))
                for stage, df in (("before", ready["train"]), ("after", resampled))
            ]
        )
    )
    build = builders(features, label, seed)
    trained: dict[str, PipelineModel] = {}
    scores, errors, tuned = [], {}, {}
    for name, values in {**params, **{k: None for k in (search or {})}}.items():
        try:
            if values is None:
                space, n = search[name]
                found = random_search(
                    entity_folds(ready["train"], GROUP, label, n_folds, seed),
                    label,
                    sample_params(space, n, seed),
                    build[name],
                    n_folds,
                    resample=lambda df: resample_rows(df, features, label, ratio, k_smote, seed),
                    refit=resampled,
                )
                model, seen = found.model, {name: found.params}
            else:
                train = resampled
                if name == BOOSTED:
                    train = _with_stopping_rows(resampled, ready["val"])
                model, seen = build[name](values, train).fit(models.fixed_order(train)), {}
            scores.append(_scored(model, ready["val"], label).withColumn("model", F.lit(name)))
            trained[name] = model
            tuned |= seen
        except Exception as e:  # noqa: BLE001 - one failing family must not stop the others
            errors[name] = f"{type(e).__name__}: {e}"
    if folder:
        for name, values in tuned.items():
            write_params(spark, values, f"{folder}/{_file(name)}_tuned_params")
    if not scores:
        raise RuntimeError(f"no model could be trained: {errors}")
    compared = compare_models(union_all(scores), "model", label, "pred", "p1")
    places = spark.createDataFrame([(n, i) for i, n in enumerate(trained)], "model string, seq int")
    metrics = _held(
        compared.metrics.join(places, "model").select(*presets.METRIC_NAMES, "model", "seq").orderBy("seq")
    )
    best = select_best(metrics, F1, "seq").first()["model"]
    test_metrics = _held(evaluate_model(f"final {best}", trained[best], ready["test"], label))
    correlations = _held(kept_correlations(corr_matrix(ready["train"], features)))
    run = TrainingRun(
        metrics,
        best,
        trained[best],
        test_metrics,
        distributions,
        correlations,
        _held(compared.confusion),
        _held(importances(spark, trained)),
        errors=errors,
    )
    if folder:
        run.roc = _stored(compared.roc, f"{folder}/roc")
        run.pr = _stored(compared.pr, f"{folder}/pr")
        write_metrics(metrics.drop("seq").unionByName(test_metrics), f"{folder}/metrics")
        whole = PipelineModel(preprocessing.stages + trained[best].stages)
        run.path = save_model(whole, folder, best)
    return run


def _with_stopping_rows(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training rows, and validation rows marked as such: boosting stops by the error on them."""
    marked = held_out.select(train.columns).withColumn(HELD_OUT, F.lit(True))
    return train.withColumn(HELD_OUT, F.lit(False)).unionByName(marked)


def _spread(df: DataFrame) -> DataFrame:
    """``df`` as a table of a part per core: joins and windows leave few, and every later step reads it."""
    return cut_lineage(df.repartition(df.sparkSession.sparkContext.defaultParallelism, ROW_ID))


def _held(df: DataFrame) -> DataFrame:
    """A table of a few rows that no longer depends on written ones."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(name: str) -> str:
    return name.lower().replace(" ", "_")
