"""Cross-validation folds, hyperparameter draws and randomised search."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith import presets
from panelsmith.functions.ordering import hash_rank
from panelsmith.functions.spread import spread_join
from panelsmith.operators.evaluate import NoUsefulModel, confusion_counts, metrics_from_counts
from panelsmith.operators.models import fixed_order, score
from panelsmith.session import cut_lineage


def row_folds(
    df: DataFrame, id_col: str, label: str, n_folds: int = 5, seed: int = 42
) -> DataFrame:
    """``df`` with a ``fold``: rows of each class dealt out in a seeded order."""
    ranked = hash_rank(df, id_col, seed, [label])
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(n_folds)).cast("int")).drop(
        "rank", "stratum_size"
    )


def entity_folds(
    df: DataFrame, entity: str, label: str, n_folds: int = 5, seed: int = 42
) -> DataFrame:
    """``df`` with a ``fold`` that keeps the rows of an entity together, stratified by whether the
    entity is ever positive."""
    stats = cut_lineage(
        df.groupBy(entity).agg(F.max(label).alias("_ever"), F.count(F.lit(1)).alias("_n_rows"))
    )
    folds = row_folds(stats, entity, "_ever", n_folds, seed)
    return spread_join(df, folds, entity, "_n_rows").drop("_ever", "_n_rows")


@dataclass(frozen=True)
class RandInt:
    """Integer from low to high, high excluded."""

    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randrange(self.low, self.high)


@dataclass(frozen=True)
class Uniform:
    """Number from [start, start + width]."""

    start: float
    width: float

    def draw(self, rng: random.Random) -> float:
        return self.start + self.width * rng.random()


@dataclass(frozen=True)
class LogGrid:
    """One of n values spaced evenly in the exponent, from 10^low to 10^high."""

    low: float
    high: float
    n: int

    def draw(self, rng: random.Random) -> float:
        return math.pow(10, self.low + rng.randrange(self.n) * (self.high - self.low) / (self.n - 1))


def sample_params(space: dict, n: int, seed: int = 42) -> list[dict]:
    """n draws from lists of choices and from RandInt, Uniform and LogGrid; repeatable by seed."""
    rng = random.Random(seed)
    return [
        {
            name: rng.choice(choices) if isinstance(choices, list) else choices.draw(rng)
            for name, choices in space.items()
        }
        for _ in range(n)
    ]


# --- fixed values: search spaces and numbers of draws --------------------------------------
FOREST_SPACE = {
    "n_trees": RandInt(100, 500),
    "max_depth": [None, 10, 15, 20, 25, 30],
    "min_samples_split": RandInt(2, 11),
    "min_samples_leaf": RandInt(1, 5),
    "max_features": ["sqrt", "log2", None],
}
NAIVE_BAYES_SPACE = {
    "var_smoothing": LogGrid(-11, -5, 100),
    "priors": [None, [0.7, 0.3], [0.6, 0.4], [0.5, 0.5]],
}
KNN_SPACE = {
    "k": RandInt(3, 20),
    "weights": ["uniform", "distance"],
    "p": [1, 2],
}
LOGISTIC_SPACE = {
    "c": Uniform(0.001, 100),
    "penalty": ["l1", "l2", "elasticnet"],
    "l1_ratio": Uniform(0, 1),
    "max_iter": [500, 1000, 1500],
    "class_weight": ["balanced", None, {0: 1, 1: 2}, {0: 1, 1: 3}],
    "tol": [1e-5, 1e-4, 1e-3],
}
N_DRAWS = {"forest": 50, "naive_bayes": 20, "knn": 50, "logistic": 50}
# --- end of fixed values --------------------------------------------------------------------


def f1_of(scored: DataFrame, label: str, prediction: str = "pred") -> float:
    """F1 of the positive class, 0 where undefined."""
    row = metrics_from_counts(confusion_counts(scored, label, prediction)).first()
    return row[presets.METRIC_NAMES[3]]


@dataclass
class SearchResult:
    """``table`` holds (candidate, params, mean_f1, error) of all candidates."""

    table: DataFrame
    params: dict
    f1: float
    model: PipelineModel


def random_search(
    df: DataFrame,
    label: str,
    candidates: list[dict],
    build: Callable[[dict, DataFrame], Pipeline],
    n_folds: int = 5,
    fold: str = "fold",
    resample: Callable[[DataFrame], DataFrame] | None = None,
    refit: DataFrame | None = None,
    parallelism: int = 2,
) -> SearchResult:
    """Mean F1 of every candidate over the folds; the best (the first of equals) refit on all rows.

    ``build`` makes a pipeline for a candidate and its training rows. ``resample`` is applied to the
    training part of each fold only, so synthetic rows never reach the rows that are scored; ``refit``
    is the resampled whole where it exists already. Candidates run concurrently as Spark jobs; one that
    fails is listed with its error.
    """
    spark = df.sparkSession
    scores: dict[int, list[float]] = {i: [] for i in range(len(candidates))}
    errors: dict[int, str] = {}

    def prepared(rows: DataFrame) -> DataFrame:
        return cut_lineage(resample(rows)) if resample else rows

    for number in range(n_folds):
        train = fixed_order(prepared(df.where(F.col(fold) != number))).cache()
        held_out = df.where(F.col(fold) == number).cache()

        def evaluate(i: int, train: DataFrame = train, held_out: DataFrame = held_out) -> None:
            if i in errors:
                return
            try:
                model = build(candidates[i], train).fit(train)
                scores[i].append(f1_of(score(model, held_out), label))
            except Exception as e:  # noqa: BLE001 - recorded, does not stop the search
                errors[i] = f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(inheritable_thread_target(spark)(evaluate), range(len(candidates))))
        train.unpersist()
        held_out.unpersist()

    means = {i: sum(s) / n_folds for i, s in scores.items() if i not in errors}
    rows = [
        (i, json.dumps(candidates[i], sort_keys=True), means.get(i), errors.get(i))
        for i in range(len(candidates))
    ]
    table = spark.createDataFrame(rows, "candidate int, params string, mean_f1 double, error string")
    if not means:
        raise NoUsefulModel(f"every candidate failed: {errors}")
    best = max(means, key=lambda i: (means[i], -i))
    everything = fixed_order(prepared(df) if refit is None else refit)
    model = build(candidates[best], everything).fit(everything)
    return SearchResult(table, candidates[best], means[best], model)
