"""Classifier evaluation as relational aggregates over (label, prediction, score) rows.

``by`` names columns (without NULL) whose groups, such as models, are evaluated apart in the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith import presets
from panelsmith.functions.ordering import next_in_order, running_totals
from panelsmith.operators.validate import union_all
from panelsmith.session import cut_lineage


class NoUsefulModel(ValueError):
    """No candidate reached an F1 score above zero."""


def _cell_counts(label: str, prediction: str) -> list[Column]:
    y, z = F.col(label), F.col(prediction)
    return [
        F.count_if((y == 1) & (z == 1)).alias("tp"),
        F.count_if((y == 0) & (z == 1)).alias("fp"),
        F.count_if((y == 1) & (z == 0)).alias("fn"),
        F.count_if((y == 0) & (z == 0)).alias("tn"),
    ]


def confusion_counts(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """One row (tp, fp, fn, tn) of a single aggregate, or one per group."""
    return df.groupBy(*by).agg(*_cell_counts(label, prediction))


def matrix_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All four cells, empty ones included: (actual, predicted, n)."""

    def cell(actual: int, predicted: int, n: str) -> Column:
        return F.struct(
            F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"), F.col(n).alias("n")
        )

    cells = F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
    return counts.select(*by, F.inline(cells))


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    return matrix_from_counts(confusion_counts(df, label, prediction, by), by)


def _share(by: Sequence[str] = ()) -> Column:
    """Cells as share of their actual class; 0 where the class does not occur."""
    row_total = F.sum("n").over(Window.partitionBy(*by, "actual"))
    return F.coalesce(F.try_divide(F.col("n").cast("double"), row_total), F.lit(0.0)).alias("share")


def confusion_matrix_normalized(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    matrix = confusion_matrix(df, label, prediction, by)
    return matrix.select(*by, "actual", "predicted", _share(by))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """The threshold metrics of rows with tp, fp, fn, tn; an undefined ratio is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    error_rate = F.try_divide(fp + fn, n)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    others = [c for c in counts.columns if c not in ("tp", "fp", "fn", "tn")]
    names = presets.METRIC_NAMES
    return counts.select(
        *others,
        F.try_divide(tp + tn, n).alias(names[0]),
        ratio(tp, tp + fp).alias(names[1]),
        ratio(tp, tp + fn).alias(names[2]),
        ratio(2 * tp, 2 * tp + fp + fn).alias(names[3]),
        error_rate.alias(names[4]),
        F.sqrt(error_rate).alias(names[5]),
    )


def threshold_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Counts per distinct score and cumulated from the greatest score down, materialised once.

    Columns: score, pos, neg, cum_pos, cum_neg, total_pos, total_neg. All curves derive from it. The
    rows are pre-aggregated by score, so the volume behind one score does not matter.
    """
    y, s = F.col(label), F.col(score).cast("double")
    per_score = (
        df.where(y.isNotNull() & s.isNotNull())
        .groupBy((s + 0.0).alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    return running_totals(cut_lineage(per_score), "score", ["pos", "neg"], descending=True)


def auc_from_thresholds(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties at half weight; NULL if a class is absent.

    A score's positives outrank every negative below it and share those at the same score.
    """
    below = F.col("total_neg") - F.col("cum_neg")
    won = F.col("pos").cast("double") * (below.cast("double") + F.col("neg").cast("double") / 2)
    return table.groupBy(*by).agg(
        F.sum(won).alias("won"),
        F.max(F.col("total_pos").cast("double") * F.col("total_neg")).alias("pairs"),
    ).select(*by, F.try_divide("won", "pairs").alias("auc"))


def auc_roc(df: DataFrame, label: str, score: str) -> DataFrame:
    return auc_from_thresholds(threshold_table(df, label, score))


def classification_metrics(
    df: DataFrame, label: str, prediction: str, score: str | None = None
) -> DataFrame:
    """The metrics row of one model; with a score column it includes the AUC."""
    metrics = metrics_from_counts(confusion_counts(df, label, prediction))
    if score is None:
        return metrics
    auc = auc_roc(df, label, score).first()["auc"]
    return metrics.withColumn(presets.METRIC_NAMES[6], F.lit(auc).cast("double"))


def _with_point(
    points: DataFrame, table: DataFrame, by: Sequence[str], point: dict[str, float | None]
) -> DataFrame:
    """``points`` and one more, for every group of ``table``."""
    groups = table.select(*by).distinct() if by else table.sparkSession.range(1)
    values = [F.lit(v).cast("double").alias(c) for c, v in point.items()]
    return groups.select(*by, *values).unionByName(points)


def roc_from_thresholds(
    table: DataFrame, drop_collinear: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """(threshold, fpr, tpr) from (0, 0) on; the start has no threshold (it lies above all scores).

    ``drop_collinear`` leaves out points on a straight piece: where the next score adds the same
    numbers of positives and negatives. The first and the last score always stay.
    """
    kept = table
    if drop_collinear:
        step = F.struct("pos", "neg")
        kept = next_in_order(table, "score", step, "next_step", descending=True, by=by)
        is_first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        kept = kept.where(is_first | F.col("next_step").isNull() | (F.col("next_step") != step))
    points = kept.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), "total_neg").alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), "total_pos").alias("tpr"),
    )
    return _with_point(points, table, by, {"threshold": None, "fpr": 0.0, "tpr": 0.0})


def roc_curve(
    df: DataFrame, label: str, score: str, drop_collinear: bool = True
) -> DataFrame:
    return roc_from_thresholds(threshold_table(df, label, score), drop_collinear)


def pr_from_thresholds(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point (NULL, 1, 0)."""
    points = table.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(
            F.col("cum_pos").cast("double"), F.col("cum_pos") + F.col("cum_neg")
        ).alias("precision"),
        # without positives recall is defined as 1
        F.coalesce(F.try_divide(F.col("cum_pos").cast("double"), "total_pos"), F.lit(1.0)).alias(
            "recall"
        ),
    )
    return _with_point(points, table, by, {"threshold": None, "precision": 1.0, "recall": 0.0})


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    return pr_from_thresholds(threshold_table(df, label, score))


def average_precision_from_thresholds(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of (R_k - R_k-1) P_k. The recall step at a score is its own share of the positives."""
    step = F.try_divide(F.col("pos").cast("double"), "total_pos")
    precision = F.try_divide(F.col("cum_pos").cast("double"), F.col("cum_pos") + F.col("cum_neg"))
    area = F.coalesce(F.sum(step * precision), F.lit(0.0))
    return table.groupBy(*by).agg(area.alias("average_precision"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    return average_precision_from_thresholds(threshold_table(df, label, score))


@dataclass
class Comparison:
    """Evaluation tables of many models, each with the model's column first.

    ``metrics``: threshold metrics and AUC; ``confusion``: (actual, predicted, n, share); ``areas``: (auc,
    average_precision); ``roc`` and ``pr``: the curves. A model without a labelled score has no curve and
    no area.
    """

    metrics: DataFrame
    confusion: DataFrame
    areas: DataFrame
    roc: DataFrame
    pr: DataFrame


def compare_models(
    df: DataFrame,
    model: str,
    label: str,
    prediction: str,
    score: str,
    drop_collinear: bool = True,
) -> Comparison:
    """All evaluation tables of all models from one scan of the rows (model, label, prediction, score).

    Rows are counted by model and score, and every table follows from these counts, which are written
    once. Running totals share value buckets between the models, so neither a model with most of the rows
    nor a score with a third of them is a hot spot. Rows without a model are left out.
    """
    by = [model]
    y, s = F.col(label), F.col(score).cast("double")
    per_score = cut_lineage(
        df.where(F.col(model).isNotNull())
        .groupBy(model, (s + 0.0).alias("score"))
        .agg(
            F.count(y).alias("labelled"),
            F.count_if(y == 1).alias("pos"),
            F.count_if(y == 0).alias("neg"),
            *_cell_counts(label, prediction),
        )
    )
    cells = ("tp", "fp", "fn", "tn")
    counts = per_score.groupBy(model).agg(*[F.sum(c).alias(c) for c in cells])
    labelled = per_score.where(F.col("score").isNotNull() & (F.col("labelled") > 0))
    table = cut_lineage(
        running_totals(
            labelled.select(model, "score", "pos", "neg"), "score", ["pos", "neg"], descending=True, by=by
        )
    )
    areas = auc_from_thresholds(table, by).join(average_precision_from_thresholds(table, by), model)
    auc = areas.select(model, F.col("auc").alias(presets.METRIC_NAMES[6]))
    return Comparison(
        metrics_from_counts(counts).join(auc, model, "left"),
        matrix_from_counts(counts, by).select(model, "actual", "predicted", "n", _share(by)),
        areas,
        roc_from_thresholds(table, drop_collinear, by),
        pr_from_thresholds(table, by),
    )


def select_best(metrics: DataFrame, f1: str, order: str) -> DataFrame:
    """The row with the greatest F1 above zero; the earliest in ``order`` wins ties."""
    best = metrics.where(F.col(f1) > 0).orderBy(F.desc(f1), F.asc(order)).limit(1)
    if best.isEmpty():
        raise NoUsefulModel("no model has an F1 score above 0")
    return best


def metrics_report(metrics: list[DataFrame], name: str = "model", digits: int = 4) -> DataFrame:
    """Metric rows of several models in long form: (model, metric, value)."""
    table = union_all(metrics)
    values = [c for c in presets.METRIC_NAMES if c in table.columns]
    return table.unpivot([name], values, "metric", "value").withColumn(
        "value", F.round("value", digits)
    )
