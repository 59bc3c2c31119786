"""The preprocessing plan: drop, impute, drop, one-hot, log, robust scaling, drop rows with gaps."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame

from panelsmith import presets
from panelsmith.operators.clean import (
    DropIfPresent,
    DropNulls,
    DropStrict,
    MeanImputer,
    NormalizeNames,
    OneHot,
    numeric_columns,
)
from panelsmith.operators.impute import IterativeImputer
from panelsmith.operators.scale import LogClip, RobustScaler
from panelsmith.session import cut_lineage


def fit_preprocessing(
    df: DataFrame,
    impute: list[str],
    drop_first: list[str] | None = None,
    drop_after_imputing: list[str] | None = None,
    one_hot: list[str] | None = None,
    log: list[str] | None = None,
    scale: list[str] | None = None,
    imputer: str = "iterative",
    max_iter: int = 30,
    tol: float = 1e-3,
    regressor: str = "bayesian_ridge",
) -> PipelineModel:
    """Fit all steps on ``df``; the model transforms any rows of the same columns.

    ``imputer`` is "iterative" (``max_iter``, ``tol`` and ``regressor`` are its settings) or "mean".

    Columns of ``drop_after_imputing`` still serve as predictors for the imputation. The imputed table
    is materialised once, since several later steps are fitted on it.
    """
    if imputer not in ("iterative", "mean"):
        raise ValueError("imputer must be iterative or mean")
    imputing = (
        IterativeImputer(impute, max_iter=max_iter, tol=tol, regressor=regressor)
        if imputer == "iterative"
        else MeanImputer(impute)
    )
    head = Pipeline(stages=[DropStrict(drop_first), imputing]).fit(df)
    filled = cut_lineage(head.transform(df))
    tail = Pipeline(
        stages=[
            DropIfPresent(drop_after_imputing),
            OneHot(one_hot),
            LogClip(log),
            RobustScaler(scale),
            DropNulls(),
            NormalizeNames(),
        ]
    ).fit(filled)
    return PipelineModel(head.stages + tail.stages)


def default_preprocessing(df: DataFrame, max_iter: int = 30) -> PipelineModel:
    """The plan with the default columns of the hourly clinical panel.

    The label, the entity and the categorical columns are not imputed and do not serve as predictors.
    """
    excluded = [
        *presets.REDUNDANT_COLUMNS,
        *presets.CATEGORICAL_COLUMNS,
        presets.LABEL,
        presets.ENTITY,
    ]
    return fit_preprocessing(
        df,
        impute=numeric_columns(df, excluded),
        drop_first=presets.REDUNDANT_COLUMNS,
        drop_after_imputing=presets.SPARSE_COLUMNS,
        one_hot=[presets.ONE_HOT_COLUMN],
        log=presets.LOG_COLUMNS,
        scale=presets.SCALED_COLUMNS,
        max_iter=max_iter,
    )
