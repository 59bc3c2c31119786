"""Scaling and skew-correcting transforms as fitted stages and functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.functions import scalar
from panelsmith.functions.quantiles import exact_quantiles
from panelsmith.operators.stages import ColumnsEstimator, ColumnsTransformer, FittedColumns
from panelsmith.session import cut_lineage


def _shift_and_scale(c: str, centre: float | None, width: float | None) -> Column:
    """(x - centre) / width; a width of zero counts as one."""
    if centre is None:
        return F.col(c).cast("double")
    return (F.col(c).cast("double") - F.lit(centre)) / F.lit(width or 1.0)


class CentreScaleModel(FittedColumns):
    """Fitted (centre, width) per column."""

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = self.getValues()
        return df.withColumns({c: _shift_and_scale(c, *fitted[c]) for c in self.getColumns()})


class StandardScaler(ColumnsEstimator):
    """(x - mean) / population standard deviation. One aggregate fits all columns."""

    def _fit(self, df: DataFrame) -> CentreScaleModel:
        columns = self.getColumns()
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        return CentreScaleModel(
            columns, {c: [row[f"m{i}"], row[f"s{i}"]] for i, c in enumerate(columns)}
        )


class RobustScaler(ColumnsEstimator):
    """(x - median) / (q75 - q25) with exact interpolated quantiles of the non-null values."""

    def _fit(self, df: DataFrame) -> CentreScaleModel:
        quantiles = exact_quantiles(df, self.getColumns(), [0.25, 0.5, 0.75])
        return CentreScaleModel(
            self.getColumns(),
            {
                c: [q[1], None if q[0] is None else q[2] - q[0]]
                for c, q in quantiles.items()
            },
        )


class LogClip(ColumnsTransformer):
    """ln(max(x, 1e-5) + 1) in place."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: scalar.log_clip(c) for c in self.getColumns()})


_GRID = 41
_MOVES = 10


_SUMS = "column int, lam int, n long, jacobian double, mean double, m2 double"


def _likelihoods(table: DataFrame, grids: dict[int, list[float]]) -> dict[int, dict[float, float]]:
    """Log-likelihood per column (by number) and candidate: -n/2 ln var(y) + (lambda - 1) sum sign(x) ln(1 + |x|).

    A task adds up the moments of all candidates and columns as it reads, and sends one row of each.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = {i: np.array(grid) for i, grid in grids.items()}
        n, jacobian = dict.fromkeys(grids, 0), dict.fromkeys(grids, 0.0)
        mean, m2 = ({i: np.zeros(len(g)) for i, g in grids.items()} for _ in range(2))
        for batch in batches:
            for i, lam in size.items():
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                sign, log = np.sign(x)[:, None], np.log1p(np.abs(x))[:, None]
                # (1 + |x|)^k = exp(k log(1 + |x|)): one logarithm per value, one exponential per candidate
                k = np.where(sign >= 0, lam, 2.0 - lam)
                with np.errstate(all="ignore"):
                    y = sign * np.where(k == 0, log, np.expm1(k * log) / k)
                    own = y.mean(axis=0)
                    gap, total = own - mean[i], n[i] + len(x)
                    m2[i] += ((y - own) ** 2).sum(axis=0) + gap * gap * (n[i] * len(x) / total)
                    mean[i] += gap * (len(x) / total)
                n[i], jacobian[i] = total, jacobian[i] + float((sign * log).sum())
        rows = [(i, j, n[i], jacobian[i], mean[i][j], m2[i][j]) for i in grids if n[i] for j in range(len(grids[i]))]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 3]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["column", "lam", "n", "jacobian", "mean", "m2"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        """Of one column and candidate: the moments of all tasks, about their common mean."""
        n = frame["n"].sum()
        mean = (frame["n"] * frame["mean"]).sum() / n
        spread = frame["m2"].sum() + (frame["n"] * (frame["mean"] - mean) ** 2).sum()
        return frame.head(1)[["column", "lam"]].assign(n=n, jacobian=frame["jacobian"].sum(), mean=mean, m2=spread)

    sums = table.mapInArrow(moments, _SUMS).groupBy("column", "lam").applyInPandas(merged, _SUMS)
    out: dict[int, dict[float, float]] = {i: {} for i in grids}
    for row in sums.collect():
        variance, lam = row["m2"] / row["n"], grids[row["column"]][row["lam"]]
        # equal values may differ from their mean by its rounding
        if (1e-14 * row["mean"]) ** 2 < variance < math.inf:
            out[row["column"]][lam] = -row["n"] / 2 * math.log(variance) + (lam - 1) * row["jacobian"]
    return out


def fit_yeo_johnson_columns(
    df: DataFrame, columns: list[str], low: float = -4.0, high: float = 6.0, tolerance: float = 1e-5
) -> dict[str, float | None]:
    """Maximum-likelihood lambda of each column: a grid of candidates per pass, refined around the best one.

    The columns are written once; a pass reads them for all columns that are still searched. While the best
    candidate lies on an edge, the grid doubles its width beyond that edge, ``_MOVES`` times at most; then
    the edge itself is the answer. None where there are no values or they are constant.
    """
    table = cut_lineage(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    found: dict[str, float | None] = dict.fromkeys(columns)
    search = {i: (low, high, 0) for i in range(len(columns))}
    while search:
        steps = {i: (high - low) / (_GRID - 1) for i, (low, high, _) in search.items()}
        grids = {i: [search[i][0] + j * steps[i] for j in range(_GRID)] for i in search}
        for i, likelihood in _likelihoods(table, grids).items():
            low, high, moves = search.pop(i)
            if not likelihood:
                continue
            best = max(sorted(likelihood), key=likelihood.get)
            edge = best in (grids[i][0], grids[i][-1]) and steps[i] > 0.01
            if steps[i] <= tolerance or (edge and moves == _MOVES):
                found[columns[i]] = best
            elif edge:
                search[i] = best - (high - low), best + (high - low), moves + 1
            else:
                search[i] = best - steps[i], best + steps[i], moves
    return found


def fit_yeo_johnson(
    df: DataFrame, column: str, low: float = -4.0, high: float = 6.0, tolerance: float = 1e-5
) -> float | None:
    """``fit_yeo_johnson_columns`` of one column."""
    return fit_yeo_johnson_columns(df, [column], low, high, tolerance)[column]


def gaussian_transforms(column: str, lam: float | None) -> dict[str, Column]:
    """The column itself and its five candidate transforms, by name."""
    x = F.col(f"`{column}`").cast("double")
    return {
        "raw": x,
        "yeo_johnson": F.lit(None).cast("double") if lam is None else scalar.yeo_johnson(x, lam),
        "power_1_5": scalar.power_1_5(x),
        "sqrt": scalar.square_root(x),
        "reciprocal": scalar.reciprocal(x),
        "log1p": scalar.log1p(x),
    }


def gaussian_candidates(df: DataFrame, column: str, lam: float | None = None) -> DataFrame:
    """Shape of a column under each transform: (transform, n, mean, sd, skewness, kurtosis).

    All candidates come out of one aggregate. Without ``lam`` it is fitted first.
    """
    if lam is None:
        lam = fit_yeo_johnson(df, column)
    candidates = gaussian_transforms(column, lam)
    projected = df.select(*[c.alias(name) for name, c in candidates.items()])
    measures = {
        "n": F.count,
        "mean": F.avg,
        "sd": F.stddev_pop,
        "skewness": F.skewness,
        "kurtosis": F.kurtosis,
    }
    row = projected.agg(
        *[f(name).alias(f"{name}__{m}") for name in candidates for m, f in measures.items()]
    )
    entries = [
        F.struct(
            F.lit(name).alias("transform"), *[F.col(f"{name}__{m}").alias(m) for m in measures]
        )
        for name in candidates
    ]
    return row.select(F.inline(F.array(*entries)))
