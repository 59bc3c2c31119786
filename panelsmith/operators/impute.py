"""Iterative (chained-equation) imputation.

Each round regresses every column with gaps on all other columns over the rows where it is observed
and overwrites its gaps with the prediction. Done literally that is one pass over the table per round
and column, with the filled table written in between. Here the table is read three times in all, and
the fitted steps are replayed on whatever rows are to be filled:

* Every regression needs sums of products only, and all rows that lack the same columns are filled by
  the same linear function. So the rows of such a pattern may be replaced by any others with the same
  sums of products: the triangular factor of their QR decomposition, at most one row per observed
  column and one more. This compressed table never has more rows than the table it stands for, a
  pattern's rows need not meet in one task for the sums to be right, and any number of patterns will do.
* The rounds run on the compressed table: a small matrix of sums per step, then the step is applied to
  the compressed rows. One of bounded size is kept on the driver; a greater one stays distributed and
  is written once a round.
* The stopping rule needs the greatest sum of changes in one row per round; one more pass replays all
  rounds on the rows and takes the maxima. Rounds after the first one below the tolerance are cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsmith.operators.stages import ColumnsEstimator, FittedColumns
from panelsmith.session import cut_lineage, drop_cut
from panelsmith.sources.tables import TableError

# A step is (round, column, intercept, coefficients), in standard units; the column's own
# coefficient is 0.
Step = tuple[int, int, float, list[float]]


def bayesian_ridge(gram: np.ndarray, cross: np.ndarray, yy: float, n: float) -> np.ndarray:
    """Coefficients of Bayesian ridge regression from centred sums of products.

    Evidence maximisation (MacKay 1992): noise precision ``alpha`` and weight precision ``lam`` are
    re-estimated until the coefficients move by less than 1e-3 in total.
    """
    prior, tolerance, max_iter = 1e-6, 1e-3, 300  # fixed values: defaults of the usual estimator
    eigenvalues, vectors = np.linalg.eigh(gram)
    eigenvalues = np.maximum(eigenvalues, 0.0)
    rotated = vectors.T @ cross
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0

    def solve() -> tuple[np.ndarray, float]:
        weights = vectors @ (rotated / (eigenvalues + lam / alpha))
        error = yy - 2 * weights @ cross + weights @ gram @ weights
        return weights, max(error, 0.0)

    previous = None
    for _ in range(max_iter):
        weights, error = solve()
        effective = (alpha * eigenvalues / (lam + alpha * eigenvalues)).sum()
        lam = (effective + 2 * prior) / (weights @ weights + 2 * prior)
        alpha = (n - effective + 2 * prior) / (error + 2 * prior)
        if previous is not None and np.abs(previous - weights).sum() < tolerance:
            break
        previous = weights
    return solve()[0]


def least_squares(gram: np.ndarray, cross: np.ndarray, yy: float, n: float) -> np.ndarray:
    return np.linalg.lstsq(gram, cross, rcond=None)[0]


REGRESSORS: dict[str, Callable] = {
    "bayesian_ridge": bayesian_ridge,
    "least_squares": least_squares,
}


@dataclass
class _Scale:
    """Mean and standard deviation of the observed values of each column."""

    mean: np.ndarray
    sd: np.ndarray

    def standard(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Standardised values with gaps at 0 (their mean), and the mask of the gaps."""
        raw = batch.to_numpy(dtype=np.float64)
        gaps = np.isnan(raw)
        return np.where(gaps, 0.0, (raw - self.mean) / self.sd), gaps


def _fit_step(
    moments: np.ndarray, column: int, scale: _Scale, regressor: Callable
) -> tuple[float, list[float]]:
    """Regression of a column on all others from the moments of (1, standardised values)."""
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    centred = moments[1:, 1:] - n * np.outer(mean, mean)
    raw = centred * np.outer(scale.sd, scale.sd)  # the ridge penalty depends on the units
    others = np.arange(len(mean)) != column
    weights = regressor(raw[np.ix_(others, others)], raw[others, column], raw[column, column], n)
    coefficients = np.zeros(len(mean))
    coefficients[others] = weights * scale.sd[others] / scale.sd[column]
    return float(mean[column] - coefficients @ mean), coefficients.tolist()


def _replay(values: np.ndarray, gaps: np.ndarray, steps: list[Step], scale: _Scale) -> np.ndarray:
    """Apply steps to ``values`` in place; per round the greatest sum of changes in a row, in raw units."""
    n_rounds = max((s[0] for s in steps), default=-1) + 1
    change = np.zeros(n_rounds)
    moved, current = np.zeros(len(values)), 0
    affected = {j: np.flatnonzero(gaps[:, j]) for j in {s[1] for s in steps}}
    for number, j, intercept, coefficients in steps:
        if number != current:
            change[current] = moved.max(initial=0.0)
            moved, current = np.zeros(len(values)), number
        rows = affected[j]
        if len(rows):
            filled = values[rows] @ np.asarray(coefficients) + intercept
            moved[rows] += np.abs(filled - values[rows, j]) * scale.sd[j]
            values[rows, j] = filled
    if n_rounds:
        change[current] = moved.max(initial=0.0)
    return change


#: Rows a task gathers before it passes on what it has compressed.
_HELD_ROWS = 65_536


def _factor(rows: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Fewer rows of (1, values) with the same sums of products, where they exceed the columns in use."""
    used = np.flatnonzero(np.r_[True, ~gaps])
    if len(rows) <= len(used):
        return rows
    short = np.zeros((len(used), rows.shape[1]))
    short[:, used] = np.linalg.qr(rows[:, used], mode="r")
    return short


def _compressed(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of (1, values), gaps) with the rows of every pattern replaced by their factor.

    Memory is bounded: beyond ``_HELD_ROWS`` rows everything held is passed on. Gaps must be at 0.
    """
    held: dict[bytes, list[np.ndarray]] = {}
    n_held = 0

    def release() -> tuple[np.ndarray, np.ndarray]:
        masks = [np.frombuffer(key, dtype=bool) for key in held]
        factors = [_factor(np.concatenate(parts), m) for parts, m in zip(held.values(), masks, strict=True)]
        return np.concatenate(factors), np.repeat(masks, [len(f) for f in factors], axis=0)

    for rows, gaps in batches:
        if not len(rows):
            continue
        keys = np.ascontiguousarray(gaps).view(f"V{gaps.shape[1]}").ravel()
        _, first, inverse = np.unique(np.packbits(gaps, axis=1), axis=0, return_index=True, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(inverse.ravel()))[:-1]
        for at, part in zip(first, np.split(order, ends), strict=True):
            factor = _factor(rows[part], gaps[at])
            held.setdefault(keys[at].tobytes(), []).append(factor)
            n_held += len(factor)
        if n_held > _HELD_ROWS:
            squeezed = release()
            held, n_held = {}, 0
            if len(squeezed[0]) > _HELD_ROWS // 2:
                yield squeezed
            else:  # a few patterns: go on gathering
                rows, gaps = squeezed
                keys = np.ascontiguousarray(gaps).view(f"V{gaps.shape[1]}").ravel()
                edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                held = {keys[e].tobytes(): [r] for e, r in zip(edges, np.split(rows, edges[1:]), strict=True)}
                n_held = len(rows)
    if held:
        yield release()


_COMPRESSED = "u array<double>, gaps array<boolean>"


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    u, gaps = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
    return u.reshape(n, -1).copy(), gaps.reshape(n, -1)


def _packed(u: np.ndarray, gaps: np.ndarray) -> pa.RecordBatch:
    columns = [
        pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))
        for m in (u, gaps)
    ]
    return pa.RecordBatch.from_arrays(columns, names=["u", "gaps"])


def _compressed_table(df: DataFrame, scale: _Scale) -> DataFrame:
    """The compressed rows, first task by task where they are read, then by pattern."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            values, gaps = scale.standard(batch)
            yield np.column_stack([np.ones(len(values)), values]), gaps

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, gaps in _compressed(read(b.to_pandas() for b in batches)):
            yield _packed(u, gaps)

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, gaps in _compressed(_unpacked(b) for b in batches if b.num_rows):
            yield _packed(u, gaps)

    return df.mapInArrow(early, _COMPRESSED).repartition("gaps").mapInArrow(late, _COMPRESSED)


def _apply(u: np.ndarray, gaps: np.ndarray, steps: list[Step]) -> None:
    """Steps on compressed rows, in place; the first column stands for the constant."""
    for _, j, intercept, coefficients in steps:
        rows = gaps[:, j]
        u[rows, j + 1] = u[rows] @ np.r_[intercept, coefficients]


def _products(u: np.ndarray, gaps: np.ndarray, target: int) -> np.ndarray:
    seen = u[~gaps[:, target]]
    return seen.T @ seen


class _OnDriver:
    """Compressed rows of a proven size."""

    def __init__(self, table: DataFrame, size: int) -> None:
        rows = table.collect()
        self.u = np.array([r["u"] for r in rows]).reshape(len(rows), size + 1)
        self.gaps = np.array([r["gaps"] for r in rows], dtype=bool).reshape(len(rows), size)

    def moments(self, target: int) -> np.ndarray:
        return _products(self.u, self.gaps, target)

    def step(self, step: Step) -> None:
        _apply(self.u, self.gaps, [step])

    def end_round(self) -> None:
        pass


class _OnCluster:
    """Compressed rows as a table: a pass per step replays the round so far, a round ends with a write."""

    def __init__(self, table: DataFrame, size: int) -> None:
        self.table, self.size, self.steps = table, size, []

    def moments(self, target: int) -> np.ndarray:
        steps, size = self.steps, self.size + 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, size))
            for batch in batches:
                if batch.num_rows:
                    u, gaps = _unpacked(batch)
                    _apply(u, gaps, steps)
                    total += _products(u, gaps, target)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["m"])

        partial = self.table.mapInArrow(sums, "m array<double>")
        row = partial.agg(Summarizer.sum(array_to_vector("m")).alias("m")).first()
        return row["m"].toArray().reshape(size, size)

    def step(self, step: Step) -> None:
        self.steps = [*self.steps, step]

    def end_round(self) -> None:
        steps = self.steps

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    u, gaps = _unpacked(batch)
                    _apply(u, gaps, steps)
                    yield _packed(u, gaps)

        before = self.table
        self.table, self.steps = cut_lineage(before.mapInArrow(filled, _COMPRESSED)), []
        drop_cut(before)


def _change_udf(scale: _Scale, steps: list[Step]) -> Callable:
    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        greatest = None
        for batch in batches:
            if len(batch):
                change = _replay(*scale.standard(batch), steps, scale)
                greatest = change if greatest is None else np.maximum(greatest, change)
        if greatest is not None:
            yield pd.DataFrame({"round": np.arange(len(greatest)), "change": greatest})

    return changes


def _changes(df: DataFrame, scale: _Scale, steps: list[Step]) -> dict[int, float]:
    per_task = df.mapInPandas(_change_udf(scale, steps), "round int, change double")
    rows = per_task.groupBy("round").agg(F.max("change").alias("change")).collect()
    return {row["round"]: row["change"] for row in rows}


class IterativeImputer(ColumnsEstimator):
    """Chained-equation imputation of numeric columns, starting from their means.

    Columns are filled in ascending order of gaps; complete ones are predictors only. Rounds stop at
    ``max_iter`` or when no row moves, all its cells together, by ``tol`` times the greatest
    observed absolute value.
    Deterministic: no sampling from the predictive distribution.
    """

    maxIter = Param(Params._dummy(), "maxIter", "greatest number of rounds")
    tol = Param(Params._dummy(), "tol", "relative tolerance of the greatest change in a round")
    regressor = Param(Params._dummy(), "regressor", "bayesian_ridge or least_squares")
    driverValues = Param(Params._dummy(), "driverValues", "greatest compressed table the driver keeps")

    def __init__(
        self,
        columns: list[str] | None = None,
        max_iter: int = 30,
        tol: float = 1e-3,
        regressor: str = "bayesian_ridge",
        driver_values: int = 2_000_000,
    ) -> None:
        super().__init__(columns)
        self._set(maxIter=max_iter, tol=tol, regressor=regressor, driverValues=driver_values)

    def _fit(self, df: DataFrame) -> IterativeImputerModel:
        columns = self.getColumns()
        df = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
        stats = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(c).alias(f"n_{c}") for c in df.columns],
            *[F.avg(c).alias(f"m_{c}") for c in df.columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in df.columns],
            *[F.max(F.abs(c)).alias(f"a_{c}") for c in df.columns],
        ).first()
        empty = [c for c, x in zip(columns, df.columns, strict=True) if not stats[f"n_{x}"]]
        if empty:
            raise TableError(f"columns without any value cannot be imputed: {empty}")
        scale = _Scale(
            np.array([stats[f"m_{x}"] for x in df.columns]),
            np.array([stats[f"s_{x}"] or 1.0 for x in df.columns]),
        )
        gaps = [stats["rows"] - stats[f"n_{x}"] for x in df.columns]
        order = sorted((j for j, g in enumerate(gaps) if g), key=lambda j: gaps[j])
        limit = self.getOrDefault(self.tol) * max(stats[f"a_{x}"] for x in df.columns)
        steps = self._steps(df, scale, order, limit) if len(columns) > 1 else []
        values = {"mean": scale.mean.tolist(), "sd": scale.sd.tolist(), "steps": steps}
        return IterativeImputerModel(columns, values)

    def _steps(
        self, df: DataFrame, scale: _Scale, order: list[int], limit: float
    ) -> list[Step]:
        max_iter = self.getOrDefault(self.maxIter)
        regressor = REGRESSORS[self.getOrDefault(self.regressor)]
        size = len(df.columns)
        table = cut_lineage(_compressed_table(df, scale))
        small = table.count() * (size + 1) <= self.getOrDefault(self.driverValues)
        rows = (_OnDriver if small else _OnCluster)(table, size)
        steps: list[Step] = []
        for number in range(max_iter):
            for j in order:
                steps.append((number, j, *_fit_step(rows.moments(j), j, scale, regressor)))
                rows.step(steps[-1])
            rows.end_round()
        drop_cut(table if small else rows.table)
        changes = _changes(df, scale, steps)
        done = [r for r in range(max_iter) if changes.get(r, math.inf) < limit]
        last = done[0] if done else max_iter
        return [s for s in steps if s[0] <= last]


class IterativeImputerModel(FittedColumns):
    """Replays the fitted rounds on any rows; observed cells are passed on untouched."""

    def _transform(self, df: DataFrame) -> DataFrame:
        columns, fitted = self.getColumns(), self.getValues()
        scale = _Scale(np.array(fitted["mean"]), np.array(fitted["sd"]))
        steps = [tuple(s) for s in fitted["steps"]]
        names = [f"x{i}" for i in range(len(columns))]
        schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

        @F.pandas_udf(schema)
        def fill(*series: pd.Series) -> pd.DataFrame:
            raw = pd.concat(series, axis=1)
            values, gaps = scale.standard(raw)
            _replay(values, gaps, steps, scale)
            return pd.DataFrame(
                np.where(gaps, values * scale.sd + scale.mean, raw.to_numpy(dtype=np.float64)),
                columns=names,
            )

        fill = fill.asNondeterministic()  # keeps the optimizer from repeating it per output column
        filled = fill(*[F.col(f"`{c}`").cast("double") for c in columns])
        return (
            df.withColumn("_filled", filled)
            .withColumns({c: F.col(f"_filled.{n}") for c, n in zip(columns, names, strict=True)})
            .drop("_filled")
        )
