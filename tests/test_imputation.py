import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from panelsmith.operators import impute
from panelsmith.operators.clean import MeanImputer
from panelsmith.operators.impute import IterativeImputer
from panelsmith.session import scratch_path
from panelsmith.sources.tables import TableError

COLUMNS = ["a", "b", "c", "d"]


def ridge(x, y):
    """Bayesian ridge from the data itself, by singular values."""
    mx, my = x.mean(0), y.mean()
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    target = y - my
    n, alpha, lam, before = len(y), 1 / (y.var() + np.finfo(float).eps), 1.0, None

    def weights():
        return vt.T @ ((s / (s**2 + lam / alpha)) * (u.T @ target))

    for _ in range(300):
        w = weights()
        rest = ((target - (x - mx) @ w) ** 2).sum()
        used = (alpha * s**2 / (lam + alpha * s**2)).sum()
        lam = (used + 2e-6) / ((w**2).sum() + 2e-6)
        alpha = (n - used + 2e-6) / (rest + 2e-6)
        if before is not None and abs(before - w).sum() < 1e-3:
            break
        before = w
    w = weights()
    return w, my - mx @ w


def chained(x, max_iter=30, tol=1e-3):
    """The procedure taken literally, on one array."""
    gaps = np.isnan(x)
    filled = np.where(gaps, np.nanmean(x, 0), x)
    limit = tol * np.nanmax(abs(x))
    order = [j for j in np.argsort(gaps.sum(0), kind="stable") if gaps[:, j].any()]
    for number in range(1, max_iter + 1):
        before = filled.copy()
        for j in order:
            others = [i for i in range(x.shape[1]) if i != j]
            w, intercept = ridge(filled[~gaps[:, j]][:, others], x[~gaps[:, j], j])
            filled[gaps[:, j], j] = filled[gaps[:, j]][:, others] @ w + intercept
        if abs(filled - before).sum(1).max() < limit:
            break
    return filled, number


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) * [1, 5, 20, 0.1] + [3, 80, 120, 7]
    gaps = rng.random(base.shape) < [0.3, 0.1, 0.5, 0.0]
    return np.where(gaps, np.nan, base)


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, d double").cache()


def matrix(df):
    return df.orderBy("i").toPandas()[COLUMNS].to_numpy()


@pytest.mark.parametrize("driver_values", [1_000_000, 0])
def test_equals_the_literal_procedure(frame, data, driver_values):
    want, rounds = chained(data)
    model = IterativeImputer(COLUMNS, driver_values=driver_values).fit(frame)
    steps = model.getValues()["steps"]
    assert steps[-1][0] + 1 == rounds > 1
    np.testing.assert_allclose(matrix(model.transform(frame)), want, rtol=1e-8)


@pytest.mark.parametrize("driver_values", [10_000_000, 0])
def test_fifty_thousand_patterns_and_three_reads(spark, driver_values):
    rng = np.random.default_rng(3)
    width, n = 18, 60_000
    x = rng.normal(size=(n, 5)) @ rng.normal(size=(5, width)) + 0.3 * rng.normal(size=(n, width)) + 4
    x[rng.random(x.shape) < 0.5] = np.nan
    x[:, 0] = np.where(np.isnan(x[:, 0]), 1.0, x[:, 0])
    assert len(np.unique(np.isnan(x), axis=0)) > 40_000
    want, _ = chained(x, 2, 0.0)
    names = [f"v{i}" for i in range(width)]
    frame = pd.DataFrame(x, columns=names).assign(i=np.arange(n))
    path = scratch_path(spark, "patterns")
    spark.createDataFrame(frame).replace(float("nan"), None).repartition(6).write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    stored = spark.read.parquet(path)
    table = stored.mapInArrow(counted, stored.schema)
    model = IterativeImputer(names, max_iter=2, tol=0.0, driver_values=driver_values).fit(table)
    assert reads.value == 3 * n
    got = model.transform(stored).orderBy("i").toPandas()[names].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-7)


def test_compression_keeps_all_products():
    rng = np.random.default_rng(5)
    gaps = rng.random((9_000, 7)) < [0, 0.5, 0.2, 0.9, 0.5, 0.1, 1]
    u = np.column_stack([np.ones(len(gaps)), np.where(gaps, 0.0, rng.normal(size=gaps.shape))])
    parts = list(impute._compressed(iter([(u[:4_000], gaps[:4_000]), (u[4_000:], gaps[4_000:])])))
    short, masks = (np.concatenate(p) for p in zip(*parts, strict=True))
    patterns = np.unique(gaps, axis=0)
    assert len(short) <= sum(8 - p.sum() for p in patterns)
    for pattern in patterns:
        a, b = u[(gaps == pattern).all(1)], short[(masks == pattern).all(1)]
        np.testing.assert_allclose(a.T @ a, b.T @ b, atol=1e-9)


@pytest.mark.parametrize("held", [1, 40, 300])
def test_compression_in_bounded_memory(monkeypatch, held):
    monkeypatch.setattr(impute, "_HELD_ROWS", held)
    rng = np.random.default_rng(6)
    gaps = rng.random((3_000, 5)) < 0.5
    u = np.column_stack([np.ones(len(gaps)), np.where(gaps, 0.0, rng.normal(size=gaps.shape))])
    parts = list(impute._compressed((u[i : i + 100], gaps[i : i + 100]) for i in range(0, 3_000, 100)))
    short, masks = (np.concatenate(p) for p in zip(*parts, strict=True))
    for pattern in np.unique(gaps, axis=0):
        a, b = u[(gaps == pattern).all(1)], short[(masks == pattern).all(1)]
        np.testing.assert_allclose(a.T @ a, b.T @ b, atol=1e-9)


def test_observed_cells_and_other_columns_stay(frame, data):
    out = IterativeImputer(COLUMNS, max_iter=2).fit(frame).transform(frame)
    assert out.columns == frame.columns
    got = matrix(out)
    seen = ~np.isnan(data)
    np.testing.assert_array_equal(got[seen], data[seen])
    assert not np.isnan(got).any()


def test_new_rows_and_reload(spark, frame, tmp_path):
    model = Pipeline(stages=[IterativeImputer(COLUMNS)]).fit(frame)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    new = spark.createDataFrame(
        [(0, None, None, None, None), (1, 3.0, None, 100.0, 7.0)], frame.schema
    )
    np.testing.assert_array_equal(matrix(model.transform(new)), matrix(again.transform(new)))
    assert not np.isnan(matrix(again.transform(new))).any()


def test_constant_column(spark):
    rows = [(i, float(i % 7) if i % 3 else None, 4.0) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    filled = IterativeImputer(["a", "b"]).fit(df).transform(df)
    assert filled.where(F.col("a").isNull() | F.isnan("a")).count() == 0


@pytest.mark.parametrize("imputer", [IterativeImputer, MeanImputer])
def test_wholly_missing_column_is_an_error(spark, imputer):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    with pytest.raises(TableError):
        imputer(["a", "b"]).fit(df)
