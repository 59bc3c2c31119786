import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from panelsmith.operators import scale, stats


def test_standard_and_robust_scaling(spark):
    x = [1.0, 2.0, 4.0, None, 9.0]
    df = spark.createDataFrame([(i, v, 5.0) for i, v in enumerate(x)], "i int, x double, c double")
    seen = np.array([v for v in x if v is not None])
    standard = scale.StandardScaler(["x", "c"]).fit(df).transform(df).orderBy("i").collect()
    want = (seen - seen.mean()) / seen.std()
    assert [r["x"] for r in standard if r["x"] is not None] == pytest.approx(want)
    assert {r["c"] for r in standard} == {0.0}
    robust = scale.RobustScaler(["x", "c"]).fit(df).transform(df).orderBy("i").collect()
    q1, q2, q3 = np.quantile(seen, [0.25, 0.5, 0.75])
    assert [r["x"] for r in robust if r["x"] is not None] == pytest.approx((seen - q2) / (q3 - q1))
    assert {r["c"] for r in robust} == {0.0}


def test_scaler_survives_saving(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (2.0,), (7.0,)], "x double")
    model = Pipeline(stages=[scale.RobustScaler(["x"]), scale.LogClip(["x"])]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(df).collect() == model.transform(df).collect()


def log_likelihood(x, lam):
    up, down = x[x >= 0], x[x < 0]
    a = np.log1p(up) if lam == 0 else ((up + 1) ** lam - 1) / lam
    b = -np.log1p(-down) if lam == 2 else -((1 - down) ** (2 - lam) - 1) / (2 - lam)
    y = np.concatenate([a, b])
    return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(abs(x))).sum()


@pytest.mark.parametrize("power", [1, 3])
def test_fitted_lambda_is_a_maximum(spark, power):
    x = np.random.default_rng(4).normal(1, 1, 2_000) ** power
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = scale.fit_yeo_johnson(df, "x")
    for other in (lam - 1e-3, lam + 1e-3, lam - 0.1, lam + 0.1):
        assert log_likelihood(x, lam) > log_likelihood(x, other)


def test_lambda_outside_the_first_range(spark):
    x = -np.random.default_rng(5).exponential(1, 500) ** 0.1
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = scale.fit_yeo_johnson(df, "x", low=0.0, high=0.5)
    assert log_likelihood(x, lam) >= max(log_likelihood(x, lam + d) for d in (-0.01, 0.01))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 3.0), (10.0, 3.0), (None, 3.0)], "x double, c double")
    got = stats.histogram(df, ["x", "c"], bins=5).toPandas().sort_values(["variable", "bin"])
    assert got.loc[got["variable"] == "x", "n"].tolist() == [1, 0, 0, 0, 1]
    constant = got[got["variable"] == "c"]
    assert (constant["lower"].min(), constant["upper"].max()) == (2.5, 3.5)
    assert constant["n"].sum() == 3


def test_correlated_columns_flag_in_column_order(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=300)
    rows = np.column_stack([a, rng.normal(size=300), a + 0.1 * rng.normal(size=300), -a])
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double")
    correlations = stats.corr_matrix(df.withColumn("k", F.lit(1.0)), ["a", "b", "c", "d", "k"])
    flagged = {r["feature"] for r in stats.correlated_columns(correlations).collect()}
    assert flagged == {"c", "d"}
    kept = stats.kept_correlations(correlations).toPandas()
    assert set(kept["feature_i"]) | set(kept["feature_j"]) == {"a", "b", "k"}
    assert kept.loc[kept["feature_j"] == "k", "abs_r"].isna().all()


def test_qq_points_with_a_value_held_by_a_third(spark):
    x = np.concatenate([np.full(1_000, 2.0), np.random.default_rng(7).normal(2, 1, 2_000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = stats.qq_points(df, "x").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(1, 3_001))
    np.testing.assert_array_equal(got["sample"], np.sort(x))
    assert got["theoretical"].is_monotonic_increasing
    assert got["theoretical"].iloc[0] == pytest.approx(-got["theoretical"].iloc[-1])


def test_yeo_johnson_of_many_columns(spark):
    """All columns in the same passes give what each gives alone; also with gaps, one constant and one empty column."""
    rng = np.random.default_rng(6)
    rows = [
        (float(a), None if i % 3 == 0 else float(b), 2.0, None)
        for i, (a, b) in enumerate(zip(rng.lognormal(size=600), rng.normal(3, 2, 600) ** 3))
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5).cache()
    found = scale.fit_yeo_johnson_columns(df, ["a", "b", "c", "d"])
    assert found["c"] is None and found["d"] is None

    def likelihood(x, lam):
        k = np.where(x >= 0, lam, 2 - lam)
        y = np.sign(x) * (((1 + np.abs(x)) ** k - 1) / k)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for name, place in (("a", 0), ("b", 1)):
        x = np.array([r[place] for r in rows if r[place] is not None])
        assert scale.fit_yeo_johnson(df, name) == found[name]
        near = [likelihood(x, found[name] + step) for step in (-1e-3, 0.0, 1e-3)]
        assert near[1] >= max(near)
