import math
import statistics

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsmith.functions import ordering, quantiles, scalar
from panelsmith.functions.quantiles import exact_quantiles, order_statistics, sort_keys
from panelsmith.functions.spread import spread_join


def one(spark, expression, value):
    df = spark.createDataFrame([(value,)], "x double")
    return df.select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize("p", [1e-300, 1e-12, 0.01, 0.075, 0.3, 0.5, 0.9, 0.925, 1 - 1e-10])
def test_normal_quantile(spark, p):
    want = statistics.NormalDist().inv_cdf(p)
    assert one(spark, scalar.normal_quantile("x"), p) == pytest.approx(want, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("p", [0.0, 1.0, None])
def test_normal_quantile_outside(spark, p):
    assert one(spark, scalar.normal_quantile("x"), p) is None


def test_transforms_outside_their_domain_give_null(spark):
    assert one(spark, scalar.power_1_5("x"), -2.0) is None
    assert one(spark, scalar.square_root("x"), -2.0) is None
    assert one(spark, scalar.log1p("x"), -1.0) is None
    assert one(spark, scalar.reciprocal("x"), -1e-5) is None
    assert one(spark, scalar.log_clip("x"), None) is None
    assert one(spark, scalar.log_clip("x"), -5.0) == pytest.approx(np.log(1 + 1e-5))
    assert one(spark, scalar.nan_to_null("x"), float("nan")) is None


def test_yeo_johnson_is_continuous_in_lambda(spark):
    for x in (3.0, -3.0):
        for lam in (0.0, 2.0):
            near = one(spark, scalar.yeo_johnson("x", lam + 1e-9), x)
            assert one(spark, scalar.yeo_johnson("x", lam), x) == pytest.approx(near, rel=1e-6)


@pytest.mark.parametrize("inclusive", [False, True])
def test_threshold_tie(spark, inclusive):
    assert one(spark, scalar.above("x", 0.5, inclusive), 0.5) == int(inclusive)


def test_exact_quantiles(spark):
    """The same numbers as a full sort, also with a value held by a third."""
    rng = np.random.default_rng(1)
    smooth = rng.normal(size=30_000) ** 3
    heavy = np.where(np.arange(30_000) % 3 == 0, 7.25, rng.exponential(5, 30_000))
    rows = [
        (float(a), None if i % 5 == 0 else float(b), i % 7)
        for i, (a, b) in enumerate(zip(smooth, heavy, strict=True))
    ]
    df = spark.createDataFrame(rows, "a double, b double, c int").repartition(8).cache()
    q = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], q)
    kept = np.array([r[1] for r in rows if r[1] is not None])
    np.testing.assert_allclose(got["a"], np.quantile(smooth, q), rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(got["b"], np.quantile(kept, q), rtol=1e-12)
    np.testing.assert_allclose(got["c"], np.quantile([r[2] for r in rows], q), rtol=1e-12)


def test_exact_quantiles_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 4.0)] * 9, "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [4.0]}
    assert exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_order_statistics_of_odd_numbers(spark):
    """All ranks of numbers of both signs, many orders of magnitude, infinities, zeros, neighbours and NaN."""
    rng = np.random.default_rng(4)
    numbers = np.r_[
        rng.normal(size=40) * 10.0 ** rng.integers(-300, 300, 40), rng.integers(-3, 3, 20), 5e-324, -5e-324, 0.0, -0.0,
        np.inf, -np.inf, 1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 1.7976931348623157e308, -1.7976931348623157e308,
    ]
    df = spark.createDataFrame([(float(x),) for x in numbers] + [(None,), (float("nan"),)], "x double").repartition(4)
    got = order_statistics(df, {"x": list(range(len(numbers) + 1))})["x"]
    assert got[:-1] == np.sort(numbers).tolist() and math.isnan(got[-1])


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_sort_keys_keep_the_order(numbers):
    values = np.array(numbers)
    keys = sort_keys(values)
    assert ((values[:, None] < values) == (keys[:, None] < keys)).all()
    assert all(quantiles._value(int(k)) == v for k, v in zip(keys, values))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_buckets(spark, descending):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.exponential(size=5_000))
    counts = rng.integers(0, 9, len(keys))
    df = spark.createDataFrame(
        [(float(k), int(c)) for k, c in zip(keys, counts, strict=True)], "key double, n long"
    ).cache()
    table = ordering.running_totals(df, "key", ["n"], descending, n_buckets=37)
    assert table.select("key_bucket").distinct().count() > 20
    followed = ordering.next_in_order(table, "key", F.col("n"), "next_n", descending)
    got = followed.toPandas().sort_values("key", ascending=not descending)
    order = slice(None, None, -1 if descending else 1)
    np.testing.assert_array_equal(got["cum_n"], np.cumsum(counts[order]))
    assert (got["total_n"] == counts.sum()).all()
    np.testing.assert_array_equal(got["next_n"].iloc[:-1], counts[order][1:])
    assert np.isnan(got["next_n"].iloc[-1])


def test_hash_rank_is_a_permutation_per_stratum(spark):
    df = spark.range(3_000).withColumn("s", F.col("id") % 2)
    got = ordering.hash_rank(df, "id", 7, ["s"]).toPandas()
    for _, part in got.groupby("s"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert (part["stratum_size"] == len(part)).all()


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 10), ("d", 1)], "k string, n long")
    got = ordering.repeat_rows(df, F.col("n"), "i", chunk=10).toPandas()
    for key, n in [("a", 25), ("c", 10), ("d", 1)]:
        assert sorted(got.loc[got["k"] == key, "i"]) == list(range(n))
    assert len(got) == 36


def test_spread_join_splits_a_hot_key(spark):
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    lookup = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.length("k"))
    joined = spread_join(rows, lookup, "k", "n")
    got = joined.toPandas()
    assert len(got) == 9_000 and got["id"].is_unique
    assert (got["v"] == got["k"].str.len()).all()
