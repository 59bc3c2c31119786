import json
import math
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelsmith import presets
from panelsmith.operators import boosting, models, stats, tune
from panelsmith.operators.classify import GaussianNaiveBayes, KnnClassifier
from panelsmith.operators.resample import ClassWeights
from panelsmith.plans.preprocess import default_preprocessing, fit_preprocessing
from panelsmith.plans.training import train_and_select
from panelsmith.sources.tables import TableError, load_model

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(16)
    x = rng.normal(size=(600, 3)) * [1, 10, 0.5]
    y = (x[:, 0] + 0.05 * x[:, 1] + 0.3 * rng.normal(size=600) > 1).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(*data, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").cache()


@pytest.mark.parametrize("priors", [None, [0.7, 0.3]])
def test_naive_bayes(frame, data, priors):
    x, y = data
    model = GaussianNaiveBayes(X, "y", 1e-3, priors).fit(frame)
    got = model.transform(frame).orderBy("id").toPandas()
    extra = 1e-3 * x.var(0).max()
    joint = []
    for c in (0, 1):
        m, v = x[y == c].mean(0), x[y == c].var(0) + extra
        prior = (y == c).mean() if priors is None else priors[c]
        joint.append(
            np.log(prior) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(1)
        )
    want = 1 / (1 + np.exp(joint[0] - joint[1]))
    np.testing.assert_allclose(got["p1"], want, rtol=1e-9)
    assert (got["prediction"] == (joint[1] > joint[0])).all()


def test_naive_bayes_needs_both_classes(frame):
    with pytest.raises(TableError):
        GaussianNaiveBayes(X, "y").fit(frame.where("y = 0"))


@pytest.mark.parametrize("class_weight", ["balanced", {0: 1, 1: 2}, None])
def test_logistic_regression_gradient(frame, data, class_weight):
    x, y = data
    weights = ClassWeights("y", class_weight)
    weighted = weights.fit(frame).transform(frame)
    total = models.total_weight(weighted, "weight")
    regression = models.logistic_regression("y", total, c=0.5, weight="weight", tol=1e-12)
    model = models.scaled_pipeline(regression, X, scale=False, weights=weights).fit(frame)
    w = np.array([r["weight"] for r in weighted.orderBy("id").collect()])
    assert w.sum() == pytest.approx(total)
    beta, intercept = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    p = 1 / (1 + np.exp(-(x @ beta + intercept)))
    np.testing.assert_allclose(0.5 * x.T @ (w * (p - y)) + beta, 0, atol=1e-3)
    assert abs((w * (p - y)).sum()) < 1e-3
    scored = models.score(model, frame).orderBy("id").toPandas()
    np.testing.assert_allclose(scored["p1"], p, rtol=1e-9, atol=1e-15)


def test_forest_and_importance(spark, frame):
    forest = models.random_forest("y", 15, None, min_samples_split=9, min_samples_leaf=2)
    assert (forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (30, 4)
    model = models.scaled_pipeline(models.random_forest("y", 15, 5), X).fit(frame)
    table = stats.feature_importance(spark, model).collect()
    assert sum(r["importance"] for r in table) == pytest.approx(1)
    assert table[0]["feature"] == "a"
    assert stats.feature_importance(spark, model, top=1).count() == 1
    splits = stats.split_count_importance(spark, model).collect()
    inner = sum((t.numNodes - 1) // 2 for t in model.stages[-1].trees)
    assert sum(r["importance"] for r in splits) == inner
    with pytest.raises(AttributeError):
        stats.feature_importance(spark, Pipeline(stages=[GaussianNaiveBayes(X, "y")]).fit(frame))


def test_boosted_trees_stop_on_validation_rows(frame):
    marked = frame.withColumn("held", F.col("id") % 4 == 0)
    trees = models.boosted_trees("y", 3, 0.1, 25, validation="held", validation_tol=0.05)
    model = models.scaled_pipeline(trees, X, scale=False).fit(marked)
    assert 1 <= model.stages[-1].getNumTrees < 25


@pytest.mark.parametrize(("penalty", "ratio"), [("l1", 1.0), ("elasticnet", 0.4)])
def test_penalised_logistic_optimality(frame, data, penalty, ratio):
    """The gradient of the loss meets the subgradient of the penalty in every coefficient."""
    x, y = data
    regression = models.logistic_regression("y", len(y), 0.05, penalty, ratio, tol=1e-12)
    last = models.scaled_pipeline(regression, X, scale=False).fit(frame).stages[-1]
    beta, p = last.coefficients.toArray(), 1 / (1 + np.exp(-(x @ last.coefficients.toArray() + last.intercept)))
    gradient = 0.05 * x.T @ (p - y) + (1 - ratio) * beta
    np.testing.assert_allclose(gradient[beta != 0], -ratio * np.sign(beta[beta != 0]), atol=1e-3)
    assert (abs(gradient[beta == 0]) <= ratio + 1e-3).all()


@pytest.fixture(scope="module")
def boosted(frame):
    trees = models.boosted_trees("y", 3, 0.3, 12)
    marked = frame.withColumn("held", F.col("id") % 3 == 0)
    train = VectorAssembler(inputCols=X, outputCol="features").transform(marked)
    return trees, train, trees.fit(train.where("NOT held"))


@pytest.mark.parametrize("metric", ["error", "logloss", "auc"])
def test_staged_metrics_equal_scoring_every_prefix(boosted, metric):
    _, train, model = boosted
    held = train.where("held")
    got = [r["value"] for r in boosting.staged_metrics(model, held, metric).collect()]
    assert len(got) == model.getNumTrees == 12
    for n in (1, 2, 7, 12):
        prefix = boosting.first_rounds(model, n)
        assert prefix.getNumTrees == n and prefix.getLabelCol() == "y"
        scored = models.score(PipelineModel([prefix]), held).select("y", "p1", "pred").toPandas()
        y, p = scored["y"].to_numpy(), scored["p1"].to_numpy()
        want = {
            "error": (scored["pred"] != y).mean(),
            "logloss": -np.log(np.where(y == 1, p, 1 - p)).mean(),
            "auc": np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]),
        }[metric]
        assert got[n - 1] == pytest.approx(want, rel=1e-9)


def test_prefix_is_the_shorter_training(boosted):
    trees, train, model = boosted
    short = trees.copy({trees.maxIter: 5}).fit(train.where("NOT held"))
    assert short.toDebugString.split("\n")[1:] == boosting.first_rounds(model, 5).toDebugString.split("\n")[1:]
    with pytest.raises(ValueError):
        boosting.first_rounds(model, 13)


def test_best_round():
    assert boosting.best_round([5, 4, 4, 4, 3], 3) == 5
    assert boosting.best_round([5, 4, 4, 4, 3], 2) == 2  # two rounds without a better one: stopped
    assert boosting.best_round([1, 1, 1], 9) == 1  # ties keep the earlier round
    assert boosting.best_round([0.5, 0.7, 0.6], 9, greater_is_better=True) == 2


def test_patience_cuts_the_model_and_survives_saving(spark, frame, tmp_path):
    marked = frame.withColumn("held", F.col("id") % 3 == 0)
    patient = boosting.PatientBoosting(models.boosted_trees("y", 3, 0.3, 12), "held", 2)
    model = models.scaled_pipeline(patient, X, scale=False).fit(marked)
    kept = boosting.best_round(patient.staged, 2)
    assert model.stages[-1].getNumTrees == kept < 12 == len(patient.staged)
    assert stats.feature_importance(spark, model).count() == 3
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (models.score(m, frame).orderBy("id").toPandas()["p1"] for m in (model, again))
    np.testing.assert_array_equal(a, b)
    with pytest.raises(TableError):
        models.scaled_pipeline(patient, X, scale=False).fit(marked.withColumn("held", F.lit(False)))


def test_draws_are_in_range_and_repeat():
    draws = tune.sample_params(tune.LOGISTIC_SPACE, 200)
    assert draws == tune.sample_params(tune.LOGISTIC_SPACE, 200)
    assert draws != tune.sample_params(tune.LOGISTIC_SPACE, 200, seed=1)
    assert all(0.001 <= d["c"] <= 100.001 and 0 <= d["l1_ratio"] <= 1 for d in draws)
    assert {d["penalty"] for d in draws} == {"l1", "l2", "elasticnet"}
    assert {d["k"] for d in tune.sample_params(tune.KNN_SPACE, 500)} == set(range(3, 20))
    smoothing = {d["var_smoothing"] for d in tune.sample_params(tune.NAIVE_BAYES_SPACE, 2_000)}
    assert len(smoothing) == 100
    assert (min(smoothing), max(smoothing)) == (pytest.approx(1e-11), pytest.approx(1e-5))


def test_folds(spark):
    rows = spark.range(1_000).select(
        (F.col("id") % 90).cast("string").alias("e"), "id", (F.col("id") % 9 == 0).cast("int").alias("y")
    )
    grouped = tune.entity_folds(rows, "e", "y").toPandas()
    assert (grouped.groupby("e")["fold"].nunique() == 1).all()
    assert grouped.drop_duplicates("e").groupby("fold").size().tolist() == [18] * 5
    plain = tune.row_folds(rows, "id", "y").toPandas()
    sizes = plain.groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_search_lists_failures_and_resamples_training_rows_only(frame):
    seen = []

    def resample(df):
        seen.append(df.count())
        return df.unionByName(df.where("y = 1"))

    def build(params, _):
        return models.scaled_pipeline(GaussianNaiveBayes(X, "y", **params), X)

    rows = tune.row_folds(frame, "id", "y", 3).cache()
    candidates = [{"priors": [0.5, 0.4]}, {"priors": [0.999, 0.001]}, {"priors": None}]
    found = tune.random_search(rows, "y", candidates, build, 3, resample=resample)
    table = {r["candidate"]: r for r in found.table.collect()}
    assert table[0]["mean_f1"] is None and "priors" in table[0]["error"]
    assert found.params == {"priors": None} and found.f1 == table[2]["mean_f1"]
    assert len(seen) == 4 and seen[-1] == 600 and sum(seen[:3]) == 1_200


def test_knn_pipeline_survives_saving(frame, tmp_path):
    model = models.scaled_pipeline(KnnClassifier(X, "y", "id", 3, p=1), X).fit(frame)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))

    def scores(m):
        return [tuple(r) for r in models.score(m, frame).select("id", "p1", "pred").orderBy("id").collect()]

    assert scores(again) == scores(model)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(17)
    rows = []
    for e in range(60):
        level = rng.normal()
        for t in range(12):
            u, v = level + rng.normal(), 2 * level + rng.normal()
            positive = int(level > 0.4 and u > 0.8)
            gap = rng.random(2) < 0.2
            rows.append(
                (
                    f"e{e}",
                    t,
                    None if gap[0] else float(u),
                    None if gap[1] else float(v + 10),
                    int(e % 2),
                    positive,
                )
            )
    return spark.createDataFrame(rows, "e string, t long, u double, v double, g int, y int").cache()


def test_training_flow(spark, panel, tmp_path):
    def preprocess(train):
        return fit_preprocessing(
            train, impute=["t", "u", "v"], one_hot=["g"], log=["v"], scale=["u", "v"], max_iter=3
        )

    def run(folder=None):
        return train_and_select(
            panel,
            "e",
            "t",
            "y",
            preprocess,
            params={"Naive Bayes": {}, "Logistic Regression": {"penalty": "no such penalty"}},
            search={"Boosted Trees": ({"n_rounds": [2], "max_depth": [2]}, 1)},
            ratio=0.6,
            k_smote=3,
            n_folds=2,
            folder=folder,
        )

    first, second = run(str(tmp_path)), run()
    assert set(first.errors) == {"Logistic Regression"}
    names = [r["model"] for r in first.metrics.orderBy("seq").collect()]
    assert names == ["Naive Bayes", "Boosted Trees"]
    assert first.metrics.orderBy("seq").collect() == second.metrics.orderBy("seq").collect()
    assert first.best == second.best
    f1 = {r["model"]: r[presets.METRIC_NAMES[3]] for r in first.metrics.collect()}
    assert f1[first.best] == max(f1.values()) > 0
    after = {
        (r["stage"], r["y"]): r["n"] for r in first.distributions.collect()
    }
    assert after["after", 1] > after["before", 1] and after["after", 0] <= after["before", 0]
    assert os.path.exists(tmp_path / "boosted_trees_tuned_params")
    assert sorted(os.listdir(tmp_path / "splits"))[-3:] == ["split=test", "split=train", "split=val"]
    assert first.correlations.count() > 0
    cells = first.confusion.toPandas()
    assert cells.groupby("model").size().to_dict() == {"Naive Bayes": 4, "Boosted Trees": 4}
    assert cells.groupby("model")["n"].sum().nunique() == 1
    assert {r["model"] for r in first.importances.collect()} == {"Boosted Trees"}
    for curve in (first.roc, first.pr):
        assert {r["model"] for r in curve.select("model").distinct().collect()} == set(names)
    assert second.roc is None
    loaded = load_model(first.path)
    new = panel.withColumn("row_id", F.concat_ws(":", "e", "t")).withColumnRenamed("e", "entity_key")
    assert models.score(loaded, new).count() == 720


def test_flow_from_given_splits_and_tuned_weights(spark, panel, tmp_path):
    """Given splits give the same model; a class weight by number is stored; nothing written is left."""
    from panelsmith.operators.split import split_frames, split_grouped
    from panelsmith.session import shared_folder

    def run(rows, folder=None):
        return train_and_select(
            rows,
            "e",
            "t",
            "y",
            lambda train: fit_preprocessing(train, impute=["t", "u", "v"], scale=["u", "v"], max_iter=3),
            params={},
            search={"Logistic Regression": ({"class_weight": [{0: 1, 1: 2}], "max_iter": [50]}, 1)},
            ratio=0.6,
            k_smote=3,
            n_folds=2,
            folder=folder,
        )

    tables = f"{shared_folder(spark)}/panelsmith-tables"
    before = set(os.listdir(tables)) if os.path.exists(tables) else set()
    frames = split_frames(split_grouped(panel, "e", "y"))
    kept = set(os.listdir(tables))
    whole, given = run(panel), run(frames, str(tmp_path))
    assert set(os.listdir(tables)) == kept >= before
    assert whole.errors == given.errors == {}
    assert whole.metrics.collect() == given.metrics.collect()
    name = next(f for f in os.listdir(tmp_path / "logistic_regression_tuned_params") if f.startswith("part"))
    stored = json.loads((tmp_path / "logistic_regression_tuned_params" / name).read_text())
    assert stored == {"class_weight": {"0": 1.0, "1": 2.0}, "max_iter": 50}


def test_flow_refuses_repeated_rows(panel):
    with pytest.raises(TableError, match="unique"):
        train_and_select(panel.union(panel.limit(3)), "e", "t", "y", lambda train: None)


@pytest.mark.parametrize("make", ["forest", "boosted"])
def test_trees_repeat_for_any_layout(spark, panel, make):
    """The same rows in another order and another number of files give the same trees."""
    rows = panel.where("u is not null and v is not null").select("e", "t", "u", "v", "y")

    def p1(df):
        trees = models.random_forest("y", 8, 4) if make == "forest" else models.boosted_trees("y", 3, n_rounds=4)
        model = models.scaled_pipeline(trees, ["u", "v"], scale=False).fit(models.fixed_order(df))
        return models.score(model, rows).orderBy("e", "t").select("p1").collect()

    first = p1(rows.coalesce(1))
    assert first == p1(rows.repartition(13, "t")) == p1(rows.orderBy(F.rand(3)))


def test_default_preprocessing(spark):
    rng = np.random.default_rng(18)
    names = [
        *presets.REDUNDANT_COLUMNS,
        *presets.SPARSE_COLUMNS[:-1],
        *presets.SCALED_COLUMNS,
    ]
    rows = []
    for i in range(120):
        values = [None if rng.random() < 0.2 else float(v) for v in rng.gamma(3, 2, len(names))]
        rows.append((str(i // 10), i % 10, i % 2, 1.0, 0.0, int(i % 15 == 0), *values))
    fields = ["Patient_ID string", "Hour long", "Gender int", "Unit1 double", "Unit2 double"]
    schema = ", ".join([*fields, "SepsisLabel int", *[f"`{n}` double" for n in names]])
    df = spark.createDataFrame(rows, schema)
    out = default_preprocessing(df, max_iter=2).transform(df)
    kept = {"Hour", "Unit1", "Unit2", "SepsisLabel", "Gender_0", "Gender_1"}
    assert set(out.columns) == kept | set(presets.SCALED_COLUMNS)
    assert out.count() == 120
    median = out.agg(F.percentile("HR", 0.5)).first()[0]
    assert math.isclose(median, 0, abs_tol=1e-12)


def test_flow_builder_stops_boosting_by_validation_rows(frame):
    from panelsmith.plans import training

    train, val = frame.where("id % 3 > 0"), frame.where("id % 3 = 0")
    marked = training._with_stopping_rows(train, val)
    build = training.builders(X, "y")[training.BOOSTED]
    values = {"max_depth": 3, "learning_rate": 0.3, "n_rounds": 10, "patience": 2}
    pipeline = build(values, marked)
    model = pipeline.fit(models.fixed_order(marked))
    staged = pipeline.getStages()[-1].staged
    assert model.stages[-1].getNumTrees == boosting.best_round(staged, 2) <= len(staged) == 10
    assert models.score(model, val).where("p1 IS NULL").count() == 0
    plain = build({"max_depth": 2, "n_rounds": 2, "patience": 2}, train).fit(train)
    assert plain.stages[-1].getNumTrees == 2
