"""Training, scoring, tuning and the whole training flow."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith import presets
from panelsmith.functions.scalar import above
from panelsmith.operators import models, stats, tune
from panelsmith.operators.boosting import PatientBoosting
from panelsmith.operators.classify import GaussianNaiveBayes
from panelsmith.operators.resample import ClassWeights
from panelsmith.operators.validate import union_all
from panelsmith.plans.catalog.evaluation_queries import auc_sql, counts_sql, metrics_sql
from panelsmith.plans.catalog.registry import query, round_columns, rounded, rounded_sql
from panelsmith.plans.fixtures import LI_KEYS, MEASURES, emb, panel, qual, table, with_views
from panelsmith.plans.preprocess import fit_preprocessing
from panelsmith.plans.training import train_and_evaluate, train_and_select
from panelsmith.session import cut_lineage, scratch_path
from panelsmith.sources.tables import load_model, save_model

_NB_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *LI_KEYS,
        *_NB_FEATURES,
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


def bayes_sql(smoothing: str, priors: tuple[str, str] | None) -> str:
    """Gaussian naive Bayes of l_returnflag = 'R' over the lines, from class means and variances."""
    greatest = ", ".join(f"var_pop({c})" for c in _NB_FEATURES)
    fitted = ", ".join(
        f"avg({c}) FILTER (label = {k}) AS m{k}_{c}, var_pop({c}) FILTER (label = {k}) "
        f"+ CAST({smoothing} AS DOUBLE) * greatest({greatest}) AS v{k}_{c}"
        for k in (0, 1)
        for c in _NB_FEATURES
    )
    shares = (
        [f"count(*) FILTER (label = {k}) / CAST(count(*) AS DOUBLE)" for k in (0, 1)]
        if priors is None
        else [f"CAST({p} AS DOUBLE)" for p in priors]
    )

    def likelihood(k: int) -> str:
        terms = [
            f"- 0.5 * ln(2 * pi() * v{k}_{c}) - ({c} - m{k}_{c}) * ({c} - m{k}_{c}) / (2 * v{k}_{c})"
            for c in _NB_FEATURES
        ]
        return f"(ln(prior{k}) {' '.join(terms)})"

    return with_views(
        f"""SELECT {", ".join(LI_KEYS)}, {rounded_sql("1 / (1 + exp(gap))")} AS p1,
        CAST(gap < 0 AS INTEGER) AS prediction
        FROM (SELECT *, {likelihood(0)} - {likelihood(1)} AS gap FROM lines, fit)""",
        lines=f"""SELECT {", ".join(LI_KEYS + _NB_FEATURES)},
                  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem""",
        fit=f"""SELECT {fitted}, {shares[0]} AS prior0, {shares[1]} AS prior1 FROM lines""",
    )


def _bayes_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows).select(*LI_KEYS, "p1", "prediction")
    return round_columns(scored, ["p1"])


@query("gaussian_nb", bayes_sql("1e-9", None))
def gaussian_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    bayes = GaussianNaiveBayes(_NB_FEATURES, "label")
    return _bayes_scores(Pipeline(stages=[bayes]).fit(rows), rows)


@query("gaussian_nb_priors", bayes_sql("1e-5", ("0.6", "0.4")))
def gaussian_nb_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    bayes = GaussianNaiveBayes(_NB_FEATURES, "label", var_smoothing=1e-5, priors=[0.6, 0.4])
    return _bayes_scores(Pipeline(stages=[bayes]).fit(rows), rows)


@query("model_round_trip", bayes_sql("1e-9", None))
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved, loaded and scored."""
    rows = _lines(spark, sf_dir)
    model = Pipeline(stages=[GaussianNaiveBayes(_NB_FEATURES, "label")]).fit(rows)
    path = save_model(model, scratch_path(spark, "models"), "Naive Bayes")
    return _bayes_scores(load_model(path), rows)


def _emb_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The vectors as one column per dimension, in an order that does not depend on files or cluster."""
    names = [f"d{i:02d}" for i in range(64)]
    df = emb(spark, sf_dir).select(
        "vec_id", *[F.col("vec")[i].alias(n) for i, n in enumerate(names)], "y"
    )
    return models.fixed_order(cut_lineage(df)), names


def _forest(df: DataFrame, names: list[str]) -> PipelineModel:
    forest = models.random_forest("y", n_trees=20, max_depth=6, weight="weight")
    return models.scaled_pipeline(forest, names, weights=ClassWeights("y", "balanced")).fit(df)


def _scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = models.score(model, df)
    return scored.select("vec_id", "y", rounded("p1", 4).alias("p1"), "pred")


@query("random_forest")
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _emb_columns(spark, sf_dir)
    return _scores(_forest(df, names), df)


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _emb_columns(spark, sf_dir)
    return stats.feature_importance(spark, _forest(df, names))


def _boosted(df: DataFrame, names: list[str]) -> PipelineModel:
    trees = models.boosted_trees("y", max_depth=4, learning_rate=0.1, n_rounds=10)
    return models.scaled_pipeline(trees, names, scale=False).fit(df)


@query("boosted_trees")
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _emb_columns(spark, sf_dir)
    return _scores(_boosted(df, names), df)


@query("boosted_trees_patience")
def boosted_trees_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the rows is held out; boosting stops after 4 rounds without a smaller error on it."""
    df, names = _emb_columns(spark, sf_dir)
    marked = df.withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0)
    patient = PatientBoosting(models.boosted_trees("y", 4, 0.1, 12), "held", patience=4)
    return _scores(models.scaled_pipeline(patient, names, scale=False).fit(marked), df)


@query("split_count_importance")
def split_count_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _emb_columns(spark, sf_dir)
    return stats.split_count_importance(spark, _boosted(df, names))


@query("logistic_regression")
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _emb_columns(spark, sf_dir)
    weights = ClassWeights("y", "balanced")
    total = models.total_weight(weights.fit(df).transform(df), "weight")
    regression = models.logistic_regression("y", total, weight="weight")
    return _scores(models.scaled_pipeline(regression, names, weights=weights).fit(df), df)


@query("logistic_elastic_net")
def logistic_elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _emb_columns(spark, sf_dir)
    weights = ClassWeights("y", "balanced")
    total = models.total_weight(weights.fit(df).transform(df), "weight")
    regression = models.logistic_regression("y", total, weight="weight", c=0.5, penalty="elasticnet", l1_ratio=0.4)
    return _scores(models.scaled_pipeline(regression, names, weights=weights).fit(df), df)


@query("logistic_lasso")
def logistic_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _emb_columns(spark, sf_dir)
    weights = ClassWeights("y", "balanced")
    total = models.total_weight(weights.fit(df).transform(df), "weight")
    regression = models.logistic_regression("y", total, weight="weight", c=0.5, penalty="l1")
    return _scores(models.scaled_pipeline(regression, names, weights=weights).fit(df), df)


def logistic_sql(steps: int = 12) -> str:
    """Newton steps of balanced logistic regression of document quality on its scaled length."""
    views = {
        "scaled": """SELECT doc_id, quality AS y, (n_chars - avg(n_chars) OVER ())
            / stddev_pop(n_chars) OVER () AS x,
            count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY quality)) AS w FROM qual""",
        "b0": "SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b",
    }
    for i in range(steps):
        # penalty: half the squared slope; the intercept is free
        views[f"s{i}"] = f"""SELECT max(a) AS a, max(b) AS b, sum(w * (y - p)) AS ga,
            sum(w * (y - p) * x) - max(b) AS gb, sum(w * p * (1 - p)) AS haa,
            sum(w * p * (1 - p) * x) AS hab, sum(w * p * (1 - p) * x * x) + 1 AS hbb
            FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM scaled, b{i})"""
        views[f"b{i + 1}"] = f"""SELECT a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
            b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM s{i}"""
    return with_views(
        f"""SELECT doc_id, {rounded_sql("p", 4)} AS p1, CAST(p > 0.5 AS INTEGER) AS pred
        FROM (SELECT doc_id, 1 / (1 + exp(-(a + b * x))) AS p FROM scaled, b{steps})""",
        "qual",
        **views,
    )


@query("logistic_regression_documents", logistic_sql())
def logistic_regression_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document quality by length, balanced, converged far enough to compare with Newton's method."""
    rows = qual(spark, sf_dir).select("doc_id", "n_chars", "quality")
    weights = ClassWeights("quality", "balanced")
    total = models.total_weight(weights.fit(rows).transform(rows), "weight")
    regression = models.logistic_regression("quality", total, weight="weight", tol=1e-12)
    pipeline = models.scaled_pipeline(regression, ["n_chars"], weights=weights)
    scored = models.score(pipeline.fit(rows), rows)
    return scored.select("doc_id", rounded("p1", 4).alias("p1"), "pred")


@query(
    "score",
    f"""SELECT {", ".join(LI_KEYS)}, p1, CAST(p1 > 0.5 AS INTEGER) AS pred
    FROM ({bayes_sql("1e-9", None)})""",
)
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    model = Pipeline(stages=[GaussianNaiveBayes(_NB_FEATURES, "label")]).fit(rows)
    scored = models.score(model, rows).withColumn("p1", rounded("p1"))
    return scored.withColumn("pred", above("p1")).select(*LI_KEYS, "p1", "pred")


_QUALITY_FEATURES = ["n_chars", "n_words", "chars_per_word"]
_DRAWS = tune.sample_params(tune.NAIVE_BAYES_SPACE, 5)


def _search_views(draws: list[dict]) -> dict[str, str]:
    """Predictions of scaled naive Bayes for every fold, fitted on the others, per draw."""
    candidates = " UNION ALL ".join(
        f"SELECT {i} AS candidate, '{json.dumps(d, sort_keys=True)}' AS params, "
        f"CAST({d['var_smoothing']!r} AS DOUBLE) AS smoothing, "
        + ", ".join(
            f"CAST({'NULL' if d['priors'] is None else d['priors'][k]} AS DOUBLE) AS prior{k}"
            for k in (0, 1)
        )
        for i, d in enumerate(draws)
    )
    overall = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _QUALITY_FEATURES)
    by_class = ", ".join(
        f"avg({c}) FILTER (quality = {k}) AS m{k}_{c}, var_pop({c}) FILTER (quality = {k}) AS v{k}_{c}"
        for k in (0, 1)
        for c in _QUALITY_FEATURES
    )

    def likelihood(k: int) -> str:
        # in standard units: the class variance over the overall one, plus the smoothing
        terms = [
            f"- 0.5 * ln(v{k}_{c} / v_{c} + smoothing) - ({c} - m{k}_{c}) * ({c} - m{k}_{c}) / v_{c} "
            f"/ (2 * (v{k}_{c} / v_{c} + smoothing))"
            for c in _QUALITY_FEATURES
        ]
        return f"(ln(coalesce(prior{k}, n{k} / n)) {' '.join(terms)})"

    return {
        "dealt": """SELECT *, (row_number() OVER (
            PARTITION BY quality ORDER BY md5(concat(doc_id, ':42')), doc_id) - 1) % 5 AS fold
            FROM qual""",
        "fitted": f"""SELECT f, {overall}, {by_class}, CAST(count(*) AS DOUBLE) AS n,
            count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1
            FROM dealt, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY f""",
        "candidates": candidates,
        "predicted": f"""SELECT candidate, params, fold, quality AS y,
            1 / (1 + exp({likelihood(0)} - {likelihood(1)})) AS p1,
            CASE WHEN {likelihood(0)} < {likelihood(1)} THEN 1 ELSE 0 END AS z
            FROM dealt JOIN fitted ON f = fold, candidates""",
    }


def search_sql(draws: list[dict]) -> str:
    """Mean F1 over five folds per draw of smoothing and priors."""
    return with_views(
        f"""SELECT candidate, params, {rounded_sql("avg(f1)")} AS mean_f1, TRUE AS succeeded
        FROM (SELECT candidate, params, fold,
                coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0) AS f1
              FROM (SELECT candidate, params, fold,
                      CAST(count(*) FILTER (z = 1 AND y = 1) AS DOUBLE) AS tp,
                      count(*) FILTER (z <> y) AS wrong
                    FROM predicted GROUP BY candidate, params, fold))
        GROUP BY candidate, params""",
        "qual",
        **_search_views(draws),
    )


@query("random_search_cv", search_sql(_DRAWS))
def random_search_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of naive Bayes hyperparameters for document quality, compared over five folds."""
    rows = cut_lineage(tune.row_folds(qual(spark, sf_dir), "doc_id", "quality"))
    found = tune.random_search(
        rows,
        "quality",
        _DRAWS,
        lambda params, _: models.scaled_pipeline(
            GaussianNaiveBayes(_QUALITY_FEATURES, "quality", **params), _QUALITY_FEATURES
        ),
    )
    return found.table.select(
        "candidate",
        "params",
        rounded("mean_f1").alias("mean_f1"),
        F.col("error").isNull().alias("succeeded"),
    )


@query(
    "train_and_evaluate",
    with_views(
        f"""SELECT 'Naive Bayes' AS model, *,
        (SELECT {rounded_sql("auc")} FROM ({auc_sql("p1", "held_out")})) AS "AUC-ROC"
        FROM ({metrics_sql(counts_sql("z", "held_out"))})""",
        "qual",
        **_search_views([{"var_smoothing": 1e-9, "priors": None}]),
        held_out="SELECT y, z, p1 FROM predicted WHERE fold = 0",
    ),
)
def train_and_evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document quality by naive Bayes: four folds train, one is held out and scored."""
    rows = cut_lineage(tune.row_folds(qual(spark, sf_dir), "doc_id", "quality"))
    bayes = GaussianNaiveBayes(_QUALITY_FEATURES, "quality")
    pipeline = models.scaled_pipeline(bayes, _QUALITY_FEATURES)
    metrics, _ = train_and_evaluate(
        "Naive Bayes", pipeline, rows.where("fold <> 0"), rows.where("fold = 0"), "quality"
    )
    return round_columns(metrics, presets.METRIC_NAMES)


@query("train_and_select")
def train_and_select_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow on the panel: metrics of every model and of the best one on the test rows."""
    rows = cut_lineage(panel(spark, sf_dir))
    run = train_and_select(
        rows,
        "entity_id",
        "hour",
        "label",
        lambda train: fit_preprocessing(
            train,
            impute=["hour", *MEASURES],
            one_hot=["gender"],
            log=["temp", "map"],
            scale=list(MEASURES),
            max_iter=10,
        ),
        params={
            "Random Forest": {
                "n_trees": 10,
                "max_depth": 6,
                "min_samples_split": 2,
                "min_samples_leaf": 1,
            },
            "Naive Bayes": {"var_smoothing": 1e-9},
            "KNN": {"k": 5},
            "Logistic Regression": {"max_iter": 100},
            "Boosted Trees": {"max_depth": 4, "learning_rate": 0.1, "n_rounds": 8},
        },
        ratio=0.1,
        k_smote=5,
    )
    metrics = union_all([run.metrics.drop("seq"), run.test_metrics])
    return round_columns(metrics, [c for c in metrics.columns if c != "model"], 4)
