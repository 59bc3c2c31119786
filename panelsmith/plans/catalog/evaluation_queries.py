"""Confusion counts, metrics, curves and model choice on scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith import presets
from panelsmith.functions.scalar import above
from panelsmith.operators import evaluate
from panelsmith.operators.validate import union_all
from panelsmith.plans.catalog.registry import query, round_columns, rounded_sql
from panelsmith.plans.fixtures import scored, with_views
from panelsmith.session import scratch_path
from panelsmith.sources.tables import write_metrics, write_params

_THRESHOLD_METRICS = presets.METRIC_NAMES[:6]

_CELLS = """
SELECT a AS actual, z AS predicted, (SELECT count(*) FROM scored WHERE y = a AND pred = z) AS n
FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS z)"""


@query("confusion_matrix", with_views(_CELLS, "scored"))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(scored(spark, sf_dir), "y", "pred")


@query(
    "confusion_matrix_normalized",
    with_views(
        f"""SELECT actual, predicted, {rounded_sql(
            "coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0)")} AS share FROM cells""",
        "scored",
        cells=_CELLS,
    ),
)
def confusion_matrix_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = evaluate.confusion_matrix_normalized(scored(spark, sf_dir), "y", "pred")
    return round_columns(shares, ["share"])


def counts_sql(prediction: str, source: str = "scored") -> str:
    return f"""
SELECT CAST(count(*) FILTER (y = 1 AND z = 1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (y = 0 AND z = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (y = 1 AND z = 0) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (y = 0 AND z = 0) AS DOUBLE) AS tn
FROM (SELECT y, {prediction} AS z FROM {source})"""


def metrics_sql(counts: str) -> str:
    values = [
        "(tp + tn) / (tp + fp + fn + tn)",
        "coalesce(tp / nullif(tp + fp, 0), 0)",
        "coalesce(tp / nullif(tp + fn, 0), 0)",
        "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
        "(fp + fn) / (tp + fp + fn + tn)",
        "sqrt((fp + fn) / (tp + fp + fn + tn))",
    ]
    columns = ", ".join(
        f'{rounded_sql(v)} AS "{name}"'
        for v, name in zip(values, _THRESHOLD_METRICS, strict=True)
    )
    return f"SELECT {columns} FROM ({counts})"


def auc_sql(score: str, source: str = "scored") -> str:
    return f"""
SELECT sum(pos * (below + neg / CAST(2 AS DOUBLE)))
  / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
FROM (SELECT pos, neg, coalesce(sum(neg) OVER (
        ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {score} AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
            FROM {source} GROUP BY 1))"""


@query(
    "classification_metrics",
    with_views(
        f"""SELECT *, (SELECT {rounded_sql("auc")} FROM ({auc_sql("p")})) AS "AUC-ROC"
        FROM ({metrics_sql(counts_sql("pred"))})""",
        "scored",
    ),
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = evaluate.classification_metrics(scored(spark, sf_dir), "y", "pred", "p")
    return round_columns(metrics, presets.METRIC_NAMES)


@query("auc_roc", with_views(f"SELECT {rounded_sql('auc')} AS auc FROM ({auc_sql('p')})", "scored"))
def auc_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(evaluate.auc_roc(scored(spark, sf_dir), "y", "p"), ["auc"])


@query(
    "auc_roc_fine",
    with_views(f"SELECT {rounded_sql('auc')} AS auc FROM ({auc_sql('fine')})", "scored"),
)
def auc_roc_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Almost as many distinct scores as rows."""
    return round_columns(evaluate.auc_roc(scored(spark, sf_dir), "y", "fine"), ["auc"])


def _steps(score: str) -> dict[str, str]:
    return {
        "per_score": f"""SELECT {score} AS s, count(*) FILTER (y = 1) AS pos,
            count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1""",
        "steps": """SELECT s, pos, neg, row_number() OVER (ORDER BY s DESC) AS i,
            lead(pos) OVER (ORDER BY s DESC) AS next_pos,
            lead(neg) OVER (ORDER BY s DESC) AS next_neg,
            CAST(sum(pos) OVER (ORDER BY s DESC) AS DOUBLE) AS cum_pos,
            CAST(sum(neg) OVER (ORDER BY s DESC) AS DOUBLE) AS cum_neg,
            sum(pos) OVER () AS total_pos, sum(neg) OVER () AS total_neg FROM per_score""",
    }


_ROC_POINTS = f"""
SELECT {rounded_sql("s", 8)} AS threshold, {rounded_sql("cum_neg / total_neg", 8)} AS fpr,
  {rounded_sql("cum_pos / total_pos", 8)} AS tpr FROM steps"""
_ROC_START = "SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr"
_ROC_KEPT = "WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"


@query(
    "roc_curve",
    with_views(f"{_ROC_START} UNION ALL {_ROC_POINTS}", "scored", **_steps("p")),
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = evaluate.roc_curve(scored(spark, sf_dir), "y", "p", drop_collinear=False)
    return round_columns(points, ["threshold", "fpr", "tpr"], 8)


@query(
    "roc_curve_reduced",
    with_views(f"{_ROC_START} UNION ALL {_ROC_POINTS} {_ROC_KEPT}", "scored", **_steps("fine")),
)
def roc_curve_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the points on straight pieces, for almost as many distinct scores as rows."""
    points = evaluate.roc_curve(scored(spark, sf_dir), "y", "fine")
    return round_columns(points, ["threshold", "fpr", "tpr"], 8)


@query(
    "pr_curve",
    with_views(
        f"""SELECT {rounded_sql("s", 8)} AS threshold,
          {rounded_sql("cum_pos / (cum_pos + cum_neg)", 8)} AS precision,
          {rounded_sql("cum_pos / total_pos", 8)} AS recall FROM steps
        UNION ALL SELECT NULL, 1, 0""",
        "scored",
        **_steps("fine"),
    ),
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = evaluate.pr_curve(scored(spark, sf_dir), "y", "fine")
    return round_columns(points, ["threshold", "precision", "recall"], 8)


@query(
    "average_precision",
    with_views(
        f"""SELECT {rounded_sql("sum(pos / CAST(total_pos AS DOUBLE) * cum_pos / (cum_pos + cum_neg))")}
        AS average_precision FROM steps""",
        "scored",
        **_steps("p"),
    ),
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = evaluate.average_precision(scored(spark, sf_dir), "y", "p")
    return round_columns(area, ["average_precision"])


# Three threshold rules on the same score stand for three models.
_RULES = {"low": 0.25, "middle": 0.5, "high": 0.75}


def _rule_metrics(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = scored(spark, sf_dir)
    return [
        round_columns(
            evaluate.classification_metrics(rows.withColumn("z", above("p", t)), "y", "z"),
            _THRESHOLD_METRICS,
        ).select(F.lit(seq).alias("seq"), F.lit(name).alias("model"), "*")
        for seq, (name, t) in enumerate(_RULES.items())
    ]


_RULES_SQL = " UNION ALL ".join(
    f"""SELECT {seq} AS seq, '{name}' AS model, * FROM ({metrics_sql(counts_sql(
        f"CASE WHEN p > CAST({t} AS DOUBLE) THEN 1 ELSE 0 END"))})"""
    for seq, (name, t) in enumerate(_RULES.items())
)


@query(
    "select_best",
    with_views(
        """SELECT * FROM rules WHERE "F1 Score" > 0 ORDER BY "F1 Score" DESC, seq LIMIT 1""",
        "scored",
        rules=_RULES_SQL,
    ),
)
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_best(union_all(_rule_metrics(spark, sf_dir)), "F1 Score", "seq")


@query(
    "metrics_report",
    with_views(
        " UNION ALL ".join(
            f"""SELECT model, '{m}' AS metric, {rounded_sql(f'"{m}"', 4)} AS value FROM rules"""
            for m in _THRESHOLD_METRICS
        ),
        "scored",
        rules=_RULES_SQL,
    ),
)
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics_report(_rule_metrics(spark, sf_dir))


@query("metrics_round_trip", with_views("SELECT * FROM rules", "scored", rules=_RULES_SQL))
def metrics_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON and read back."""
    path = scratch_path(spark, "metrics")
    metrics = union_all(_rule_metrics(spark, sf_dir))
    write_metrics(metrics, path)
    return spark.read.schema(metrics.schema).json(path)


@query(
    "params_round_trip",
    with_views(
        f"""SELECT model, CASE model {" ".join(
            f"WHEN '{name}' THEN CAST({t} AS DOUBLE)" for name, t in _RULES.items()
        )} END AS threshold, FALSE AS inclusive
        FROM rules WHERE "F1 Score" > 0 ORDER BY "F1 Score" DESC, seq LIMIT 1""",
        "scored",
        rules=_RULES_SQL,
    ),
)
def params_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of the best rule written as JSON and read back."""
    metrics = union_all(_rule_metrics(spark, sf_dir))
    best = evaluate.select_best(metrics, "F1 Score", "seq").first()["model"]
    path = scratch_path(spark, "params")
    write_params(spark, {"model": best, "threshold": _RULES[best], "inclusive": False}, path)
    return spark.read.schema("model string, threshold double, inclusive boolean").json(path)


# Three models: a coarse score, a fine one, and the coarse one upside down; each with its threshold.
_MODELS = {"coarse": ("p", 0.5), "fine": ("fine", 0.25), "reversed": ("1 - p", 0.75)}


def _models(spark: SparkSession, sf_dir: str) -> evaluate.Comparison:
    rows = scored(spark, sf_dir)
    parts = [
        rows.select(F.lit(name).alias("model"), "y", F.expr(s).alias("s"))
        .withColumn("z", above("s", t))
        for name, (s, t) in _MODELS.items()
    ]
    return evaluate.compare_models(union_all(parts), "model", "y", "z", "s", drop_collinear=False)


def _model_views() -> dict[str, str]:
    return {
        f"m_{name}": f"""SELECT y, {s} AS s, CASE WHEN {s} > CAST({t} AS DOUBLE) THEN 1 ELSE 0 END AS z
            FROM scored"""
        for name, (s, t) in _MODELS.items()
    }


def _per_model(sql: str) -> str:
    """``sql`` with {view} and {steps} filled in for every model, one below the other."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS model, * FROM ({sql.format(view=f'm_{name}', steps=f't_{name}')})"
        for name in _MODELS
    )


def _model_steps() -> dict[str, str]:
    return _model_views() | {
        f"t_{name}": f"""SELECT s, pos, sum(pos) OVER (ORDER BY s DESC) AS cum_pos,
            sum(neg) OVER (ORDER BY s DESC) AS cum_neg, sum(pos) OVER () AS total_pos,
            sum(neg) OVER () AS total_neg
            FROM (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
                  FROM m_{name} GROUP BY s)"""
        for name in _MODELS
    }


@query(
    "compare_metrics",
    with_views(
        _per_model(
            f"""SELECT *, (SELECT {rounded_sql("auc")} FROM ({auc_sql("s", "{view}")})) AS "AUC-ROC"
            FROM ({metrics_sql(counts_sql("z", "{view}"))})"""
        ),
        "scored",
        **_model_views(),
    ),
)
def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_models(spark, sf_dir).metrics, presets.METRIC_NAMES)


@query(
    "compare_confusion",
    with_views(
        _per_model(
            f"""SELECT actual, predicted, n,
            {rounded_sql("n / sum(n) OVER (PARTITION BY actual)")} AS share
            FROM (SELECT y AS actual, z AS predicted, count(*) AS n FROM {{view}}
                  WHERE y IS NOT NULL AND z IS NOT NULL GROUP BY ALL
                  UNION ALL SELECT a, b, 0
                  FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)
                  WHERE NOT EXISTS (SELECT 1 FROM {{view}} WHERE y = a AND z = b))"""
        ),
        "scored",
        **_model_views(),
    ),
)
def compare_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_models(spark, sf_dir).confusion, ["share"])


@query(
    "compare_areas",
    with_views(
        _per_model(
            f"""SELECT (SELECT {rounded_sql("auc")} FROM ({auc_sql("s", "{view}")})) AS auc,
            {rounded_sql("sum(pos / CAST(total_pos AS DOUBLE) * cum_pos / (cum_pos + cum_neg))")}
            AS average_precision FROM {{steps}}"""
        ),
        "scored",
        **_model_steps(),
    ),
)
def compare_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_models(spark, sf_dir).areas, ["auc", "average_precision"])


@query(
    "compare_roc",
    with_views(
        _per_model(
            f"""{_ROC_START} UNION ALL SELECT {rounded_sql("s", 8)}, {rounded_sql(
                "CAST(cum_neg AS DOUBLE) / total_neg", 8)}, {rounded_sql(
                "CAST(cum_pos AS DOUBLE) / total_pos", 8)} FROM {{steps}}"""
        ),
        "scored",
        **_model_steps(),
    ),
)
def compare_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_models(spark, sf_dir).roc, ["threshold", "fpr", "tpr"], 8)


@query(
    "compare_pr",
    with_views(
        _per_model(
            f"""SELECT {rounded_sql("s", 8)} AS threshold, {rounded_sql(
                "CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg)", 8)} AS precision, {rounded_sql(
                "CAST(cum_pos AS DOUBLE) / total_pos", 8)} AS recall FROM {{steps}}
            UNION ALL SELECT NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)"""
        ),
        "scored",
        **_model_steps(),
    ),
)
def compare_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_models(spark, sf_dir).pr, ["threshold", "precision", "recall"], 8)
