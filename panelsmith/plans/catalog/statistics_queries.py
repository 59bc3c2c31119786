"""Correlation, histogram and Q-Q tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelsmith.functions import scalar
from panelsmith.operators import stats
from panelsmith.plans.catalog.registry import query, round_columns, rounded_sql
from panelsmith.plans.fixtures import li, qual, table, with_views

_LI_FEATURES = ["l_linenumber", "f_qty", "f_price", "f_disc", "f_tax"]
_DOCUMENT_FEATURES = ["n_chars", "n_words", "chars_per_word", "quality", "toxic"]


def corr_sql(source: str, columns: list[str]) -> str:
    """All pairs i < j; DuckDB gives NaN for a constant column, which counts as NULL."""
    return " UNION ALL ".join(
        f"""SELECT {i} AS i, {j} AS j, '{a}' AS feature_i, '{b}' AS feature_j,
        (SELECT CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END FROM {source}) AS r
        """
        for j, b in enumerate(columns)
        for i, a in enumerate(columns[:j])
    )


@query(
    "corr_matrix",
    with_views(
        f"SELECT i, j, feature_i, feature_j, {rounded_sql('r')} AS r FROM c",
        "li",
        c=corr_sql("li", _LI_FEATURES),
    ),
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(stats.corr_matrix(li(spark, sf_dir), _LI_FEATURES), ["r"])


_FLAGGED = "SELECT feature_j AS feature, max(abs(r)) AS max_abs_r FROM c GROUP BY 1 HAVING max(abs(r)) > 0.6"


@query(
    "correlated_columns",
    with_views(
        f"SELECT feature, {rounded_sql('max_abs_r')} AS max_abs_r FROM flagged",
        "qual",
        c=corr_sql("qual", _DOCUMENT_FEATURES),
        flagged=_FLAGGED,
    ),
)
def correlated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    correlations = stats.corr_matrix(qual(spark, sf_dir), _DOCUMENT_FEATURES)
    return round_columns(stats.correlated_columns(correlations), ["max_abs_r"])


@query(
    "kept_correlations",
    with_views(
        f"""SELECT feature_i, feature_j, {rounded_sql('abs(r)')} AS abs_r FROM c
        WHERE feature_i NOT IN (SELECT feature FROM flagged)
          AND feature_j NOT IN (SELECT feature FROM flagged)""",
        "qual",
        c=corr_sql("qual", _DOCUMENT_FEATURES),
        flagged=_FLAGGED,
    ),
)
def kept_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    correlations = stats.corr_matrix(qual(spark, sf_dir), _DOCUMENT_FEATURES)
    return round_columns(stats.kept_correlations(correlations), ["abs_r"])


def _histogram_sql(column: str) -> str:
    return f"""
SELECT '{column}' AS variable, CAST(b AS INTEGER) AS bin,
  {rounded_sql("lo + b * (hi - lo) / 30", 4)} AS lower,
  {rounded_sql("lo + (b + 1) * (hi - lo) / 30", 4)} AS upper,
  (SELECT count(*) FROM li WHERE {column} IS NOT NULL
     AND least(floor(({column} - lo) / ((hi - lo) / 30)), 29) = b) AS n
FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM li), (SELECT unnest(range(30)) AS b)"""


@query(
    "histogram",
    with_views(_histogram_sql("f_qty") + " UNION ALL " + _histogram_sql("f_price"), "li"),
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.histogram(li(spark, sf_dir), ["f_qty", "f_price"])
    return round_columns(counts, ["lower", "upper"], 4)


def _polynomial_sql(coefficients: list[float], x: str) -> str:
    result = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        result = f"({result} * {x} + CAST({c!r} AS DOUBLE))"
    return result


def normal_quantile_sql(p: str) -> str:
    q, central = f"({p} - 0.5)", f"(CAST(0.180625 AS DOUBLE) - ({p} - 0.5) * ({p} - 0.5))"
    depth = f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = f"({depth} - CAST(1.6 AS DOUBLE))", f"({depth} - 5)"

    def ratio(num: list[float], den: list[float], x: str) -> str:
        return f"{_polynomial_sql(num, x)} / {_polynomial_sql(den, x)}"

    centre = f"{q} * {ratio(scalar.AS241_CENTRE_NUM, scalar.AS241_CENTRE_DEN, central)}"
    tail = (
        f"CASE WHEN {depth} <= 5 THEN {ratio(scalar.AS241_TAIL_NUM, scalar.AS241_TAIL_DEN, near)} "
        f"ELSE {ratio(scalar.AS241_FAR_NUM, scalar.AS241_FAR_DEN, far)} END"
    )
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {centre} "
        f"WHEN {q} < 0 THEN -({tail}) ELSE ({tail}) END"
    )


_ORDERED = {
    "ordered": """SELECT o_totalprice AS sample, row_number() OVER (ORDER BY o_totalprice) AS i,
                  CAST(count(*) OVER () AS DOUBLE) AS n FROM orders""",
    "medians": """SELECT sample, i, CASE WHEN i = n THEN pow(0.5, 1 / n)
                    WHEN i = 1 THEN 1 - pow(0.5, 1 / n)
                    ELSE (i - CAST(0.3175 AS DOUBLE)) / (n + CAST(0.365 AS DOUBLE)) END AS p
                  FROM ordered""",
    "points": f"SELECT i, {normal_quantile_sql('p')} AS t, sample FROM medians",
}


@query(
    "qq_points",
    with_views(
        f"SELECT i AS rank, {rounded_sql('t')} AS theoretical, sample FROM points", **_ORDERED
    ),
)
def qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stats.qq_points(table(spark, sf_dir, "orders"), "o_totalprice")
    return round_columns(points, ["theoretical"])


@query(
    "qq_line",
    with_views(
        f"""SELECT {rounded_sql("regr_slope(sample, t)", 3)} AS slope,
        {rounded_sql("regr_intercept(sample, t)", 3)} AS intercept,
        {rounded_sql("corr(t, sample)")} AS r FROM points""",
        **_ORDERED,
    ),
)
def qq_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = stats.qq_line(stats.qq_points(table(spark, sf_dir, "orders"), "o_totalprice"))
    return round_columns(round_columns(line, ["slope", "intercept"], 3), ["r"])

