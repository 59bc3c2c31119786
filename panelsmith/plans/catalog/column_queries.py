"""Projection, filling, encoding, scalar transforms and scaling."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.functions import scalar
from panelsmith.operators import clean, scale
from panelsmith.operators.impute import IterativeImputer
from panelsmith.plans.catalog.registry import query, round_columns, rounded, rounded_sql
from panelsmith.plans.fixtures import LI_KEYS, MEASURES, li, li_sql, panel, table, with_views
from panelsmith.plans.preprocess import fit_preprocessing

KEYS_SQL = ", ".join(LI_KEYS)
FEATURES = ["f_qty", "f_price", "f_disc", "f_tax"]


@query("select_numeric", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.select_numeric(table(spark, sf_dir, "customer"))


@query(
    "drop_columns",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_shipdate FROM lineitem",
)
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly first, then leniently with a name that does not exist."""
    df = clean.drop_columns_strict(
        table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_discount"]
    )
    return clean.drop_columns_if_present(df, ["l_returnflag", "l_linestatus", "l_comment"])


@query(
    "mean_impute",
    with_views(
        f"""SELECT {KEYS_SQL},
        {rounded_sql("coalesce(f_qty, (SELECT avg(f_qty) FROM li))", 4)} AS f_qty,
        {rounded_sql("coalesce(f_price, (SELECT avg(f_price) FROM li))", 4)} AS f_price FROM li""",
        "li",
    ),
)
def mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = li(spark, sf_dir).select(*LI_KEYS, "f_qty", "f_price")
    filled = clean.MeanImputer(["f_qty", "f_price"]).fit(df).transform(df)
    return round_columns(filled, ["f_qty", "f_price"], 4)


@query(
    "forward_fill",
    with_views(
        "SELECT entity_id, hour, "
        + ", ".join(
            rounded_sql(
                f"last_value({m} IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY hour "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            )
            + f" AS {m}"
            for m in MEASURES
        )
        + " FROM panel",
        "panel",
    ),
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).drop("gender", "label")
    filled = clean.forward_fill(rows, "entity_id", "hour", list(MEASURES))
    return round_columns(filled, list(MEASURES))


@query(
    "missing_indicator",
    with_views(
        "SELECT entity_id, hour, "
        + ", ".join(f"CAST({m} IS NULL AS INTEGER) AS {m}_missing" for m in MEASURES)
        + " FROM panel",
        "panel",
    ),
)
def missing_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = clean.missing_indicators(panel(spark, sf_dir), list(MEASURES))
    return flagged.select("entity_id", "hour", *[f"{m}_missing" for m in MEASURES])


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"c_mktsegment_{s}\"" for s in _SEGMENTS
    )
    + " FROM customer",
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return clean.OneHot(["c_mktsegment"]).fit(df).transform(df)


@query(
    "drop_nulls",
    with_views(
        f"SELECT {KEYS_SQL}, f_qty, f_price FROM li WHERE f_qty IS NOT NULL AND f_price IS NOT NULL",
        "li",
    ),
)
def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_nulls(li(spark, sf_dir)).select(*LI_KEYS, "f_qty", "f_price")


@query(
    "count_dropped",
    with_views(
        """SELECT count(*) FILTER (f_qty IS NOT NULL AND f_price IS NOT NULL) AS n_kept,
        count(*) FILTER (f_qty IS NULL OR f_price IS NULL) AS n_dropped FROM li""",
        "li",
    ),
)
def count_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.count_dropped(li(spark, sf_dir))


@query(
    "normalize_names",
    'SELECT o_orderkey, o_totalprice AS price_usd, o_totalprice AS price_usd_2 FROM orders',
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", price.alias("price.usd"), price.alias("price_usd")
    )
    return clean.normalize_names(df)


@query(
    "concat_columns",
    """SELECT o_orderkey, o_totalprice, coalesce(n_lines, 0) AS n_lines FROM orders LEFT JOIN (
      SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey)
    USING (o_orderkey)""",
)
def concat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )
    return clean.concat_columns(orders, lines, ["o_orderkey"]).na.fill(0, ["n_lines"])


@query(
    "concat_rows",
    """SELECT c_custkey AS party, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal FROM supplier""",
)
def concat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("party"), F.col("c_acctbal").alias("balance")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("party")
    )
    return clean.concat_rows(customers, suppliers)


@query(
    "log_clip",
    f"""SELECT c_custkey,
    {rounded_sql("ln(greatest(c_acctbal, CAST(1e-5 AS DOUBLE)) + 1)")} AS c_acctbal FROM customer""",
)
def log_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return round_columns(scale.LogClip(["c_acctbal"]).transform(df), ["c_acctbal"])


@query(
    "log_clip_with_gaps",
    with_views(
        f"""SELECT {KEYS_SQL}, {rounded_sql(
            "CASE WHEN f_price IS NOT NULL THEN ln(greatest(f_price, CAST(1e-5 AS DOUBLE)) + 1) END"
        )} AS f_price FROM li""",
        "li",
    ),
)
def log_clip_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = li(spark, sf_dir).select(*LI_KEYS, "f_price")
    return round_columns(scale.LogClip(["f_price"]).transform(df), ["f_price"])


@query(
    "standard_scale",
    with_views(
        f"SELECT {KEYS_SQL}, "
        + ", ".join(
            rounded_sql(
                f"({c} - (SELECT avg({c}) FROM li)) / "
                f"(SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM li)"
            )
            + f" AS {c}"
            for c in FEATURES
        )
        + " FROM li",
        "li",
    ),
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = li(spark, sf_dir).select(*LI_KEYS, *FEATURES)
    return round_columns(scale.StandardScaler(FEATURES).fit(df).transform(df), FEATURES)


def robust_sql(column: str, source: str) -> str:
    def quantile(q: str) -> str:
        return f"(SELECT quantile_cont({column}, {q}) FROM {source})"

    width = f"coalesce(nullif({quantile('0.75')} - {quantile('0.25')}, 0), 1)"
    return f"({column} - {quantile('0.5')}) / {width}"


@query(
    "robust_scale",
    with_views(
        f"SELECT {KEYS_SQL}, "
        + ", ".join(f"{rounded_sql(robust_sql(c, 'li'))} AS {c}" for c in FEATURES)
        + " FROM li",
        "li",
    ),
)
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = li(spark, sf_dir).select(*LI_KEYS, *FEATURES)
    return round_columns(scale.RobustScaler(FEATURES).fit(df).transform(df), FEATURES)


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))


_BALANCES = "FROM (SELECT c_custkey, c_acctbal AS x FROM customer)"


@query(
    "power_1_5",
    f"""SELECT c_custkey, {rounded_sql(
        "CASE WHEN x >= 0 THEN pow(x, CAST(1 AS DOUBLE) / CAST(1.5 AS DOUBLE)) END"
    )} AS y {_BALANCES}""",
)
def power_1_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir).select("c_custkey", rounded(scalar.power_1_5("x")).alias("y"))


@query(
    "sqrt_transform",
    f"SELECT c_custkey, {rounded_sql('CASE WHEN x >= 0 THEN sqrt(x) END')} AS y {_BALANCES}",
)
def sqrt_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir).select("c_custkey", rounded(scalar.square_root("x")).alias("y"))


@query(
    "reciprocal",
    f"""SELECT c_custkey, {rounded_sql(
        "CAST(1 AS DOUBLE) / nullif(x + CAST(1e-5 AS DOUBLE), 0)"
    )} AS y {_BALANCES}""",
)
def reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir).select("c_custkey", rounded(scalar.reciprocal("x")).alias("y"))


@query(
    "log1p_transform",
    f"SELECT c_custkey, {rounded_sql('CASE WHEN x > -1 THEN ln(x + 1) END')} AS y {_BALANCES}",
)
def log1p_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir).select("c_custkey", rounded(scalar.log1p("x")).alias("y"))


def yeo_johnson_sql(x: str, lam: float) -> str:
    lam_sql, mirror = f"CAST({lam!r} AS DOUBLE)", f"CAST({2 - lam!r} AS DOUBLE)"
    upper = f"(pow({x} + 1, {lam_sql}) - 1) / {lam_sql}" if lam != 0 else f"ln({x} + 1)"
    lower = f"-((pow(1 - {x}, {mirror}) - 1) / {mirror})" if lam != 2 else f"-ln(1 - {x})"
    return f"CASE WHEN {x} >= 0 THEN {upper} WHEN {x} < 0 THEN {lower} END"


_LAMBDAS = {"y_0": 0.0, "y_05": 0.5, "y_1": 1.0, "y_2": 2.0}


@query(
    "yeo_johnson",
    "SELECT c_custkey, "
    + ", ".join(
        f"{rounded_sql(yeo_johnson_sql('x', lam), 3)} AS {name}" for name, lam in _LAMBDAS.items()
    )
    + f" {_BALANCES}",
)
def yeo_johnson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir).select(
        "c_custkey",
        *[rounded(scalar.yeo_johnson("x", lam), 3).alias(n) for n, lam in _LAMBDAS.items()],
    )


def _grid_sql(source: str, low: str, high: str) -> str:
    """Best of 41 equally spaced lambdas between low and high by log-likelihood over ``source.x``."""
    lam = f"({low} + g * (({high}) - ({low})) / 40)"
    upper = "CASE WHEN lam = 0 THEN ln(x + 1) ELSE (pow(x + 1, lam) - 1) / lam END"
    lower = "CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END"
    return f"""
SELECT arg_max(lam, llf) AS best, max(step) AS step FROM (
  SELECT lam, max(step) AS step,
    -count(*) / 2.0 * ln(var_pop(CASE WHEN x >= 0 THEN {upper} ELSE {lower} END))
    + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS llf
  FROM {source}, (SELECT {lam} AS lam, (({high}) - ({low})) / 40 AS step
                  FROM (SELECT unnest(range(41)) AS g))
  GROUP BY lam)"""


@query(
    "yeo_johnson_fit",
    with_views(
        f"SELECT {rounded_sql('best', 4)} AS lambda FROM e",
        xs="SELECT o_totalprice / 1000 AS x FROM orders",
        a=_grid_sql("xs", "CAST(-4 AS DOUBLE)", "CAST(6 AS DOUBLE)"),
        b=_grid_sql("xs", "(SELECT best - step FROM a)", "(SELECT best + step FROM a)"),
        c=_grid_sql("xs", "(SELECT best - step FROM b)", "(SELECT best + step FROM b)"),
        d=_grid_sql("xs", "(SELECT best - step FROM c)", "(SELECT best + step FROM c)"),
        e=_grid_sql("xs", "(SELECT best - step FROM d)", "(SELECT best + step FROM d)"),
    ),
)
def yeo_johnson_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("x"))
    lam = scale.fit_yeo_johnson(x, "x")
    return spark.createDataFrame([(lam,)], "lambda double").select(
        rounded("lambda", 4).alias("lambda")
    )


_CANDIDATE_SQL = {
    "raw": "x",
    "yeo_johnson": yeo_johnson_sql("x", 0.5),
    "power_1_5": "CASE WHEN x >= 0 THEN pow(x, CAST(1 AS DOUBLE) / CAST(1.5 AS DOUBLE)) END",
    "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END",
    "reciprocal": "1 / nullif(x + CAST(1e-5 AS DOUBLE), 0)",
    "log1p": "CASE WHEN x > -1 THEN ln(x + 1) END",
}


@query(
    "gaussian_candidates",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS transform, count(v) AS n, {rounded_sql("max(m)", 4)} AS mean,
        {rounded_sql("sqrt(avg((v - m) * (v - m)))", 4)} AS sd,
        {rounded_sql("avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5)", 4)} AS skewness,
        {rounded_sql("avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3", 4)} AS kurtosis
        FROM (SELECT v, avg(v) OVER () AS m FROM
              (SELECT {sql} AS v FROM (SELECT l_extendedprice AS x FROM lineitem)))"""
        for name, sql in _CANDIDATE_SQL.items()
    ),
)
def gaussian_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = scale.gaussian_candidates(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.5)
    return round_columns(shapes, ["mean", "sd", "skewness", "kurtosis"], 4)


@query(
    "threshold_predict",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS p,
    CAST(l_discount > CAST(0.05 AS DOUBLE) AS INTEGER) AS above,
    CAST(l_discount >= CAST(0.05 AS DOUBLE) AS INTEGER) AS reached FROM lineitem""",
)
def threshold_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_discount").alias("p"),
        scalar.above("l_discount", 0.05).alias("above"),
        scalar.above("l_discount", 0.05, inclusive=True).alias("reached"),
    )


_PREPARED_SQL = """
SELECT *, CAST(l_linestatus = 'F' AS INTEGER) AS l_linestatus_F,
  CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_O,
  ln(greatest(coalesce(f_price, (SELECT avg(f_price) FROM raw)), CAST(1e-5 AS DOUBLE)) + 1) AS price,
  coalesce(f_qty, (SELECT avg(f_qty) FROM raw)) AS qty
FROM raw"""


@query(
    "preprocess",
    with_views(
        f"""SELECT {KEYS_SQL}, {rounded_sql(robust_sql("qty", "prepared"))} AS f_qty,
        {rounded_sql(robust_sql("price", "prepared"))} AS f_price, "l_linestatus_F",
        "l_linestatus_O" FROM prepared""",
        raw=li_sql("l_linestatus"),
        prepared=_PREPARED_SQL,
    ),
)
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan with mean imputation."""
    df = li(spark, sf_dir, "l_linestatus")
    model: PipelineModel = fit_preprocessing(
        df,
        impute=["f_qty", "f_price"],
        drop_first=["f_disc"],
        drop_after_imputing=["f_tax", "label", "not_there"],
        one_hot=["l_linestatus"],
        log=["f_price"],
        scale=["f_qty", "f_price"],
        imputer="mean",
    )
    return round_columns(model.transform(df), ["f_qty", "f_price"])


_PAIR = ["f_qty", "f_price"]


@query(
    "mice_one_gap",
    with_views(
        f"""SELECT {KEYS_SQL}, l_quantity, {rounded_sql(
            "coalesce(f_price, (SELECT i + s * l_quantity FROM fit))", 4)} AS f_price FROM src""",
        src=li_sql("l_quantity"),
        fit="""SELECT regr_slope(f_price, l_quantity) AS s, regr_intercept(f_price, l_quantity) AS i
               FROM src""",
    ),
)
def mice_one_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column with gaps, one complete predictor, least squares."""
    df = li(spark, sf_dir, "l_quantity").select(*LI_KEYS, "l_quantity", "f_price")
    imputer = IterativeImputer(["l_quantity", "f_price"], regressor="least_squares")
    return round_columns(imputer.fit(df).transform(df), ["f_price"], 4)


def _fit_steps(n: int) -> dict[str, str]:
    """f_qty has fewer gaps than f_price, so it is filled first in every round."""
    steps = {
        "r0": """SELECT *, coalesce(f_qty, (SELECT avg(f_qty) FROM li)) AS a,
                 coalesce(f_price, (SELECT avg(f_price) FROM li)) AS b FROM li"""
    }
    for i in range(1, n + 1):
        steps[f"fq{i}"] = (
            f"SELECT regr_intercept(f_qty, b) AS i, regr_slope(f_qty, b) AS s FROM r{i - 1}"
        )
        steps[f"q{i}"] = (
            f"SELECT r.* REPLACE (coalesce(f_qty, f.i + f.s * r.b) AS a) FROM r{i - 1} r, fq{i} f"
        )
        steps[f"fp{i}"] = (
            f"SELECT regr_intercept(f_price, a) AS i, regr_slope(f_price, a) AS s FROM q{i}"
        )
        steps[f"r{i}"] = (
            f"SELECT r.* REPLACE (coalesce(f_price, f.i + f.s * r.a) AS b) FROM q{i} r, fp{i} f"
        )
    return steps


@query(
    "mice_two_gaps",
    with_views(
        f"SELECT {KEYS_SQL}, {rounded_sql('a', 4)} AS f_qty, {rounded_sql('b', 4)} AS f_price FROM r3",
        "li",
        **_fit_steps(3),
    ),
)
def mice_two_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns with gaps that predict each other, three rounds of least squares."""
    df = li(spark, sf_dir).select(*LI_KEYS, *_PAIR)
    imputer = IterativeImputer(_PAIR, max_iter=3, tol=0.0, regressor="least_squares")
    return round_columns(imputer.fit(df).transform(df), _PAIR, 4)


_CHAINED_SQL = """
SELECT *, CAST(l_linestatus = 'F' AS INTEGER) AS l_linestatus_F,
  CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_O,
  ln(greatest(b, CAST(1e-5 AS DOUBLE)) + 1) AS price, a AS qty
FROM r3"""


@query(
    "preprocess_chained",
    with_views(
        f"""SELECT {KEYS_SQL}, {rounded_sql(robust_sql("qty", "prepared"), 4)} AS f_qty,
        {rounded_sql(robust_sql("price", "prepared"), 4)} AS f_price, "l_linestatus_F",
        "l_linestatus_O" FROM prepared""",
        li=li_sql("l_linestatus"),
        **_fit_steps(3),
        prepared=_CHAINED_SQL,
    ),
)
def preprocess_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan with chained imputation, three rounds of least squares."""
    df = li(spark, sf_dir, "l_linestatus")
    model = fit_preprocessing(
        df,
        impute=_PAIR,
        drop_first=["f_disc"],
        drop_after_imputing=["f_tax", "label", "not_there"],
        one_hot=["l_linestatus"],
        log=["f_price"],
        scale=_PAIR,
        max_iter=3,
        tol=0.0,
        regressor="least_squares",
    )
    return round_columns(model.transform(df), _PAIR, 4)


_RIDGE_VIEWS = {
    "src": li_sql("l_quantity"),
    "sums": """SELECT CAST(count(*) AS DOUBLE) AS n, regr_sxx(f_price, l_quantity) AS g,
        regr_sxy(f_price, l_quantity) AS c, regr_syy(f_price, l_quantity) AS yy,
        regr_avgx(f_price, l_quantity) AS mx, regr_avgy(f_price, l_quantity) AS my
        FROM src WHERE f_price IS NOT NULL""",
}
_RIDGE_STEP = "c / (g + lam / alpha)"


def _ridge_sql(rounds: int = 300) -> str:
    """Evidence maximisation for one predictor; (i, w, lam, alpha) per step until w settles."""
    effective = "(alpha * g / (lam + alpha * g))"
    error = "(yy - 2 * w * c + w * w * g)"
    return f"""
SELECT 0 AS i, CAST(NULL AS DOUBLE) AS before, CAST(NULL AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS lam,
  1 / (yy / n + CAST(2.220446049250313e-16 AS DOUBLE)) AS alpha FROM sums
UNION ALL
SELECT i + 1, before, w, ({effective} + CAST(2e-6 AS DOUBLE)) / (w * w + CAST(2e-6 AS DOUBLE)),
  (n - {effective} + CAST(2e-6 AS DOUBLE)) / ({error} + CAST(2e-6 AS DOUBLE))
FROM (SELECT i, w AS before, {_RIDGE_STEP} AS w, lam, alpha, n, g, c, yy FROM ridge, sums
      WHERE i < {rounds} AND (i < 2 OR abs(w - before) >= CAST(1e-3 AS DOUBLE)))"""


@query(
    "mice_bayesian_ridge",
    "WITH RECURSIVE "
    + with_views(
        f"""SELECT {KEYS_SQL}, l_quantity,
        {rounded_sql("coalesce(f_price, (SELECT my + w * (l_quantity - mx) FROM fit))", 4)} AS f_price
        FROM src""",
        **_RIDGE_VIEWS,
        ridge=_ridge_sql(),
        fit=f"""SELECT mx, my, {_RIDGE_STEP} AS w FROM sums,
                (SELECT lam, alpha FROM ridge ORDER BY i DESC LIMIT 1)""",
    ).removeprefix("WITH "),
)
def mice_bayesian_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column with gaps, one complete predictor, the default regressor."""
    df = li(spark, sf_dir, "l_quantity").select(*LI_KEYS, "l_quantity", "f_price")
    imputer = IterativeImputer(["l_quantity", "f_price"])
    return round_columns(imputer.fit(df).transform(df), ["f_price"], 4)


@query("mice_impute")
def mice_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bayesian ridge on four columns until the filled cells settle."""
    df = li(spark, sf_dir).select(*LI_KEYS, *FEATURES)
    return round_columns(IterativeImputer(FEATURES).fit(df).transform(df), FEATURES, 4)


@query("mice_impute_panel")
def mice_impute_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir)
    columns = ["hour", *MEASURES]
    filled = IterativeImputer(columns).fit(df).transform(df)
    return round_columns(filled, list(MEASURES), 4)
