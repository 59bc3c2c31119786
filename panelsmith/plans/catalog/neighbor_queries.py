"""Nearest neighbours and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.operators import classify, knn_graph, neighbors, resample
from panelsmith.plans.catalog.registry import query, round_columns, rounded, rounded_sql
from panelsmith.plans.fixtures import LI_KEYS, emb, li, with_views

_EUCLIDEAN = "list_distance(a.vec, b.vec)"
_MANHATTAN = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] - z[2])))"


def knn_sql(
    queries: str, searched: str, key: str, k: int, distance: str = _EUCLIDEAN, more: str = ""
) -> str:
    """The k nearest rows of another id, ties by id; ``more`` columns from rows a and b."""
    return f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY distance, neighbor_id) AS rank
  FROM (SELECT a.{key} AS {key}, b.{key} AS neighbor_id, {distance} AS distance {more}
        FROM {queries} a JOIN {searched} b ON a.{key} <> b.{key}))
WHERE rank <= {k}"""


@query(
    "knn_join",
    with_views(
        f"""SELECT vec_id, neighbor_id, {rounded_sql("distance")} AS distance,
        CAST(rank AS INTEGER) AS rank FROM ({knn_sql("emb", "emb", "vec_id", 5)})""",
        "emb",
    ),
)
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb(spark, sf_dir)
    near = neighbors.knn_join(rows, rows, "vec_id", "vec", 5, exclude_self=True)
    return round_columns(near, ["distance"])


@query(
    "knn_join_manhattan",
    with_views(
        f"""SELECT vec_id, neighbor_id, {rounded_sql("distance")} AS distance,
        CAST(rank AS INTEGER) AS rank FROM ({knn_sql("emb", "emb", "vec_id", 4, _MANHATTAN)})""",
        "emb",
    ),
)
def knn_join_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb(spark, sf_dir)
    near = neighbors.knn_join(rows, rows, "vec_id", "vec", 4, p=1, exclude_self=True)
    return round_columns(near, ["distance"])


@query("knn_graph")
def approximate_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(knn_graph.knn_graph(emb(spark, sf_dir), "vec_id", "vec", 5), ["distance"])


def _smote_views(ratio: float, k: int) -> dict[str, str]:
    return {
        "base": """SELECT vec_id, vec, row_number() OVER (ORDER BY md5(concat(vec_id, ':42')), vec_id)
                   - 1 AS turn, count(*) OVER () AS n_min FROM emb WHERE y = 1""",
        "near": knn_sql("base", "base", "vec_id", k, more=", b.vec AS neighbor_vec"),
        "numbers": f"""SELECT unnest(range(CAST(trunc(
            (SELECT count(*) FROM emb WHERE y = 0) * CAST({ratio} AS DOUBLE)
            - (SELECT count(*) FROM emb WHERE y = 1)) AS BIGINT))) AS j""",
        "drawn": f"""SELECT j, vec_id, vec,
            1 + CAST(floor(CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0 * {k}) AS BIGINT)
              AS pick,
            CAST('0x' || substr(h, 9, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
            FROM (SELECT *, md5(concat(vec_id, ':', j, ':42')) AS h
                  FROM numbers JOIN base ON turn = j % n_min)""",
        "made": """SELECT j AS synthetic_no, list_transform(list_zip(d.vec, n.neighbor_vec),
            lambda z: z[1] + d.u * (z[2] - z[1])) AS vec
            FROM drawn d JOIN near n ON n.vec_id = d.vec_id AND n.rank = d.pick""",
        "enlarged": """SELECT concat('r:', vec_id) AS row_key, vec_id,
            CAST(NULL AS BIGINT) AS synthetic_no, vec, y FROM emb UNION ALL
            SELECT concat('s:', synthetic_no), NULL, synthetic_no, vec, 1 FROM made""",
    }


def _outline(df: DataFrame, *keep: str) -> DataFrame:
    """A vector as its sum, sum of squares and all its entries."""
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return df.select(
        *keep,
        rounded(total).alias("v_sum"),
        rounded(squares).alias("v_squares"),
        *[rounded(F.element_at("vec", i)).alias(f"v_{i}") for i in range(1, 65)],
    )


_OUTLINE_SQL = ", ".join(
    [
        f"{rounded_sql('list_sum(vec)')} AS v_sum",
        f"{rounded_sql('list_sum(list_transform(vec, lambda x: x * x))')} AS v_squares",
        *[f"{rounded_sql(f'vec[{i}]')} AS v_{i}" for i in range(1, 65)],
    ]
)


@query(
    "smote",
    with_views(
        f"""SELECT coalesce(vec_id, -1) AS vec_id, coalesce(synthetic_no, -1) AS synthetic_no, y,
        {_OUTLINE_SQL} FROM enlarged""",
        "emb",
        **_smote_views(0.4, 5),
    ),
)
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    enlarged = resample.smote(emb(spark, sf_dir), "vec_id", "vec", "y", 0.4)
    return _outline(enlarged, "vec_id", "synthetic_no", "y").na.fill(-1, ["vec_id", "synthetic_no"])


def _enn_sql(rows: str, key: str) -> str:
    near = knn_sql(f"(SELECT * FROM {rows} WHERE y = 0)", rows, key, 3, more=", b.y AS near_y")
    return f"SELECT {key} FROM ({near}) GROUP BY {key} HAVING max(near_y) = 1"


@query(
    "edited_nn",
    with_views(
        "SELECT vec_id, y FROM emb WHERE vec_id NOT IN (SELECT vec_id FROM mixed)",
        "emb",
        mixed=_enn_sql("emb", "vec_id"),
    ),
)
def edited_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resample.edited_nearest_neighbours(emb(spark, sf_dir), "vec_id", "vec", "y")
    return kept.select("vec_id", "y")


@query(
    "smote_enn",
    with_views(
        f"""SELECT row_key, y, {_OUTLINE_SQL} FROM enlarged
        WHERE row_key NOT IN (SELECT row_key FROM mixed)""",
        "emb",
        **_smote_views(0.4, 6),
        mixed=_enn_sql("enlarged", "row_key"),
    ),
)
def smote_enn(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resample.smote_enn(emb(spark, sf_dir), "vec_id", "vec", "y", 0.4, k_smote=6)
    return _outline(kept, "row_key", "y")


def _votes_sql(k: int, weights: str, distance: str) -> str:
    near = knn_sql("emb", "emb", "vec_id", k, distance, more=", b.y AS near_y")
    if weights == "uniform":
        p1 = "avg(CAST(near_y AS DOUBLE))"
    else:
        p1 = """CASE WHEN count(*) FILTER (distance = 0) > 0
            THEN count(*) FILTER (distance = 0 AND near_y = 1)
              / CAST(count(*) FILTER (distance = 0) AS DOUBLE)
            ELSE coalesce(sum(1 / nullif(distance, 0)) FILTER (near_y = 1), 0)
              / sum(1 / nullif(distance, 0)) END"""
    return f"""SELECT vec_id, {rounded_sql("p1")} AS p1, CAST(p1 > 0.5 AS INTEGER) AS prediction
        FROM (SELECT vec_id, {p1} AS p1 FROM ({near}) GROUP BY vec_id)"""


@query("knn_classify", with_views(_votes_sql(5, "distance", _EUCLIDEAN), "emb"))
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector by its five nearest others."""
    rows = emb(spark, sf_dir)
    votes = classify.knn_classify(rows, rows, "vec_id", "vec", "y", 5, exclude_self=True)
    return round_columns(votes, ["p1"])


@query("knn_classify_uniform", with_views(_votes_sql(7, "uniform", _MANHATTAN), "emb"))
def knn_classify_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb(spark, sf_dir)
    votes = classify.knn_classify(
        rows, rows, "vec_id", "vec", "y", 7, "uniform", p=1, exclude_self=True
    )
    return round_columns(votes, ["p1"])


@query(
    "class_weights",
    with_views(
        f"""SELECT {", ".join(LI_KEYS)}, label,
        {rounded_sql("count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label))")} AS balanced,
        CAST(CASE WHEN label = 1 THEN 3 ELSE 1 END AS DOUBLE) AS explicit FROM li""",
        "li",
    ),
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = li(spark, sf_dir).select(*LI_KEYS, "label")
    weighted = resample.class_weights(rows, "label", "balanced", "balanced")
    weighted = resample.class_weights(weighted, "label", {0: 1, 1: 3}, "explicit")
    return round_columns(weighted, ["balanced"])
