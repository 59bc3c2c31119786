"""Views over the given tables that the registered queries work on, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.sources.tables import read_table

MEASURES = {"hr": "view", "o2sat": "click", "temp": "signup", "map": "error", "resp": "purchase"}
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their hour; (user_id, hour) is not unique."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("entity_id"),
        F.expr(f"timestampdiff(HOUR, {EPOCH}, ts)").alias("hour"),
        "user_id",
        "event_type",
        "value",
        F.when(F.col("value") > 250, 1).otherwise(0).alias("label"),
    )


HOURLY_SQL = """
SELECT event_id, CAST(user_id AS VARCHAR) AS entity_id,
  CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS hour,
  user_id, event_type, value, CASE WHEN value > 250 THEN 1 ELSE 0 END AS label
FROM events"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity x hour panel; each measure is NULL in roughly 80 % of the rows."""
    return (
        hourly_events(spark, sf_dir)
        .groupBy("entity_id", "hour", F.pmod("user_id", F.lit(2)).cast("int").alias("gender"))
        .agg(
            *[
                F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(name)
                for name, kind in MEASURES.items()
            ],
            F.max("label").alias("label"),
        )
        .select("entity_id", "hour", *MEASURES, "gender", "label")
    )


PANEL_SQL = (
    "SELECT entity_id, hour, "
    + ", ".join(
        f"avg(CASE WHEN event_type = '{kind}' THEN value END) AS {name}"
        for name, kind in MEASURES.items()
    )
    + f""", CAST(user_id % 2 AS INTEGER) AS gender, max(label) AS label
FROM ({HOURLY_SQL}) GROUP BY entity_id, user_id, hour"""
)


def li(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Order lines with gaps in two features, and ``more`` columns as they are."""
    odd_quantity = (F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0
    odd_price = (F.col("l_partkey") + F.col("l_linenumber")) % 5 == 0
    return table(spark, sf_dir, "lineitem").select(
        *LI_KEYS,
        F.when(~odd_quantity, F.col("l_quantity")).alias("f_qty"),
        F.when(~odd_price, F.col("l_extendedprice")).alias("f_price"),
        F.col("l_discount").alias("f_disc"),
        F.col("l_tax").alias("f_tax"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        *more,
    )


def li_sql(*more: str) -> str:
    return f"""
SELECT {", ".join([*LI_KEYS, *more])},
  CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS f_qty,
  CASE WHEN (l_partkey + l_linenumber) % 5 = 0 THEN NULL ELSE l_extendedprice END AS f_price,
  l_discount AS f_disc, l_tax AS f_tax,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
FROM lineitem"""


LI_SQL = li_sql()


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with an imbalanced binary label."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("vec"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("y"),
    )


EMB_SQL = """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y
FROM embeddings"""


def qual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a few numeric features."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    words = F.size(F.split(F.trim("text"), "\\s+"))
    return documents.join(labels, "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"),
        (F.col("n_chars") / words).alias("chars_per_word"),
        "lang",
        F.col("quality").cast("int").alias("quality"),
        F.col("toxic").cast("int").alias("toxic"),
    )


QUAL_SQL = """
SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(words AS DOUBLE) AS n_words,
  CAST(n_chars AS DOUBLE) / words AS chars_per_word, lang,
  CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic
FROM (SELECT *, len(regexp_split_to_array(trim(text), '\\s+')) AS words
      FROM documents JOIN labels USING (doc_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a coarse score that has many ties, and one with hardly any."""
    return li(spark, sf_dir).select(
        *LI_KEYS,
        F.col("label").alias("y"),
        F.round((F.col("f_disc") + F.col("f_tax")) * 5, 4).alias("p"),
        (F.coalesce(F.col("f_price"), F.lit(0.0)) / 200000.0).alias("fine"),
        (F.round((F.col("f_disc") + F.col("f_tax")) * 5, 4) > 0.5).cast("int").alias("pred"),
    )


SCORED_SQL = f"""
SELECT {", ".join(LI_KEYS)}, label AS y, round((f_disc + f_tax) * 5, 4) AS p,
  coalesce(f_price, 0) / CAST(200000 AS DOUBLE) AS fine,
  CASE WHEN round((f_disc + f_tax) * 5, 4) > 0.5 THEN 1 ELSE 0 END AS pred
FROM ({LI_SQL})"""

_VIEWS = {
    "hourly": HOURLY_SQL,
    "panel": PANEL_SQL,
    "li": LI_SQL,
    "emb": EMB_SQL,
    "qual": QUAL_SQL,
    "scored": SCORED_SQL,
}


def with_views(sql: str, *views: str, **more: str) -> str:
    """``sql`` behind a WITH clause of the named views and further common table expressions."""
    parts = [f"{v} AS ({_VIEWS[v]})" for v in views]
    parts += [f"{name} AS ({body})" for name, body in more.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
