"""Loading, checking, profiling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.operators import clean, split, tune, validate
from panelsmith.plans.catalog.registry import query, round_columns, rounded, rounded_sql
from panelsmith.plans.fixtures import (
    MEASURES,
    emb,
    hourly_events,
    li,
    panel,
    table,
    with_views,
)
from panelsmith.session import cut_lineage, scratch_path
from panelsmith.sources import tables

ENTITY, TIME, LABEL = "entity_id", "hour", "label"

STATS_SQL = """
SELECT entity_id, max(label) AS max_label, count(hour) AS n_times FROM panel GROUP BY entity_id"""


def _assigned_sql(stratum: str | None) -> str:
    part = f"PARTITION BY {stratum}" if stratum else ""
    return f"""
SELECT entity_id, max_label, n_times,
  CASE WHEN rk <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
       WHEN rk <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val'
       ELSE 'test' END AS split
FROM (SELECT *, count(*) OVER ({part}) AS n,
        row_number() OVER ({part} ORDER BY md5(concat(entity_id, ':42')), entity_id) AS rk
      FROM stats {f"WHERE {stratum} IN (0, 1)" if stratum else ""})"""


def with_split(sql: str, stratum: str | None = "max_label") -> str:
    return with_views(sql, "panel", stats=STATS_SQL, assigned=_assigned_sql(stratum))


def split_panel(spark: SparkSession, sf_dir: str, stratify: bool = True) -> DataFrame:
    return split.split_grouped(panel(spark, sf_dir), ENTITY, LABEL, stratify=stratify)


@query(
    "load_table",
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_linestatus FROM lineitem""",
)
def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.load_table(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey", "l_linestatus")
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_linestatus",
    )


@query(
    "split_round_trip",
    with_split(
        f"""SELECT split, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities,
        CAST(sum(label) AS BIGINT) AS n_positive, CAST(sum(hour) AS BIGINT) AS sum_hour,
        {rounded_sql("sum(hr)", 4)} AS sum_hr, count(resp) AS n_resp
        FROM panel JOIN assigned USING (entity_id) GROUP BY split"""
    ),
)
def split_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits as CSV files in the shared folder, read back and checked."""
    paths = tables.write_splits(split_panel(spark, sf_dir), scratch_path(spark, "splits"))
    measures = ", ".join(f"{m} double" for m in MEASURES)
    schema = f"{ENTITY} string, {TIME} long, {measures}, gender int, {LABEL} int"
    frames = tables.load_splits(spark, paths, ENTITY, schema)
    tagged = [df.withColumn("split", F.lit(name)) for name, df in frames.items()]
    return (
        validate.union_all(tagged)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(ENTITY).alias("n_entities"),
            F.sum(LABEL).alias("n_positive"),
            F.sum(TIME).alias("sum_hour"),
            rounded(F.sum("hr"), 4).alias("sum_hr"),
            F.count("resp").alias("n_resp"),
        )
    )


@query(
    "validate_panel",
    with_views(
        """SELECT 0 AS seq, 'required_columns' AS check_name, CAST(0 AS BIGINT) AS n_bad
        UNION ALL SELECT 1, 'time_numeric', 0 UNION ALL SELECT 2, 'label_numeric', 0
        UNION ALL SELECT 3, 'time_not_negative', count(*) FILTER (hour < 0) FROM hourly
        UNION ALL SELECT 4, 'label_binary',
          count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) FROM hourly
        UNION ALL SELECT 5, 'unique_entity_time', count(*) FILTER (n > 1)
          FROM (SELECT count(*) AS n FROM hourly GROUP BY entity_id, hour)""",
        "hourly",
    ),
)
def validate_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.panel_violations(hourly_events(spark, sf_dir), ENTITY, TIME, LABEL)


@query(
    "check_disjoint",
    """SELECT user_id, count(DISTINCT event_type) AS n_splits FROM events
    GROUP BY user_id HAVING count(DISTINCT event_type) > 1""",
)
def check_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users shared by event types, as entities shared by splits."""
    return validate.shared_entities(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(
    "split_summary",
    with_split(
        f"""SELECT split, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_entities,
        {rounded_sql("avg(CAST(ever AS DOUBLE))")} AS positive_rate
        FROM (SELECT split, entity_id, count(*) AS n, max(label) AS ever
              FROM panel JOIN assigned USING (entity_id) GROUP BY split, entity_id)
        GROUP BY split"""
    ),
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = validate.split_summary(split_panel(spark, sf_dir), ENTITY, LABEL)
    return round_columns(summary, ["positive_rate"])


@query("entity_stats", with_views("SELECT * FROM stats", "panel", stats=STATS_SQL))
def entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.entity_stats(panel(spark, sf_dir), ENTITY, TIME, LABEL)


@query(
    "split_stratified",
    with_split(
        "SELECT entity_id, hour, label, split FROM panel JOIN assigned USING (entity_id)"
    ),
)
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_panel(spark, sf_dir).select(ENTITY, TIME, LABEL, "split")


@query(
    "split_random",
    with_split(
        "SELECT entity_id, hour, label, split FROM panel JOIN assigned USING (entity_id)", None
    ),
)
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_panel(spark, sf_dir, stratify=False).select(ENTITY, TIME, LABEL, "split")


@query(
    "semi_filter",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS kept
    FROM lineitem""",
)
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose order is urgent, and those whose order is not."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    urgent = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_orderkey").alias("l_orderkey"))
    )
    kept = split.semi_filter(lines, urgent, "l_orderkey").withColumn("kept", F.lit(True))
    rest = split.semi_filter(lines, urgent, "l_orderkey", keep=False)
    return kept.unionByName(rest.withColumn("kept", F.lit(False)))


@query(
    "split_xy",
    with_views(
        f"""SELECT entity_id, hour, {", ".join(f"{rounded_sql(m)} AS {m}" for m in MEASURES)},
        gender, label FROM panel""",
        "panel",
    ),
)
def split_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and label taken apart and put together again by key."""
    features, label = split.split_xy(panel(spark, sf_dir), LABEL, [ENTITY, TIME])
    joined = clean.concat_columns(features, label, [ENTITY, TIME])
    return round_columns(joined, list(MEASURES))


@query(
    "class_distribution",
    with_views(
        f"""SELECT label, count(*) AS n,
        {rounded_sql("count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)")} AS share
        FROM li GROUP BY label""",
        "li",
    ),
)
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(validate.class_distribution(li(spark, sf_dir), "label"), ["share"])


@query(
    "profile_missing",
    with_views(
        f"""SELECT column_name, n_missing, {rounded_sql("100.0 * n_missing / n")} AS pct_missing
        FROM (
          SELECT 'f_qty' AS column_name, count(*) - count(f_qty) AS n_missing, count(*) AS n FROM li
          UNION ALL SELECT 'f_price', count(*) - count(f_price), count(*) FROM li
          UNION ALL SELECT 'f_disc', count(*) - count(f_disc), count(*) FROM li
          UNION ALL SELECT 'f_tax', count(*) - count(f_tax), count(*) FROM li
          UNION ALL SELECT 'label', count(*) - count(label), count(*) FROM li)
        WHERE n_missing > 0""",
        "li",
    ),
)
def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(validate.profile_missing(li(spark, sf_dir)), ["pct_missing"])


@query(
    "profile_shape",
    """SELECT count(*) AS n_rows, 6 AS n_columns,
    'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_names
    FROM orders""",
)
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.profile_shape(table(spark, sf_dir, "orders"))


@query(
    "fold_assignment",
    with_views(
        """SELECT vec_id, y, CAST((row_number() OVER (
             PARTITION BY y ORDER BY md5(concat(vec_id, ':42')), vec_id) - 1) % 5 AS INTEGER) AS fold
        FROM emb""",
        "emb",
    ),
)
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.row_folds(emb(spark, sf_dir).select("vec_id", "y"), "vec_id", "y")


@query(
    "entity_fold_assignment",
    with_views(
        """SELECT entity_id, hour, fold FROM panel JOIN (
             SELECT entity_id, CAST((row_number() OVER (
               PARTITION BY max_label ORDER BY md5(concat(entity_id, ':42')), entity_id) - 1) % 5
               AS INTEGER) AS fold FROM stats) USING (entity_id)""",
        "panel",
        stats=STATS_SQL,
    ),
)
def entity_fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(panel(spark, sf_dir).select(ENTITY, TIME, LABEL))
    return tune.entity_folds(rows, ENTITY, LABEL).select(ENTITY, TIME, "fold")
