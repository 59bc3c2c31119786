import json
import os

import pytest
from pyspark.sql import functions as F

from panelsmith.operators import clean, split, validate
from panelsmith.sources import tables
from panelsmith.sources.tables import TableError

SCHEMA = "e string, t long, y int, x double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_csv_with_missing_and_nan(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text("e,t,y,x\n1,0,0,1.5\n1,1,1,\n2,0,0,NaN\n")
    df = tables.load_table(spark, str(path), "e", "y")
    assert dict(df.dtypes)["e"] == "string"
    assert [r["x"] for r in df.orderBy("e", "t").collect()] == [1.5, None, None]


def test_missing_file_and_column(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "none.csv"), "e", "y")
    path = tmp_path / "p.csv"
    path.write_text("e,t\n1,0\n")
    with pytest.raises(TableError):
        tables.load_table(spark, str(path), "e", "y")


def test_three_label_values_are_refused(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("e,y\n1,0\n1,1\n1,2\n")
    with pytest.raises(TableError):
        tables.load_table(spark, str(path), "e", "y")


GOOD = [("a", 0, 0, 1.0), ("a", 1, 1, 2.0), ("b", 0, 0, 3.0)]


@pytest.mark.parametrize(
    ("extra", "check"),
    [
        (("b", -1, 0, 0.0), "time_not_negative"),
        (("b", 5, 2, 0.0), "label_binary"),
        (("b", 5, None, 0.0), "label_binary"),
        (("b", 0, 0, 0.0), "unique_entity_time"),
    ],
)
def test_violations(spark, extra, check):
    validate.validate_panel(frame(spark, GOOD), "e", "t", "y")
    with pytest.raises(TableError, match=check):
        validate.validate_panel(frame(spark, [*GOOD, extra]), "e", "t", "y")


def test_schema_violations_come_first(spark):
    df = frame(spark, GOOD)
    with pytest.raises(TableError, match="required_columns"):
        validate.validate_panel(df, "e", "hour", "y")
    text = df.withColumn("t", F.col("t").cast("string"))
    with pytest.raises(TableError, match="time_numeric"):
        validate.validate_panel(text, "e", "t", "y")


def test_splits_round_trip_and_overlap(spark, tmp_path):
    df = frame(spark, [(f"e{i}", t, i % 2, i / 7) for i in range(40) for t in range(3)])
    parts = split.split_grouped(df, "e", "y")
    paths = tables.write_splits(parts, str(tmp_path / "s"))
    frames = tables.load_splits(spark, paths, "e", SCHEMA)
    assert sum(f.count() for f in frames.values()) == 120
    got = sorted(r for f in frames.values() for r in f.select("e", "t", "y", "x").collect())
    assert got == sorted(df.collect())
    with pytest.raises(TableError, match="more than one split"):
        tables.load_splits(spark, {**paths, "test": paths["train"]}, "e", SCHEMA)


def test_split_files_with_other_columns(spark, tmp_path):
    for name, header in [("a", "e,x"), ("b", "e,z"), ("c", "e,x")]:
        (tmp_path / f"{name}.csv").write_text(f"{header}\n{name},1\n")
    paths = {n: str(tmp_path / f"{f}.csv") for n, f in zip(tables.SPLITS, "abc", strict=True)}
    with pytest.raises(TableError, match="different columns"):
        tables.load_splits(spark, paths, "e")


def test_split_quotas_and_entities_without_label(spark):
    rows = [(f"p{i}", 0, 1, 0.0) for i in range(20)] + [(f"n{i}", 0, 0, 0.0) for i in range(50)]
    rows += [("u", 0, None, 0.0)]
    got = split.split_grouped(frame(spark, rows), "e", "y").toPandas()
    sizes = got.groupby(["split", "y"]).size().to_dict()
    assert sizes == {
        ("train", 0): 35,
        ("train", 1): 14,
        ("val", 0): 7,
        ("val", 1): 3,
        ("test", 0): 8,
        ("test", 1): 3,
    }
    assert "u" not in set(got["e"])
    with pytest.raises(TableError):
        split.split_grouped(frame(spark, rows), "e", "y", 0.8, 0.2)


def test_split_depends_on_the_seed_only(spark):
    df = frame(spark, [(f"e{i}", 0, i % 2, 0.0) for i in range(60)])

    def splits(seed, d):
        rows = split.split_grouped(d, "e", "y", seed=seed).collect()
        return {r["e"]: r["split"] for r in rows}

    assert splits(1, df) == splits(1, df.repartition(7))
    assert splits(1, df) != splits(2, df)


def test_strict_and_lenient_drop(spark):
    df = frame(spark, GOOD)
    with pytest.raises(TableError):
        clean.drop_columns_strict(df, ["x", "nope"])
    assert clean.drop_columns_if_present(df, ["x", "nope"]).columns == ["e", "t", "y"]


def test_one_hot(spark):
    df = spark.createDataFrame(
        [(1, "a", 9), (2, "b", 9), (3, None, 9)], "id int, g string, g_a int"
    )
    model = clean.OneHot(["g"]).fit(df)
    rows = model.transform(df).orderBy("id").select("id", "g_a", "g_b").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    unseen = spark.createDataFrame([(4, "c")], "id int, g string")
    assert model.transform(unseen).first()[1:] == (0, 0)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "a_b", "c"])
    assert clean.normalize_names(df).columns == ["a_b", "a_b_2", "c"]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_forward_fill_over_buckets(spark, levels):
    """Windows of four time steps must give what one window per entity gives."""
    rows = [
        (f"e{i % 3}", t, 0, float(t) if (t * 7 + i) % 11 == 0 else None)
        for i in range(3)
        for t in range(100)
    ]
    df = frame(spark, rows)
    got = clean.forward_fill(df, "e", "t", ["x"], width=4, levels=levels).toPandas()
    want = df.toPandas().sort_values(["e", "t"])
    want["x"] = want.groupby("e")["x"].ffill()
    got = got.sort_values(["e", "t"])
    assert list(got["x"].fillna(-1)) == list(want["x"].fillna(-1))


def test_metrics_and_params_files(spark, tmp_path):
    metrics = spark.createDataFrame([("m", 0.5, None)], "model string, F1 double, AUC double")
    tables.write_metrics(metrics, str(tmp_path / "m"))
    params = {"k": 4, "weights": "distance", "priors": [1, 0.5], "cw": {0: 1, 1: 2}, "none": None}
    tables.write_params(spark, params, str(tmp_path / "p"))

    def read(folder):
        name = next(f for f in os.listdir(tmp_path / folder) if f.startswith("part"))
        return json.loads((tmp_path / folder / name).read_text())

    assert read("m") == {"model": "m", "F1": 0.5, "AUC": None}
    assert read("p") == {**params, "priors": [1.0, 0.5], "cw": {"0": 1.0, "1": 2.0}}


@pytest.mark.parametrize("keep", [True, False])
def test_semi_filter_sorts_no_rows(spark, keep):
    """Only the keys are held by a task; copies, missing keys and keys without rows change nothing."""
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "k long, v string")
    keys = spark.createDataFrame([(1,), (1,), (4,), (None,), (9,)], "k long")
    got = split.semi_filter(rows, keys, "k", keep)
    assert {r["v"] for r in got.collect()} == ({"a", "b", "e"} if keep else {"c", "d"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
