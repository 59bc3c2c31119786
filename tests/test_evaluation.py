import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsmith import presets
from panelsmith.operators import evaluate

# Confusion counts (tp, fp, fn, tn) of nine published models, and the accuracy,
# precision, recall, F1, MAE and RMSE published for them.
PUBLISHED = [
    (
        (1146, 648, 1090, 135745),
        (0.9874629406545528, 0.6387959866220736, 0.5125223613595706),
        (0.5687344913151364, 0.0125370593454472, 0.11196901064780022),
    ),
    (
        (850, 3450, 1469, 136097),
        (0.9653264348046748, 0.19767441860465115, 0.3665373005605865),
        (0.2568363801178426, 0.03467356519532517, 0.18620839184989801),
    ),
    (
        (779, 2663, 1540, 136884),
        (0.9703734510030593, 0.226321905868681, 0.3359206554549375),
        (0.2704391598680785, 0.029626548996940776, 0.17212364450284212),
    ),
    (
        (1871, 11674, 448, 127873),
        (0.9145531698927156, 0.13813215208564045, 0.8068132815868909),
        (0.2358799798285426, 0.08544683010728434, 0.29231289760680135),
    ),
    (
        (1831, 9791, 488, 129756),
        (0.927544302369842, 0.15754603338495957, 0.7895644674428633),
        (0.26267843052865647, 0.07245569763015804, 0.26917596034965313),
    ),
    (
        (889, 10318, 1430, 129229),
        (0.917189460476788, 0.07932542161149282, 0.3833548943510134),
        (0.13145053970131598, 0.08281053952321205, 0.2877682045035762),
    ),
    (
        (1118, 14914, 1201, 124633),
        (0.8864068910098262, 0.06973552894211577, 0.4821043553255714),
        (0.12184622091439158, 0.11359310899017383, 0.33703576811693714),
    ),
    (
        (1197, 2197, 1122, 137350),
        (0.9766046832926847, 0.3526812021213907, 0.5161707632600259),
        (0.41904428496411694, 0.023395316707315355, 0.1529552768207601),
    ),
    (
        (1230, 3942, 1089, 135605),
        (0.9645369574105142, 0.23781902552204176, 0.5304010349288486),
        (0.32839407288746497, 0.035463042589485856, 0.18831633649125043),
    ),
]


def test_published_metrics(spark):
    counts = spark.createDataFrame(
        [(i, *c) for i, (c, _, _) in enumerate(PUBLISHED)],
        "i int, tp long, fp long, fn long, tn long",
    )
    rows = evaluate.metrics_from_counts(counts).orderBy("i").collect()
    for row, (_, first, second) in zip(rows, PUBLISHED, strict=True):
        got = [row[name] for name in presets.METRIC_NAMES[:6]]
        assert got == pytest.approx([*first, *second], rel=1e-12)


def scored(spark, y, p):
    rows = [(int(a), float(b)) for a, b in zip(y, p, strict=True)]
    return spark.createDataFrame(rows, "y int, p double").withColumn(
        "z", (F.col("p") > 0.5).cast("int")
    )


def pair_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [7, 10_000])
def test_auc_counts_pairs(spark, levels):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 900)
    p = rng.integers(0, levels, 900) / levels + 0.1 * y
    df = scored(spark, y, p)
    assert evaluate.auc_roc(df, "y", "p").first()["auc"] == pytest.approx(pair_auc(y, p))
    curve = evaluate.roc_curve(df, "y", "p").toPandas().sort_values(["fpr", "tpr"])
    assert np.trapezoid(curve["tpr"], curve["fpr"]) == pytest.approx(pair_auc(y, p))
    full = evaluate.roc_curve(df, "y", "p", drop_collinear=False)
    assert full.count() == len(np.unique(p)) + 1 >= len(curve)


def test_single_class(spark):
    df = scored(spark, [0, 0, 0], [0.1, 0.6, 0.6])
    row = evaluate.classification_metrics(df, "y", "z", "p").first()
    assert row["AUC-ROC"] is None
    assert (row["Precision"], row["Recall"], row["F1 Score"]) == (0.0, 0.0, 0.0)
    shares = evaluate.confusion_matrix_normalized(df, "y", "z").toPandas()
    assert shares.loc[shares["actual"] == 1, "share"].tolist() == [0.0, 0.0]


def test_average_precision_and_end_point(spark):
    df = scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    area = evaluate.average_precision(df, "y", "p").first()["average_precision"]
    assert area == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    end = evaluate.pr_curve(df, "y", "p").where("threshold IS NULL").first()
    assert (end["precision"], end["recall"]) == (1.0, 0.0)


def test_select_best(spark):
    df = spark.createDataFrame(
        [("a", 0, 0.3), ("b", 1, 0.5), ("c", 2, 0.5)], "model string, seq int, f1 double"
    )
    assert evaluate.select_best(df, "f1", "seq").first()["model"] == "b"
    with pytest.raises(evaluate.NoUsefulModel):
        evaluate.select_best(df.withColumn("f1", F.lit(0.0)), "f1", "seq")


def test_many_models_at_once_equal_single_ones(spark):
    """Three models of unlike size, ties and NULLs; one without any label, rows without a model."""
    rng = np.random.default_rng(21)
    rows = []
    for name, n, levels in (("a", 900, 9), ("b", 60, 5_000), ("c", 400, 3)):
        for _ in range(n):
            y = None if rng.random() < 0.1 else int(rng.random() < 0.4)
            p = None if rng.random() < 0.1 else float(rng.integers(0, levels) / levels)
            rows.append((name, y, p))
    rows += [("unlabelled", None, 0.5), (None, 1, 0.5), ("same", 0, 0.25), ("same", 0, 0.75)]
    df = spark.createDataFrame(rows, "model string, y int, p double")
    df = df.withColumn("z", (F.col("p") > 0.5).cast("int"))
    got = evaluate.compare_models(df, "model", "y", "z", "p")

    def listed(table):
        return sorted(map(str, table.collect()))

    for name in ("a", "b", "c", "same"):
        own = df.where(F.col("model") == name)
        mine = {k: t.where(F.col("model") == name).drop("model") for k, t in vars(got).items()}
        assert mine["metrics"].collect() == evaluate.classification_metrics(own, "y", "z", "p").collect()
        assert listed(mine["confusion"].drop("share")) == listed(evaluate.confusion_matrix(own, "y", "z"))
        assert listed(mine["confusion"].drop("n")) == listed(
            evaluate.confusion_matrix_normalized(own, "y", "z")
        )
        area = evaluate.average_precision(own, "y", "p").first()["average_precision"]
        assert mine["areas"].first()["average_precision"] == pytest.approx(area)
        assert listed(mine["roc"]) == listed(evaluate.roc_curve(own, "y", "p"))
        assert listed(mine["pr"]) == listed(evaluate.pr_curve(own, "y", "p"))
    assert got.roc.where("model = 'unlabelled'").count() == 0
    assert got.metrics.where("model = 'unlabelled'").first()["AUC-ROC"] is None
    assert got.metrics.count() == 5
    assert got.roc.where("model IS NULL").count() == 0
