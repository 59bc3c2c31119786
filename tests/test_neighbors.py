import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelsmith.operators.classify import knn_classify, knn_votes
from panelsmith.operators import knn_graph as graph
from panelsmith.operators import neighbors
from panelsmith.operators.knn_graph import knn_graph
from panelsmith.operators.neighbors import knn_join
from panelsmith.operators.resample import (
    class_weights,
    edited_nearest_neighbours,
    smote,
    smote_enn,
)
from panelsmith.session import cut_lineage
from panelsmith.sources.tables import TableError


def vectors(spark, x, y=None, text_ids=False):
    rows = [
        (f"{i:05d}" if text_ids else i, [float(v) for v in r], 0 if y is None else int(y[i]))
        for i, r in enumerate(x)
    ]
    kind = "string" if text_ids else "long"
    return spark.createDataFrame(rows, f"id {kind}, vec array<double>, y int").repartition(5).cache()


def brute(a, b, k, p, exclude_self):
    out = []
    for i, v in enumerate(a):
        d = abs(b - v).sum(1) if p == 1 else np.sqrt(((b - v) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(b)), d)) if not (exclude_self and i == j)]
        out += [(i, j, d[j], rank + 1) for rank, j in enumerate(order[:k])]
    return out


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 20, (6, dims))
    return centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims))


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize(("cell_rows", "block_rows"), [(10_000, 100), (25, 8), (3, 8192)])
def test_equals_brute_force(spark, p, cell_rows, block_rows):
    """One cell in blocks, many cells in blocks, and cells with fewer rows than neighbours wanted."""
    x = clustered(400, 3, 9)
    df = vectors(spark, x)
    got = knn_join(
        df, df, "id", "vec", 5, p, True, cell_rows=cell_rows, block_rows=block_rows
    ).toPandas().sort_values(["id", "rank"])
    want = brute(x, x, 5, p, True)
    assert list(zip(got["id"], got["neighbor_id"], got["rank"], strict=True)) == [
        (i, j, r) for i, j, _, r in want
    ]
    np.testing.assert_allclose(got["distance"], [d for _, _, d, _ in want], atol=1e-12)


def test_a_third_of_the_rows_are_copies(spark):
    x = clustered(300, 2, 10)
    x[::3] = x[0]
    df = vectors(spark, x)
    near = knn_join(df, df, "id", "vec", 4, exclude_self=True, cell_rows=20, block_rows=16)
    got = near.toPandas().sort_values(["id", "rank"])
    want = brute(x, x, 4, 2, True)
    assert list(zip(got["id"], got["neighbor_id"], strict=True)) == [(i, j) for i, j, _, _ in want]


def test_two_tables_with_text_ids_and_carried_columns(spark):
    a, b = clustered(40, 3, 11), clustered(90, 3, 12)
    queries = vectors(spark, a, text_ids=True)
    searched = vectors(spark, b, np.arange(90) % 2, text_ids=True)
    got = knn_join(
        queries,
        searched,
        "id",
        "vec",
        3,
        cell_rows=10,
        carry_query=["y"],
        carry_neighbor=["y", "vec"],
    ).toPandas().sort_values(["id", "rank"])
    want = brute(a, b, 3, 2, False)
    assert [int(j) for j in got["neighbor_id"]] == [j for _, j, _, _ in want]
    assert got["neighbor_y"].tolist() == [j % 2 for _, j, _, _ in want]
    assert set(got["y"]) == {0}
    np.testing.assert_array_equal(np.stack(got["neighbor_vec"]), b[[j for _, j, _, _ in want]])


def test_fewer_rows_than_neighbours(spark):
    df = vectors(spark, clustered(3, 2, 13))
    assert knn_join(df, df, "id", "vec", 5, exclude_self=True).count() == 6


def test_missing_entries_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [0.0, 1.0])], "id long, vec array<double>")
    with pytest.raises(Exception, match="no missing entries"):
        knn_join(df, df, "id", "vec", 1).collect()


def test_votes(spark):
    rows = [
        (1, 0.0, 0), (1, 1.0, 1), (1, 1.0, 1),
        (2, 2.0, 1), (2, 4.0, 0),
        (3, 1.0, 1), (3, 1.0, 0),
    ]
    df = spark.createDataFrame(rows, "id int, distance double, y int")

    def votes(weights):
        return {r["id"]: (r["p1"], r["prediction"]) for r in knn_votes(df, "id", "y", weights).collect()}

    assert votes("distance")[1] == (0.0, 0)
    assert votes("distance")[2] == (pytest.approx(2 / 3), 1)
    assert votes("distance")[3] == (0.5, 0)
    assert votes("uniform")[1] == (pytest.approx(2 / 3), 1)


def test_classifying_known_rows(spark):
    x = clustered(60, 2, 14)
    df = vectors(spark, x, np.arange(60) % 2)
    got = knn_classify(df, df, "id", "vec", "y", 5).toPandas().sort_values("id")
    assert got["prediction"].tolist() == [i % 2 for i in range(60)]


@pytest.fixture(scope="module")
def imbalanced(spark):
    x = clustered(400, 3, 15)
    return x, vectors(spark, x, np.arange(400) % 10 == 0)


def test_smote_quota_and_segments(spark, imbalanced):
    x, df = imbalanced
    got = smote(df, "id", "vec", "y", 0.5, k=4).toPandas()
    made = got[got["id"].isna()]
    assert len(made) == int(360 * 0.5 - 40) == made["synthetic_no"].nunique()
    assert (made["y"] == 1).all() and len(got) == 400 + len(made)
    minority = x[::10]
    near = brute(minority, minority, 4, 2, True)
    pairs = [(minority[i], minority[j]) for i, j, _, _ in near]
    for v in np.stack(made["vec"]):
        gaps = [
            np.linalg.norm(v - a) + np.linalg.norm(v - b) - np.linalg.norm(a - b) for a, b in pairs
        ]
        assert min(gaps) < 1e-9


def test_smote_refuses_a_ratio_already_reached(imbalanced):
    with pytest.raises(TableError):
        smote(imbalanced[1], "id", "vec", "y", 0.1)


def test_cleaning_equals_brute_force(spark, imbalanced):
    x, df = imbalanced
    y = (np.arange(400) % 10 == 0).astype(int)
    neighbours = {}
    for i, j, _, _ in brute(x, x, 3, 2, True):
        neighbours.setdefault(i, []).append(y[j])
    mixed = {i for i, near in neighbours.items() if any(c != y[i] for c in near)}
    kept = {r["id"] for r in edited_nearest_neighbours(df, "id", "vec", "y").collect()}
    assert kept == {i for i in range(400) if y[i] == 1 or i not in mixed}
    everywhere = edited_nearest_neighbours(df, "id", "vec", "y", candidates="all")
    assert {r["id"] for r in everywhere.collect()} == set(range(400)) - mixed


def test_smote_enn_keeps_the_minority(imbalanced):
    got = smote_enn(imbalanced[1], "id", "vec", "y", 0.4).toPandas()
    assert (got["y"] == 1).sum() == 40 + int(360 * 0.4 - 40)
    assert got["row_key"].is_unique


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    balanced = {tuple(r) for r in class_weights(df, "y").collect()}
    assert balanced == {(0, 8 / 12), (1, 2.0)}
    explicit = {tuple(r) for r in class_weights(df, "y", {0: 1, 1: 3}).collect()}
    assert explicit == {(0, 1.0), (1, 3.0)}
    assert class_weights(df, "y", None).select(F.sum("weight")).first()[0] == 8.0


def recall(got, want, k):
    found = {(r["id"], r["neighbor_id"]) for r in got}
    return np.mean([(i, j) in found for i, j, _, _ in want]) if want else 1.0


@pytest.mark.parametrize(("n", "dims", "p"), [(2000, 64, 2), (2000, 13, 2), (800, 8, 1)])
def test_graph_recall(spark, n, dims, p):
    """Normal data, where the exact join's cells do not help; distances and ranks of what is found are exact."""
    x = np.random.default_rng(dims).normal(size=(n, dims))
    got = knn_graph(vectors(spark, x), "id", "vec", 5, p).collect()
    assert recall(got, brute(x, x, 5, p, True), 5) >= 0.95
    lists = {}
    for r in got:
        d = x[r["id"]] - x[r["neighbor_id"]]
        assert r["id"] != r["neighbor_id"]
        assert r["distance"] == pytest.approx(np.abs(d).sum() if p == 1 else np.sqrt((d * d).sum()))
        lists.setdefault(r["id"], []).append((r["rank"], r["distance"]))
    assert len(lists) == n
    for own in lists.values():
        own.sort()
        assert [rank for rank, _ in own] == [1, 2, 3, 4, 5] and own == sorted(own, key=lambda t: t[1])


def test_graph_of_two_tables_and_copies(spark):
    """Text ids; a third of the searched rows are copies of one vector; fewer rows than neighbours wanted."""
    a, b = clustered(60, 6, 3), clustered(600, 6, 4)
    b[::3] = b[0]
    queries, searched = vectors(spark, a, text_ids=True), vectors(spark, b, text_ids=True)
    got = knn_graph(queries, "id", "vec", 4, searched=searched).collect()
    want = {(i, rank): d for i, _, d, rank in brute(a, b, 4, 2, False)}
    near = [r["distance"] <= want[int(r["id"]), r["rank"]] * (1 + 1e-9) for r in got]
    assert len(got) == 240 and np.mean(near) >= 0.95
    few = vectors(spark, b[:3])
    assert knn_graph(few, "id", "vec", 5).groupBy("id").count().where("count = 2").count() == 3
    assert knn_graph(few.limit(0), "id", "vec", 5).count() == 0


def test_graph_work_does_not_grow_with_the_cells(spark):
    """The rows that meet at a row are bounded by the list length, whatever the number of rows."""
    width = 8
    for n in (500, 2000):
        nodes = cut_lineage(vectors(spark, clustered(n, 5, n)).select(F.col("id").alias("node"), "vec", F.lit(True).alias("target")))
        lists = cut_lineage(graph._leaf_lists(nodes, 2, 64, width, 2, 1))
        assert lists.groupBy("node").count().agg(F.max("count")).first()[0] <= width
        found = graph._descent(nodes, lists, width, 2)
        assert found.count() <= n * (2 * width + 1) * 2 * width


@pytest.mark.parametrize("dims", [13, 64])
def test_copies_are_bounded_by_blocks(spark, dims):
    """Normal data in many dimensions, where every cell may hold a neighbour: one copy per block, not per cell."""
    x = np.random.default_rng(dims).normal(size=(1500, dims))
    df = vectors(spark, x).select("id", "vec")
    pivots = neighbors._choose_pivots(df, 60, 1500)
    assigned = cut_lineage(df.withColumn("_p", neighbors._nearest_cell(pivots, 2)("vec")).select("id", "vec", "_p.cell", "_p.radius"))
    cells = neighbors._describe_cells(assigned, pivots, 5)
    first, several = cells.blocks(300)
    held = np.bincount(first[several == 1], cells.n[several == 1])
    assert len(pivots) >= 40 and held.max() <= 300 and (first + several).max() <= 2 * 1500 / 300 + 1
    visit = neighbors._visited_blocks(cells, first, several, 5, 2)
    sent = assigned.withColumn("b", visit("vec", "cell", F.lit(math.inf).cast("double"))).select("b").collect()
    assert all(len(r["b"]) == len(set(r["b"])) <= (first + several).max() for r in sent)
    got = knn_join(df, df, "id", "vec", 5, 2, True, cell_rows=25, block_rows=300).collect()
    want = brute(x, x, 5, 2, True)
    assert {(r["id"], r["neighbor_id"], r["rank"]) for r in got} == {(i, j, rank) for i, j, _, rank in want}


def test_nothing_to_search(spark):
    df = vectors(spark, clustered(5, 3, 1))
    assert knn_join(df, df.limit(0), "id", "vec", 2).count() == 0
    assert knn_join(df.limit(0), df, "id", "vec", 2).count() == 0


def test_waves_stay_below_the_distance():
    """Lower bounds hold for every number, and for odd columns; on normal data they are close."""
    x = np.linspace(0, 60, 600_001)
    waves = zip(neighbors.Waves.FREQUENCIES, neighbors.Waves.WEIGHTS, strict=True)
    assert (neighbors.Waves.CONSTANT - sum(w * np.cos(f * x) for f, w in waves) <= x).all()
    rng = np.random.default_rng(3)
    for a in (rng.normal(size=(200, 64)), rng.standard_cauchy((200, 7)) * 1e6, np.c_[rng.normal(size=(200, 3)), np.ones(200)]):
        bounds = neighbors.Waves(a)
        below = bounds.total - bounds.of(a).astype(float) @ bounds.of(a).T.astype(float)
        exact = np.abs(a[:, None] - a[None]).sum(2)
        assert (below <= exact + bounds.slack + 1e-11 * exact).all()
        if a.shape[1] == 64:
            assert below.mean() > 0.9 * exact.mean()


@pytest.mark.parametrize("exclude_self", [True, False])
def test_manhattan_neighbours_of_odd_rows(exclude_self):
    """Ties, constant columns, very different scales and infinite entries."""
    rng = np.random.default_rng(4)
    ties = rng.integers(0, 3, (300, 6)).astype(float)
    scales = rng.normal(size=(300, 6)) * 10.0 ** np.arange(-6, 6, 2)
    endless = np.where(np.arange(300)[:, None] == 7, np.inf, scales)
    for x in (ties, scales, np.c_[ties, np.full(300, 1e9)], np.zeros((300, 2))):
        ids = pa.array(np.arange(len(x)))
        got = zip(*neighbors.block_neighbors(ids, x, ids, x, 5, 1, exclude_self), strict=True)
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _, _ in brute(x, x, 5, 1, exclude_self)]
    ids = pa.array(np.arange(300))
    rows, _, _ = neighbors.block_neighbors(ids, endless[:5], ids, endless, 5, 1, False)
    assert len(rows) == 25


def _block_of(n_a, n_b, n_cells, k, p, bound):
    """Result, exact distances and peak bytes of one task of the second round, on normal data."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(n_a, 64)), rng.normal(size=(n_b, 64))
    cell = np.arange(n_b) * n_cells // n_b
    sizes = np.bincount(cell)
    cells = neighbors._Cells(b[:n_cells], sizes, np.zeros(n_cells), np.full(n_cells, 1e9), np.full(n_cells, np.inf))

    def table(first, x, **more):
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 64, pa.int32()), pa.array(x.ravel()))
        columns = {"id": pa.array(first + np.arange(len(x))), "vec": vec}
        return pa.table(columns | {c: pa.array(v) for c, v in more.items()})

    left = table(0, a, cell=np.full(n_a, -1), radius=np.full(n_a, 1e9), bound=np.full(n_a, bound))
    right = table(10**6, b, cell=cell)
    schema = pa.schema([("id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.float64())])
    output = {"id": ("query", "id"), "neighbor_id": ("searched", "id"), "distance": ("distance", "")}
    run = neighbors._block_udf(cells, k, p, True, False, output, schema)
    tracemalloc.start()
    found = run(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, np.concatenate([neighbors.distances(a[i : i + 128], b, p) for i in range(0, n_a, 128)]), peak


@pytest.mark.parametrize("p", [1, 2])
def test_a_task_holds_the_nearest_only(p):
    """A task keeps k rows per query, whatever the number of cells, and tells of none beyond the known bound."""
    near = 1e9
    found, exact, peak = _block_of(2_000, 2_000, 200, 8, p, near)
    want = np.sort(exact, 1)[:, :8]
    np.testing.assert_allclose(found["distance"].to_numpy().reshape(-1, 8), want, atol=1e-9)
    assert peak < 32e6
    bound = float(np.median(want[:, 3]))
    found, _, _ = _block_of(2_000, 2_000, 200, 8, p, bound)
    assert found.num_rows == (want <= bound).sum()


def test_few_manhattan_distances_are_worked_out(monkeypatch):
    """Nearly all pairs are told apart by lower bounds."""
    counted, whole = [], neighbors._exact
    monkeypatch.setattr(neighbors, "_exact", lambda difference, p: counted.append(len(difference)) or whole(difference, p))
    monkeypatch.setattr(neighbors, "_ranking", lambda a, b, p: counted.append(len(a) * len(b)) or np.ones((len(a), len(b))))
    x = np.random.default_rng(6).normal(size=(4_000, 64))
    ids = pa.array(np.arange(4_000))
    neighbors.block_neighbors(ids, x, ids, x, 4, 1, True)
    assert sum(counted) < 0.1 * 4_000**2


def test_graph_vectors_travel_in_single_precision_where_nothing_is_lost(spark, monkeypatch):
    kept, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: kept.append(df.schema) or cut(df))
    x = clustered(300, 5, 8).astype(np.float32).astype(float)
    for rows, kind in ((x, "array<float>"), (np.r_[x[:-1], x[-1:] + 1e-12], "array<double>")):
        kept.clear()
        got = {(r["id"], r["neighbor_id"]): r["distance"] for r in knn_graph(vectors(spark, rows), "id", "vec", 3).collect()}
        assert kept[0]["vec"].dataType.simpleString() == kind
        assert all(d == np.sqrt(((rows[i] - rows[j]) ** 2).sum()) for (i, j), d in got.items())


def test_uniform_manhattan_votes_in_many_dimensions(spark, monkeypatch):
    """Votes equal brute force, and fast distances of all pairs are no part of it."""
    x = np.random.default_rng(9).normal(size=(600, 64))
    y = np.arange(600) % 2
    got = knn_classify(vectors(spark, x, y), vectors(spark, x, y), "id", "vec", "y", 7, "uniform", p=1, exclude_self=True).collect()
    want = np.zeros(600)
    for i, j, _, _ in brute(x, x, 7, 1, True):
        want[i] += y[j] / 7
    assert {r["id"]: round(r["p1"], 9) for r in got} == {i: round(v, 9) for i, v in enumerate(want)}
    monkeypatch.setattr(neighbors, "_ranking", lambda *_: pytest.fail("all pairs are worked out"))
    ids = pa.array(np.arange(600))
    assert len(neighbors.block_neighbors(ids, x, ids, x, 7, 1, True)[0]) == 7 * 600


def test_the_first_round_covers_the_own_block(spark):
    """A query row meets all cells of its block at once, so the second round starts with a close bound."""
    rng = np.random.default_rng(10)
    b = rng.normal(size=(600, 12))
    pivots = b[:6]
    cell = neighbors.distances(b, pivots, 2).argmin(1)
    radius = neighbors.distances(b, pivots, 2).min(1)
    limits = [np.array([f(radius[cell == c]) for c in range(6)]) for f in (np.min, np.max)]
    cells = neighbors._Cells(pivots, np.bincount(cell), *limits, np.full(6, np.inf))
    vec = pa.ListArray.from_arrays(pa.array(np.arange(601) * 12, pa.int32()), pa.array(b.ravel()))
    rows = pa.table({"id": pa.array(np.arange(600)), "vec": vec, "cell": pa.array(cell), "radius": pa.array(radius)})
    schema = pa.schema([("id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.float64())])
    output = {"id": ("query", "id"), "neighbor_id": ("searched", "id"), "distance": ("distance", "")}
    found = neighbors._block_udf(cells, 5, 2, True, True, output, schema)(rows, rows).to_pylist()
    want = {(i, j) for i, j, _, _ in brute(b, b, 5, 2, True)}
    assert {(r["id"], r["neighbor_id"]) for r in found} == want
    visit = neighbors._visited_blocks(cells, np.zeros(6, np.int64), np.ones(6, np.int64), 5, 2).func
    assert not any(visit(vec, pa.array(cell), pa.array(np.full(600, np.inf))).to_pylist())


@pytest.mark.parametrize("p", [1, 2])
def test_few_pivots_are_looked_at(spark, p, monkeypatch):
    """In few dimensions neither the search of the own cell nor that of the cells to visit compares a row with all."""
    rng = np.random.default_rng(11)
    pivots = np.unique(rng.normal(size=(4_000, 2)), axis=0)
    x = np.r_[np.repeat(pivots[::40], 30, axis=0) + rng.normal(size=(3_000, 2)) * 1e-3, pivots[::40]]
    far = np.concatenate([neighbors.distances(x[i : i + 100], pivots, p) for i in range(0, len(x), 100)])
    compared, ranking = [], neighbors._ranking
    monkeypatch.setattr(neighbors, "_ranking", lambda a, b, p: compared.append(len(a) * len(b)) or ranking(a, b, p))
    monkeypatch.setattr(neighbors, "_waves", lambda *_: None)
    monkeypatch.setattr(neighbors, "GROUPED", 256, raising=False)
    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 2, pa.int32()), pa.array(x.ravel()))
    assigned = neighbors._nearest_cell(pivots, p).func(vec)
    cell, radius = assigned.field(0).to_numpy(), assigned.field(1).to_numpy()
    assert (cell == far.argmin(1)).all()
    np.testing.assert_allclose(radius, far.min(1), atol=1e-6)
    high = np.full(4_000, 0.05)
    cells = neighbors._Cells(pivots, np.ones(4_000, np.int64), np.zeros(4_000), high, np.full(4_000, np.inf))
    bound = np.full(len(x), 0.02)
    got = neighbors._visited_blocks(cells, np.arange(4_000), np.ones(4_000, np.int64), 1, p).func(vec, pa.array(cell), pa.array(bound))

    def reached(more):
        some = (far <= 0.07 + more) & ((far - radius[:, None]) / 2 <= 0.02 + more)
        some[np.arange(len(x)), cell] = False
        return [set(np.flatnonzero(row)) for row in some]

    assert all(least <= set(g) <= most for least, g, most in zip(reached(0), got.to_pylist(), reached(1e-3), strict=True))
    assert sum(compared) < 0.5 * len(x) * 4_000
