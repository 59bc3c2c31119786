"""Approximate k-nearest neighbours: a forest of random projections, refined by neighbour descent.

The exact join (``neighbors.knn_join``) visits every cell that may hold a neighbour, which in many dimensions
are nearly all. Here the work of a row does not depend on the number of rows:

1. Each tree of the forest sorts all rows by the signs of random projections and cuts the order into leaves of
   ``leaf_rows`` neighbouring rows, so leaves are equal in size for any data; a row is compared with the rows
   of its leaf, one leaf per tree.
2. Every row keeps the ``width`` nearest it has met. A round of descent brings together, at every row, the rows
   on its list and the nearest of those that list it, and compares them with each other: neighbours of a
   neighbour are likely neighbours. Only distances that enter a list leave the task. Rounds end when few do.

Lists are mergeable: the union of two lists of a row, cut to ``width``, is its list over both sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.operators.neighbors import _exact, _matrix, block_neighbors, distances
from panelsmith.session import cut_lineage

#: Rows from which the middle of each projection is taken; it steers how evenly signs split, nothing else.
SAMPLE = 2_000
#: A round that changes a smaller share of the list entries is the last.
SETTLED = 0.002

_LINK = pa.schema([("node", pa.int64()), ("neighbor", pa.int64()), ("distance", pa.float64())])
_LINKS = "node long, neighbor long, distance double"


def merge_lists(links: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest different neighbours per node of (node, neighbor, distance); ties to the lower node."""
    nearest = Window.partitionBy("node").orderBy("distance", "neighbor")
    once = links.groupBy("node", "neighbor").agg(F.min("distance").alias("distance"))
    return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= width)


def _projected(directions: np.ndarray, middles: np.ndarray) -> Callable:
    """Vector to (code, value) per tree: the signs of all projections but the last, and the last."""
    n_bits = directions.shape[1] - 1
    powers = 1 << np.arange(n_bits)[::-1]
    kind = pa.list_(pa.struct([("code", pa.int64()), ("value", pa.float64())]))

    @F.arrow_udf("array<struct<code:long,value:double>>")
    def project(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], kind)
        x = _matrix(vectors)
        codes, values = [], []
        for tree, middle in zip(directions, middles, strict=True):
            at = x @ tree.T - middle
            codes.append((at[:, :n_bits] > 0) @ powers)
            values.append(at[:, n_bits])
        trees = pa.StructArray.from_arrays(
            [pa.array(np.stack(codes, 1).ravel()), pa.array(np.stack(values, 1).ravel())], ["code", "value"]
        )
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(directions), pa.int32()), trees)

    return project


def _single(df: DataFrame) -> bool:
    """Whether every entry is a number of single precision; then vectors travel as such, at half the size and
    without loss: distances are worked out in double precision all the same."""
    same = F.forall("vec", lambda x: x.cast("float").cast("double") == x)
    return df.where(~same).isEmpty()


def _links(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, d), _LINK)], schema=_LINK)


def _leaf_lists(nodes: DataFrame, trees: int, leaf_rows: int, width: int, p: int, seed: int) -> DataFrame:
    """Lists from the leaves of all trees."""
    n = nodes.count()
    sample = _matrix(pa.array([r["vec"] for r in nodes.orderBy(F.xxhash64("node", F.lit(seed))).limit(SAMPLE).select("vec").collect()]))
    bits = min(62, max(1, math.ceil(math.log2(max(n / leaf_rows, 1)))) + 2)
    directions = np.random.default_rng(seed).normal(size=(trees, bits + 1, sample.shape[1]))
    middles = np.stack([np.median(sample @ tree.T, axis=0) for tree in directions])
    placed = nodes.select("*", F.posexplode(_projected(directions, middles)("vec")).alias("tree", "at"))
    order = ["tree", "at.code", "at.value", "node"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "node", "target", "vec")

    def leaf(rows: pa.Table) -> pa.RecordBatch:
        ids, x = rows.column("node").combine_chunks(), _matrix(rows.column("vec"))
        targets = np.flatnonzero(rows.column("target").to_numpy())
        if not len(targets):
            return _links([], [], [])
        a, b, d = block_neighbors(ids, x, ids.take(pa.array(targets)), x[targets], width, p, True)
        number = ids.to_numpy()
        return _links(number[a], number[targets[b]], d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held is not None:
                same = int(np.searchsorted(held.column("tree").to_numpy(), held.column("tree")[0].as_py(), "right"))
                size = min(same, leaf_rows)
                if size == held.num_rows and size < leaf_rows:
                    break  # the leaf may go on
                yield leaf(held.slice(0, size))
                held = held.slice(size) if held.num_rows > size else None
        if held is not None:
            yield leaf(held)

    return merge_lists(dealt.mapInArrow(run, _LINKS), width)


def _descent(nodes: DataFrame, lists: DataFrame, width: int, p: int) -> DataFrame:
    """Links that enter the list of a row: found among the rows that meet at a common neighbour."""
    limits = lists.groupBy("node").agg(
        F.when(F.count(F.lit(1)) >= width, F.max("distance")).otherwise(F.lit(math.inf)).alias("limit")
    )
    listed = Window.partitionBy("neighbor").orderBy("distance", "node")
    back = lists.withColumn("_r", F.row_number().over(listed)).where(F.col("_r") <= width)
    meeting = (
        lists.select(F.col("node").alias("at"), F.col("neighbor").alias("node"))
        .unionByName(back.select(F.col("neighbor").alias("at"), "node"))
        .unionByName(nodes.select(F.col("node").alias("at"), "node"))
        .distinct()
    )
    told = nodes.join(limits, "node", "left").select("node", "vec", "target", F.coalesce("limit", F.lit(math.inf)).alias("limit"))
    dealt = meeting.join(told, "node").repartition("at").sortWithinPartitions("at", "node")

    def compared(table: pa.Table) -> pa.RecordBatch:
        at, ids = table.column("at").to_numpy(), table.column("node").to_numpy()
        x, limit = _matrix(table.column("vec")), table.column("limit").to_numpy()
        target = table.column("target").to_numpy(zero_copy_only=False).astype(bool)
        out = []
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            near = distances(x[a:b], x[a:b], p)
            np.fill_diagonal(near, math.inf)
            i, j = np.nonzero((near <= limit[a:b, None] * (1 + 1e-9)) & target[a:b][None, :] & np.isfinite(near))
            out.append((ids[a + i], ids[a + j], _exact(x[a + i] - x[a + j], p)))
        return _links(*(np.concatenate(c) for c in zip(*out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            at = held.column("at").to_numpy()
            whole = int(np.searchsorted(at, at[-1], "left"))  # the last meeting may go on
            if whole:
                yield compared(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield compared(held)

    return dealt.mapInArrow(run, _LINKS)


def knn_graph(
    rows: DataFrame,
    id_col: str,
    vec_col: str,
    k: int,
    p: int = 2,
    searched: DataFrame | None = None,
    trees: int = 8,
    leaf_rows: int = 128,
    rounds: int = 6,
    width: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """About the k nearest rows for every row: (id, neighbor_id, distance, rank), distances exact.

    Without ``searched`` neighbours come from ``rows`` themselves, another row than the row itself; with it,
    from ``searched``. Some neighbours may be missed; then a farther row is in the list, which is shorter than k
    only if fewer rows are there. More ``trees``, ``rounds`` or ``width`` (list length, 4 k and 24 at least by default)
    raise the recall. ``vec_col`` is an array of numbers without NULL, of one length.
    """
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    width = width or max(4 * k, 24)

    def side(df: DataFrame, asks: bool, target: bool) -> DataFrame:
        vec = F.col(vec_col).cast("array<double>").alias("vec")
        return df.select(F.col(id_col).alias("id"), vec, F.lit(asks).alias("asks"), F.lit(target).alias("target"))

    both = side(rows, True, searched is None)
    if searched is not None:
        both = both.unionByName(side(searched, False, True))
    if _single(both):
        both = both.withColumn("vec", F.col("vec").cast("array<float>"))
    table = cut_lineage(both.withColumn("node", F.monotonically_increasing_id()))
    nodes = table.select("node", "vec", "target")
    if nodes.isEmpty():
        lists = nodes.sparkSession.createDataFrame([], _LINKS + ", rank int")
    else:
        lists = cut_lineage(_leaf_lists(nodes, trees, leaf_rows, width, p, seed))
        total = lists.count()
        for _ in range(rounds):
            found = _descent(nodes, lists, width, p)
            now = cut_lineage(merge_lists(lists.select("node", "neighbor", "distance").unionByName(found), width))
            new = now.join(lists, ["node", "neighbor"], "left_anti").count()
            lists = now
            if new <= SETTLED * total:
                break
    names = table.select("node", "id", "asks")
    asking = names.where("asks").select("node", F.col("id").alias(id_col))
    found = lists.join(asking, "node").join(
        names.select(F.col("node").alias("neighbor"), F.col("id").alias("neighbor_id")), "neighbor"
    )
    best = Window.partitionBy("node").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(id_col, "neighbor_id", "distance", "rank")
