"""Exact k-nearest-neighbour join.

No pair of rows is materialised and no side is sent everywhere:

1. Pivots (one per ``cell_rows`` rows, chosen by hash) cut the space into cells; every row of the
   searched side belongs to the cell of its nearest pivot. Neighbouring cells are put together to blocks of
   at most ``block_rows`` rows; a larger cell is cut into several.
2. In the first round a query row goes to the block of its own cell. It meets the rows of that cell, then those
   of the block's other cells that can hold something as near: by the triangle inequality from the number of
   rows of a cell and the range of their distances to the pivot. The k-th row found is a bound on the distance
   of its k-th neighbour, and mostly close to it.
3. In the second round it goes likewise to the other blocks, with that bound. It is sent once to a block,
   however many of its cells it visits, so there are at most as many copies of it as blocks; inside, it is
   compared with the cells it visits only. A window merges the rounds and blocks.

Copies of one vector beyond the k + 1 with the smallest ids can never be among anybody's k neighbours
(ties go to the smaller id), so they are left out of the searched side before it is cut into cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelsmith.session import cut_lineage

MAX_PIVOTS = 16_384
CELL_ROWS = 512
BLOCK_ROWS = 32_768
MAX_TASKS = 100_000
_TILE = 128
_PAIRS = 1 << 18
_PIECE = 1_024
#: Numbers of the query rows whose waves a task holds at a time.
WAVES_HELD = 1 << 21
#: More pivots than this are put into groups to find the nearest one.
GROUPED = 4_096
#: Parts of the query rows of a cell, so that a frequent cell is not one task's.
CELL_PARTS = 4


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """All Minkowski distances (p = 1 or 2) between the rows of two small matrices."""
    near = _ranking(a, b, p)
    return near if p == 1 else np.sqrt(np.maximum(near + (a * a).sum(1)[:, None], 0.0))


def _ranking(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Numbers that order the rows of ``b`` per row of ``a`` by distance: for p = 2 the squared
    distance less the row's own squared length."""
    if p == 2:
        return np.column_stack([a, np.ones(len(a))]) @ np.vstack([-2.0 * b.T, (b * b).sum(1)])
    near, one, columns = np.zeros((len(a), len(b))), np.empty((len(a), len(b))), np.ascontiguousarray(b.T)
    for dim in range(a.shape[1]):
        np.subtract(columns[dim], a[:, dim, None], out=one)
        near += np.abs(one, out=one)
    return near


class Waves:
    """Lower bounds of Manhattan distances by one matrix product.

    |x| >= C - sum of w cos(f x) for the constants below (a test holds them against |x|), in any unit of x; and
    cos(f (x - y)) is the product of (cos f x, sin f x) and (cos f y, sin f y). So the sum over the columns,
    each in its own unit, is a constant less the product of two rows of waves. Units are the spread of
    differences between rows of ``b``; they decide how close the bounds are, not whether they hold. On normal
    data they are 0.93 of the distance.
    """

    CONSTANT = 1.2105
    FREQUENCIES = (1.25, 3.75, 6.25)
    WEIGHTS = (1.0182, 0.1304, 0.0638)

    def __init__(self, b: np.ndarray) -> None:
        self.middle, unit = b.mean(0), b.std(0) * math.sqrt(2)
        self.usable = bool(np.isfinite(unit).all() and np.isfinite(self.middle).all())
        self.per_unit = np.divide(1.0, unit, out=np.zeros_like(unit), where=unit > 1e-150)
        self.root = np.sqrt(np.where(self.per_unit > 0, unit, 0.0))
        self.total = self.CONSTANT * float((self.root * self.root).sum())
        products = 2 * len(self.FREQUENCIES) * len(unit)
        #: Rounding of the product in single precision.
        self.slack = 2.0**-23 * (products + 16) * self.total

    def of(self, x: np.ndarray) -> np.ndarray:
        at, parts = (x - self.middle) * self.per_unit, []
        for frequency, weight in zip(self.FREQUENCIES, self.WEIGHTS, strict=True):
            high = math.sqrt(weight) * self.root
            parts += [(np.cos(frequency * at) * high).astype(np.float32), (np.sin(frequency * at) * high).astype(np.float32)]
        return np.concatenate(parts, axis=1)


def _exact(difference: np.ndarray, p: int) -> np.ndarray:
    if p == 2:
        return np.sqrt((difference * difference).sum(1))
    return np.abs(difference).sum(1)


def _exact_pairs(a: np.ndarray, rows: np.ndarray, b: np.ndarray, columns: np.ndarray, p: int) -> np.ndarray:
    """Distances of single pairs, in pieces that stay in the processor's cache."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), _PIECE):
        piece = slice(i, i + _PIECE)
        out[piece] = _exact(a[rows[piece]] - b[columns[piece]], p)
    return out


def _size(a: np.ndarray, p: int) -> float:
    """Greatest length of a row, squared for p = 2; rounding errors are proportional to it."""
    return float((a * a if p == 2 else np.abs(a)).sum(1).max())


def _margin(a: np.ndarray, b: np.ndarray, p: int) -> float:
    return 1e-11 * (_size(a, p) + _size(b, p))


def _slack(a: np.ndarray, b: np.ndarray, p: int) -> float:
    """Above the rounding error of fast distances and of their sums."""
    size = _size(a, p) + _size(b, p)
    return 1e-11 * size if p == 1 else 1e-5 * math.sqrt(size)


def _limits(near: np.ndarray, k: int) -> np.ndarray:
    """Per row a bound that at least k entries do not exceed: the k-th smallest minimum of groups of
    columns, which is close to the k-th smallest entry and much cheaper."""
    n = near.shape[1]
    if n <= k:
        return np.full(len(near), np.inf)
    group = max(1, min(16, n // (4 * k)))
    whole = n // group * group
    minima = near[:, :whole].reshape(len(near), group, -1).min(1)
    return np.partition(minima, k - 1, axis=1)[:, k - 1]


def _best(
    a: np.ndarray,
    asking: np.ndarray,
    b: np.ndarray,
    rank_b: np.ndarray,
    own: np.ndarray,
    reach: np.ndarray,
    k: int,
    p: int,
    margin: float,
    waves: Waves | None = None,
    waves_a: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of ``b`` per row ``asking`` of ``a`` within its ``reach``: (place in ``asking``, row of
    b, distance), by place, distance and ``rank_b``. ``own``: the row of ``b`` that is left out, or -1.

    Fast distances, or lower bounds, preselect with a margin above their rounding error, exact ones decide.
    """
    waves_b = waves.of(b).T if waves is not None else None
    found = []
    size = max(_TILE, min(4 * _TILE, _PAIRS // len(b)))
    for start in range(0, len(asking), size):
        part = slice(start, start + size)
        tile, own_column, limit = a[asking[part]], own[part], reach[part]
        if waves is None:
            near = _ranking(tile, b, p)
            if p == 2:
                within = limit * limit * (1 + 1e-12) - (tile * tile).sum(1)
            else:
                within = limit
        else:
            near, within = waves_a[asking[part]] @ waves_b, limit
        present = np.flatnonzero(own_column >= 0)
        near[present, own_column[present]] = np.inf if waves is None else -np.inf
        if waves is None:
            if np.isinf(limit).any():
                within = np.minimum(within, _limits(near, k))
            rows, columns = np.divmod(np.flatnonzero(near <= (within + margin)[:, None]), len(b))
        else:
            if np.isinf(limit).any() and len(b) > k:
                # the distances of the k rows with the lowest bounds, which are other rows than the own one
                nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
                tried = _exact_pairs(tile, np.repeat(np.arange(len(tile)), k), b, nearest.ravel(), p)
                within = limit = np.minimum(limit, tried.reshape(-1, k).max(1))
            least = waves.total - within - margin - waves.slack - 1e-6 * np.abs(within)
            rows, columns = np.divmod(np.flatnonzero(near >= least.astype(np.float32)[:, None]), len(b))
        keep = columns != own_column[rows]
        rows, columns = rows[keep], columns[keep]
        exact = _exact_pairs(tile, rows, b, columns, p)
        keep = exact <= limit[rows]
        rows, columns, exact = rows[keep], columns[keep], exact[keep]
        order = np.lexsort((rank_b[columns], exact, rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        found.append((rows[best] + start, columns[best], exact[best]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _ranks(ids: pa.Array) -> np.ndarray:
    rank = np.empty(len(ids), dtype=np.int64)
    rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return rank


def _own(ids_a: pa.Array, ids_b: pa.Array, exclude_self: bool) -> np.ndarray:
    if not exclude_self:
        return np.full(len(ids_a), -1)
    return pc.fill_null(pc.index_in(ids_a, value_set=ids_b), -1).to_numpy()


def _waves(a: np.ndarray, b: np.ndarray, p: int) -> Waves | None:
    """What gives lower bounds between these rows, where they exist and pay."""
    waves = Waves(b) if p == 1 and len(b) > 1 else None
    return waves if waves is not None and waves.usable and np.isfinite(a).all() else None


def block_neighbors(
    ids_a: pa.Array,
    a: np.ndarray,
    ids_b: pa.Array,
    b: np.ndarray,
    k: int,
    p: int,
    exclude_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of ``b`` per row of ``a``: (row of a, row of b, distance), ties by id."""
    waves = _waves(a, b, p)
    waves_a = waves.of(a) if waves is not None else None
    own, everywhere = _own(ids_a, ids_b, exclude_self), np.full(len(a), np.inf)
    return _best(a, np.arange(len(a)), b, _ranks(ids_b), own, everywhere, k, p, _margin(a, b, p), waves, waves_a)


@dataclass
class _Cells:
    """What every task needs to know about the cells; at most MAX_PIVOTS rows."""

    pivots: np.ndarray
    n: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    kth: np.ndarray

    def blocks(self, rows_per_block: int) -> tuple[np.ndarray, np.ndarray]:
        """First block and number of blocks per cell; small cells that are near each other share one."""
        centred = self.pivots - self.pivots.mean(axis=0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if len(centred) > 1 else np.zeros(1)
        first, several = np.zeros(len(self.n), np.int64), np.maximum(1, -(-self.n // rows_per_block))
        block, held = -1, rows_per_block + 1
        for cell in np.argsort(along, kind="stable").tolist():
            if held + self.n[cell] > rows_per_block:
                block, held = block + 1, 0
            first[cell] = block
            if several[cell] > 1:
                block, held = block + int(several[cell]) - 1, rows_per_block + 1
            held += int(self.n[cell])
        return first, several

    def reach(self, to_pivot: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """A distance within which the k nearest rows lie, from a known one and the distances to all pivots."""
        reach = np.minimum(bound, (to_pivot + self.kth[None, :]).min(1))
        if len(self.pivots) > k:
            # k + 1 pivots are rows, at most one of them the query row itself
            reach = np.minimum(reach, np.partition(to_pivot, k, axis=1)[:, k])
        return reach

    def margin(self, rows: np.ndarray, p: int) -> float:
        return _slack(rows, self.pivots, p)

    def visited(
        self, to_pivot: np.ndarray, nearest: np.ndarray, own: np.ndarray, reach: np.ndarray, some: np.ndarray
    ) -> np.ndarray:
        """Which of the cells ``some``, but not a row's ``own``, may hold a row within its ``reach`` (margin
        included). ``to_pivot``: distances to the pivots of these cells, ``nearest``: to that of the own cell."""
        reach, nearest = reach[:, None], nearest[:, None]
        return (
            (to_pivot - self.farthest[None, some] <= reach)
            & (self.nearest[None, some] - to_pivot <= reach)
            & ((to_pivot - nearest) / 2 <= reach)
            & (self.n[some] > 0)[None, :]
            & (some[None, :] != own[:, None])
        )


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(vectors) == 0 or len(flat) % len(vectors) or np.isnan(flat).any():
        raise ValueError("vectors must have one length and no missing entries")
    return flat.astype(np.float64, copy=False).reshape(len(vectors), -1)


class _Nearest:
    """The nearest pivot per row. Many pivots are put into groups by nearest centre, and a row is compared with
    the groups only that can hold a pivot nearer than one found, by the triangle inequality."""

    def __init__(self, pivots: np.ndarray, p: int) -> None:
        self.pivots, self.p = pivots, p
        n = math.isqrt(len(pivots)) if len(pivots) > GROUPED and np.isfinite(pivots).all() else 1
        self.centres = pivots[np.arange(n) * len(pivots) // n]
        group, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), math.inf)
        if n > 1:
            for t in (slice(i, i + _TILE) for i in range(0, len(pivots), _TILE)):
                to_centre = distances(pivots[t], self.centres, p)
                group[t], radius[t] = to_centre.argmin(1), to_centre.min(1)
        self.members = [np.flatnonzero(group == g) for g in range(n)]
        self.radius = np.array([radius[m].max(initial=-math.inf) for m in self.members])

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot (of equally near ones the first) and the distance to it."""
        waves, margin = _waves(rows, self.pivots, self.p), _margin(rows, self.pivots, self.p)
        waves_rows = waves.of(rows) if waves is not None else None
        cell, radius, none = np.full(len(rows), len(self.pivots)), np.full(len(rows), math.inf), np.full(len(rows), -1)

        def meet(asking: np.ndarray, members: np.ndarray) -> None:
            if not (len(asking) and len(members)):
                return
            reach, rank = radius[asking], np.arange(len(members))
            found, column, distance = _best(
                rows, asking, self.pivots[members], rank, none[asking], reach, 1, self.p, margin, waves, waves_rows
            )
            row, pivot = asking[found], members[column]
            better = (distance < radius[row]) | ((distance == radius[row]) & (pivot < cell[row]))
            cell[row[better]], radius[row[better]] = pivot[better], distance[better]

        if len(self.members) == 1 or not np.isfinite(rows).all():
            meet(np.arange(len(rows)), np.arange(len(self.pivots)))
            return cell, radius
        to_centre = distances(rows, self.centres, self.p)
        first, slack = to_centre.argmin(1), _slack(rows, self.pivots, self.p)
        for g, members in enumerate(self.members):
            meet(np.flatnonzero(first == g), members)
        for g, members in enumerate(self.members):
            meet(np.flatnonzero((first != g) & (to_centre[:, g] - self.radius[g] <= radius + slack)), members)
        return cell, radius


def _nearest_cell(pivots: np.ndarray, p: int) -> Callable:
    """Vector to (cell, distance to its pivot)."""
    nearest = _Nearest(pivots, p)

    @F.arrow_udf("cell long, radius double")
    def assign(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.struct([("cell", pa.int64()), ("radius", pa.float64())]))
        cells, radii = nearest(_matrix(vectors))
        return pa.StructArray.from_arrays([pa.array(cells), pa.array(radii)], ["cell", "radius"])

    return assign


def _visited_blocks(cells: _Cells, first: np.ndarray, several: np.ndarray, k: int, p: int) -> Callable:
    """Vector, own cell and bound to the other blocks with cells that may hold one of the k nearest rows."""
    n_blocks = int((first + several).max())
    parts = int(several.max())

    @F.arrow_udf("array<long>")
    def visit(vectors: pa.Array, own: pa.Array, bound: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int64()))
        matrix, own, bound = _matrix(vectors), own.to_numpy(), bound.to_numpy()
        margin = cells.margin(matrix, p)
        visited = [np.empty(0, np.int64)] * len(matrix)
        order = np.argsort(own, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            # what rows of one cell can visit is near its pivot; the rest is not compared with each of them
            pivot = cells.pivots[own[same[:1]]]
            to_own, from_own = _exact(matrix[same] - pivot, p), distances(pivot, cells.pivots, p)[0]
            some = np.flatnonzero((cells.n > 0) & (from_own - cells.farthest <= (to_own + bound[same]).max() + 2 * margin))
            for start in range(0, len(same), _TILE):
                rows = same[start : start + _TILE]
                reach, wide = bound[rows] + margin, np.flatnonzero(np.isinf(bound[rows]))
                if len(wide):  # fewer than k rows in the own block
                    reach[wide] = cells.reach(distances(matrix[rows[wide]], cells.pivots, p), reach[wide], k) + margin
                near = distances(matrix[rows], cells.pivots[some], p)
                possible = cells.visited(near, to_own[start : start + _TILE], own[rows], reach, some)
                blocks = np.zeros((len(rows), n_blocks), bool)
                row, cell = np.nonzero(possible)
                for part in range(parts):
                    more = several[some[cell]] > part
                    blocks[row[more], first[some[cell[more]]] + part] = True
                blocks[:, first[own[rows]]] = False  # met in the first round; a cell of several has them to itself
                for i in np.flatnonzero(blocks.any(1)).tolist():
                    visited[rows[i]] = np.flatnonzero(blocks[i])
        counts, columns = [[len(v) for v in visited]], visited
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(columns)))

    return visit


def _block_udf(
    cells: _Cells, k: int, p: int, exclude_self: bool, own_round: bool, output: dict[str, tuple[str, str]], schema: pa.Schema
) -> Callable:
    """``output`` names each result column's side (query, searched or distance) and column there.

    In the first round (``own_round``) query rows are in the block of their own cell, which they meet first.
    """

    def best(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        """A row's k nearest so far are kept, and a cell is only asked for nearer ones."""
        a, b = _matrix(left.column("vec")), _matrix(right.column("vec"))
        ids_a, ids_b = (side.column("id").combine_chunks() for side in (left, right))
        home, cell_of = left.column("cell").to_numpy(), right.column("cell").to_numpy()
        order = np.argsort(cell_of, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(cell_of[order]) != 0, True])
        some = cell_of[order[edges[:-1]]]
        rank, own = _ranks(ids_b), _own(ids_a, ids_b, exclude_self)
        rank_or_none = np.append(rank, len(rank))
        place_of = np.empty(len(order) + 1, np.int64)
        place_of[order], place_of[-1] = np.arange(len(order)), -1
        waves, margin = _waves(a, b, p), _margin(a, b, p)
        found = []
        size = max(_TILE, WAVES_HELD // a.shape[1])
        for slab in (slice(i, i + size) for i in range(0, len(a), size)):
            x = a[slab]
            own_place = place_of[own[slab]]
            near, at = np.full((len(x), k), math.inf), np.full((len(x), k), -1)
            reach, radius = np.full(len(x), math.inf), left.column("radius").to_numpy()[slab]
            waves_x = waves.of(x) if waves is not None else None

            def meet(visits: np.ndarray) -> None:
                for i, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    asking, held = np.flatnonzero(visits[:, i]), order[low:high]
                    if not len(asking):
                        continue
                    mine = own_place[asking]
                    rows, columns, distance = _best(
                        x,
                        asking,
                        b[held],
                        rank[held],
                        np.where((mine >= low) & (mine < high), mine - low, -1),
                        reach[asking],
                        k,
                        p,
                        margin,
                        waves,
                        waves_x,
                    )
                    if not len(rows):
                        continue
                    first = np.flatnonzero(np.r_[True, np.diff(rows) != 0])
                    which = np.cumsum(np.r_[True, np.diff(rows) != 0]) - 1
                    changed = asking[rows[first]]
                    more, more_at = np.full((len(first), k), math.inf), np.full((len(first), k), -1)
                    more[which, np.arange(len(rows)) - first[which]] = distance
                    more_at[which, np.arange(len(rows)) - first[which]] = held[columns]
                    more, more_at = np.hstack([near[changed], more]), np.hstack([at[changed], more_at])
                    nearest = np.lexsort((rank_or_none[more_at], more), axis=-1)[:, :k]
                    near[changed] = np.take_along_axis(more, nearest, 1)
                    at[changed] = np.take_along_axis(more_at, nearest, 1)
                    reach[changed] = np.minimum(reach[changed], near[changed, -1])

            if own_round:
                meet(home[slab, None] == some[None, :])
            else:
                reach = left.column("bound").to_numpy()[slab].copy()
            wide = np.flatnonzero(np.isinf(reach))  # fewer than k rows so far
            for t in (wide[i : i + _TILE] for i in range(0, len(wide), _TILE)):
                reach[t] = cells.reach(distances(x[t], cells.pivots, p), reach[t], k) + cells.margin(x[t], p)
            far = reach + cells.margin(x, p)
            meet(
                np.concatenate(
                    [
                        cells.visited(distances(x[t], cells.pivots[some], p), radius[t], home[slab][t], far[t], some)
                        for t in (slice(i, i + _TILE) for i in range(0, len(x), _TILE))
                    ]
                )
            )
            rows, position = np.nonzero(at >= 0)
            found.append((rows + slab.start, at[rows, position], near[rows, position]))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        rows, columns, distance = best(left, right)
        sides = {"query": (left, rows), "searched": (right, columns)}
        made = []
        for side, column in output.values():
            if side == "distance":
                made.append(pa.array(distance))
            else:
                frame, at = sides[side]
                made.append(frame.column(column).combine_chunks().take(pa.array(at)))
        return pa.Table.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(made)], schema=schema)

    return block


def _first_copies(b: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids of each distinct vector; the rank limit applies before the shuffle."""
    copies = Window.partitionBy("vec").orderBy("id")
    return b.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= n).drop("_copy")


def _choose_pivots(b: DataFrame, n: int, n_rows: int) -> np.ndarray:
    """Up to ``n`` distinct vectors in hash order. A hash threshold comes first, so that no task and not the
    driver handle more than a few times as many. Fewer pivots than wanted only mean larger cells."""
    share = min(1.0, (2 * n + 100) / n_rows)
    order = F.xxhash64("id", F.lit(42))
    drawn = b.where(F.pmod(order, F.lit(2**31)) < F.lit(int(share * 2**31)))
    rows = drawn.orderBy(order, "id").limit(n).select("vec").collect()
    if not rows:
        rows = b.select("vec").limit(1).collect()
    return np.unique(np.array([row["vec"] for row in rows], dtype=np.float64), axis=0)


def _describe_cells(assigned: DataFrame, pivots: np.ndarray, k: int) -> _Cells:
    """Row count and pivot-distance range per cell, and the distance of its (k+1)-th nearest row.

    One row per pivot reaches the driver.
    """
    n_cells = len(pivots)
    by_distance = Window.partitionBy("cell").orderBy("radius", "id")
    kth = (
        assigned.withColumn("_r", F.row_number().over(by_distance))
        .where(F.col("_r") <= k + 1)
        .groupBy("cell")
        .agg(F.max("radius").alias("kth"), F.count(F.lit(1)).alias("n_kth"))
    )
    totals = assigned.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")
    )
    cells = _Cells(
        pivots,
        np.zeros(n_cells, dtype=np.int64),
        np.zeros(n_cells),
        np.zeros(n_cells),
        np.full(n_cells, np.inf),
    )
    for row in totals.join(kth, "cell").collect():
        i = row["cell"]
        cells.n[i], cells.nearest[i], cells.farthest[i] = row["n"], row["low"], row["high"]
        if row["n_kth"] > k:
            cells.kth[i] = row["kth"]
    return cells


def knn_join(
    queries: DataFrame,
    searched: DataFrame,
    id_col: str,
    vec_col: str,
    k: int,
    p: int = 2,
    exclude_self: bool = False,
    carry_query: list[str] | None = None,
    carry_neighbor: list[str] | None = None,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """The k nearest rows of ``searched`` for every row of ``queries``, exactly.

    Returns (id, neighbor_id, distance, rank) and, on request, columns of the query row and (prefixed
    ``neighbor_``) of the neighbour, which saves joining them back. rank starts at 1, ties go to the
    smaller neighbour id. ``vec_col`` is an array of numbers without NULL; ids are unique.
    ``exclude_self`` skips the row of the same id.

    Both inputs are read a few times: pass tables, not long lineages.
    """
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    carry_query, carry_neighbor = carry_query or [], carry_neighbor or []
    spark = queries.sparkSession
    vec = F.col(vec_col).cast("array<double>").alias("vec")
    parallelism = spark.sparkContext.defaultParallelism
    a = queries.select(F.col(id_col).alias("id"), vec, *_numbered(carry_query))
    b = searched.select(F.col(id_col).alias("id"), vec, *_numbered(carry_neighbor))
    output = {
        id_col: ("query", "id"),
        "neighbor_id": ("searched", "id"),
        "distance": ("distance", ""),
        **{name: ("query", f"c{i}") for i, name in enumerate(carry_query)},
        **{f"neighbor_{name}": ("searched", f"c{i}") for i, name in enumerate(carry_neighbor)},
    }
    types = {"query": a.schema, "searched": b.schema}
    schema = T.StructType(
        [
            T.StructField(name, T.DoubleType() if side == "distance" else types[side][c].dataType)
            for name, (side, c) in output.items()
        ]
    )
    best = Window.partitionBy(id_col).orderBy("distance", "neighbor_id")
    n_a, n_b = a.count(), b.count()
    if not n_b:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))

    pivots = _choose_pivots(b, min(max_pivots, math.ceil(n_b / cell_rows)), n_b)
    # whatever the files of the tables, all cores share the work on their rows
    placed = _first_copies(b.repartition(parallelism, "id"), k + 1).repartition(parallelism, "id").withColumn("_place", _nearest_cell(pivots, p)("vec"))
    assigned = cut_lineage(placed.select(*b.columns, "_place.cell", "_place.radius"))
    cells = _describe_cells(assigned, pivots, k)
    first, several = cells.blocks(block_rows)
    query_rows = min(32_768, max(256, math.ceil(n_a / (2 * parallelism))))
    layout = spark.createDataFrame(
        [(i, int(f), int(n)) for i, (f, n) in enumerate(zip(first, several, strict=True))],
        "cell long, first_block long, n_blocks long",
    )  # one row per pivot
    block_of = F.col("first_block") + F.pmod(F.xxhash64("id"), F.col("n_blocks"))
    members = assigned.drop("radius").join(F.broadcast(layout), "cell").withColumn("block", block_of)

    def met(visits: DataFrame, own_round: bool) -> DataFrame:
        """Candidates of query rows (``visits``: with their ``block``) among the rows of these blocks."""
        counts = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("n_parts"))
        parts = cut_lineage(counts)  # one row per block
        n_parts = parts.agg(F.sum("n_parts")).first()[0] or 1
        tasks = max(2 * parallelism, min(n_parts, MAX_TASKS))
        left = visits.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")))
        right = members.join(F.broadcast(parts), "block").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1))
        )
        more = ["cell", "radius"] if own_round else ["cell", "radius", "bound"]
        return (
            left.select("block", "part", *more, *a.columns)
            .repartition(tasks, "block", "part")
            .groupBy("block", "part")
            .cogroup(right.select("block", "part", "cell", *b.columns).repartition(tasks, "block", "part").groupBy("block", "part"))
            .applyInArrow(_block_udf(cells, k, p, exclude_self, own_round, output, to_arrow_schema(schema)), schema)
        )

    homes = cut_lineage(a.repartition(parallelism, "id").withColumn("_place", _nearest_cell(pivots, p)("vec")).select(*a.columns, "_place.cell", "_place.radius"))
    every_part = F.explode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("n_blocks") - 1))
    own = met(homes.join(F.broadcast(layout), "cell").withColumn("block", every_part), True)
    own = cut_lineage(own.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r"))
    bounds = own.groupBy(F.col(id_col).alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound")
    )
    bounded = homes.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
    bounded = bounded.repartition(2 * parallelism, "cell", F.pmod(F.xxhash64("id"), F.lit(CELL_PARTS))).sortWithinPartitions("cell")
    blocks = _visited_blocks(cells, first, several, k, p)("vec", "cell", "bound")
    others = met(cut_lineage(bounded.withColumn("blocks", blocks)).withColumn("block", F.explode("blocks")), False)
    return own.unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _numbered(columns: list[str]) -> list[Column]:
    return [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]

