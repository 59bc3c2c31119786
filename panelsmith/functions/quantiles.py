"""Exact order statistics and interpolated quantiles of many columns by radix selection.

A double is read as a 64-bit key that sorts as the number does: its bits, with the sign bit turned for positive
numbers and all bits for negative ones. Passes over the table count the values by one digit of the key, the
highest first, inside the prefix that earlier passes have found; the digit in which a rank falls extends its
prefix. After all digits the key, and so the number, is known exactly. There is no sketch, no bracket that
depends on the data, and no sort: counts of tasks add up, a pass works for all columns and ranks at once, and
from the second one only values with a wanted prefix reach the counting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.session import cut_lineage

#: Bits per pass: sign and exponent, then the mantissa. A task sends 8,192 counts per prefix at most.
_DIGITS = (12, 13, 13, 13, 13)
#: Columns per run of the passes; with all their prefixes a task holds that many arrays of counts.
_TOGETHER = 64

_SIGN = np.uint64(1 << 63)


def sort_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the doubles; -0.0 counts as 0.0, and every NaN as the greatest."""
    values = values + 0.0
    values[np.isnan(values)] = np.nan
    bits = values.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


@dataclass(frozen=True)
class _Prefix:
    """Values of a column whose keys begin with the digits found so far."""

    column: int
    prefix: int
    left: int  # bits of the key that are not known yet

    def holds(self, c: Column) -> Column:
        low, high = _value(self.prefix << self.left), _value(((self.prefix + 1) << self.left) - 1)
        # the lowest keys are those of negative NaNs, which no value has
        negative = not self.prefix >> (63 - self.left)
        return c.between(F.lit(-math.inf if math.isnan(low) and negative else low), F.lit(high))


def _counted(df: DataFrame, columns: list[str], prefixes: list[_Prefix], bits: int) -> DataFrame:
    """Values by ``prefix`` (its number) and next ``digit`` of ``bits`` bits: one row per task, prefix and digit."""
    left = prefixes[0].left
    wanted = []
    for i, c in enumerate(F.col(f"`{c}`") for c in columns):
        own = [p for p in prefixes if p.column == i]
        if left < 64 and own:
            c = F.when(reduce(Column.__or__, [p.holds(c) for p in own]), c)
        wanted.append((c if own else F.lit(None).cast("double")).alias(f"c{i}"))
    rows = df.select(*wanted).where(F.coalesce(*[F.col(f"c{i}") for i in range(len(columns))]).isNotNull())
    schema = pa.schema([("prefix", pa.int32()), ("digit", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(prefixes), 1 << bits), np.int64)
        for batch in batches:
            keys = {}
            for j, p in enumerate(prefixes):
                if p.column not in keys:
                    keys[p.column] = sort_keys(batch.column(p.column).drop_null().to_numpy(zero_copy_only=False))
                own = keys[p.column]
                if left < 64:
                    own = own[own >> np.uint64(left) == np.uint64(p.prefix)]
                digits = (own >> np.uint64(left - bits) & np.uint64((1 << bits) - 1)).astype(np.int64)
                counts[j] += np.bincount(digits, minlength=1 << bits)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*at, counts[at]), schema)], schema=schema)

    return rows.mapInArrow(run, "prefix int, digit int, n long")


def _select(df: DataFrame, columns: list[str], ranks: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """For columns of doubles (by number) and 0-based ranks of their non-null values, the value of that rank."""
    spark = df.sparkSession
    # per wanted rank: its prefix, and its rank among the values of that prefix
    state = {(i, r): (_Prefix(i, 0, 64), r) for i, some in ranks.items() for r in some}
    for bits in _DIGITS:
        prefixes = sorted({p for p, _ in state.values()}, key=lambda p: (p.column, p.prefix))
        number = {p: j for j, p in enumerate(prefixes)}
        by_digit = _counted(df, columns, prefixes, bits).groupBy("prefix", "digit").agg(F.sum("n").alias("n"))
        before = Window.partitionBy("prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        running = by_digit.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))  # 8,192 rows a prefix at most
        asked = spark.createDataFrame(
            sorted({(number[p], r) for p, r in state.values()}), "prefix int, rank long"
        )
        found = {
            (row["prefix"], row["rank"]): row
            for row in running.join(F.broadcast(asked), "prefix").where("rank >= below and rank < below + n").collect()
        }
        for key, (p, r) in state.items():
            row = found[number[p], r]
            state[key] = _Prefix(p.column, p.prefix << bits | row["digit"], p.left - bits), r - row["below"]
    return {key: _value(p.prefix) for key, (p, _) in state.items()}


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as a written table, which the passes read: whatever ``df`` computes is computed once."""
    return cut_lineage(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]))


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, list[float]]:
    """Values of 0-based ``ranks`` among a column's non-null values, in ascending order; ranks must exist."""
    return _statistics(_doubles(df, list(ranks)), ranks)


def _statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, list[float]]:
    names, out = list(ranks), {}
    for a in range(0, len(names), _TOGETHER):
        some = names[a : a + _TOGETHER]
        values = _select(df, some, {i: set(ranks[c]) for i, c in enumerate(some) if ranks[c]})
        out |= {c: [values[i, r] for r in ranks[c]] for i, c in enumerate(some)}
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the non-null values; None for a column without values."""
    df = _doubles(df, columns)
    sizes = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
    places = {c: [p * (sizes[f"n{i}"] - 1) for p in probabilities] for i, c in enumerate(columns) if sizes[f"n{i}"]}
    ranks = {c: sorted({f(x) for x in at for f in (math.floor, math.ceil)}) for c, at in places.items()}
    values = {c: dict(zip(ranks[c], v)) for c, v in _statistics(df, ranks).items()} if ranks else {}
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for c, at in places.items():
        for k, x in enumerate(at):
            low, high = values[c][math.floor(x)], values[c][math.ceil(x)]
            result[c][k] = low if low == high else low + (high - low) * (x - math.floor(x))
    return result
