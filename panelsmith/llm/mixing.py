"""Mixing sources to target weights by subset-sum budget fitting.

Sources share the words of all documents by weight; no source is to be used more than ``LIMIT`` times, and
what is beyond goes to the others. A source takes each of its documents as often as its whole words fit its
target, and a subset of them once more for the words that are left:

* documents are counted by exact length, a table of source and length;
* of each length the share of the budget is taken, rounded down, then one more where most was cut off, until a
  window of words is left;
* a bounded-knapsack dynamic programme over the remaining documents by length meets these words exactly, or
  as nearly as any subset of them does;
* how many documents of a length are taken is known then; which ones is decided by the order of a seeded hash.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.spread import spread_join
from panelsmith.llm.common import key_of
from panelsmith.llm.places import with_places
from panelsmith.session import cut_lineage

WEIGHTS = (1, 2, 3)
LIMIT = 3
SEED = 13
#: Words of a budget that are left to the dynamic programme, besides less than one document.
WINDOW = 1 << 16

_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Words of a text; none of NULL."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(_WORD)), F.lit(0)).cast("long")


def closest_subset(lengths: list[int], counts: list[int], target: float) -> list[int]:
    """How many of each length to take so that their sum is as near to ``target`` as possible (ties: the lower).

    A sum is reached the first time by one item, a power-of-two bundle of a length; the items on the way back
    from it descend, so none is used twice. Sums above twice the target are farther from it than none.
    """
    room = 2 * int(np.ceil(target)) + 1
    reached, came = np.zeros(room + 1, bool), np.full(room + 1, -1, np.int32)
    reached[0] = True
    items: list[tuple[int, int]] = []
    wanted = int(np.ceil(target - 0.5))
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, bundle = min(counts[k], room // lengths[k]), 1
        while left and not reached[wanted]:
            n = min(bundle, left)
            left, bundle = left - n, 2 * bundle
            size = n * lengths[k]
            new = np.flatnonzero(reached[: room + 1 - size] & ~reached[size:]) + size
            reached[new], came[new] = True, len(items)
            items.append((k, n))
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - target))])
    taken = [0] * len(lengths)
    while at:
        k, n = items[came[at]]
        taken[k] += n
        at -= n * lengths[k]
    return taken


def fit(lengths: list[int], counts: list[int], budget: float, window: int = WINDOW) -> list[int]:
    """How many documents of each length meet ``budget`` words, at most all of them."""
    total = sum(n * m for n, m in zip(lengths, counts))
    whole = min(int(budget), total)
    taken = [m * whole // total if total else 0 for m in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken))
    for k in sorted(range(len(lengths)), key=lambda i: (-(counts[i] * whole % total), lengths[i])):
        if taken[k] < counts[k] and lengths[k] <= left - window:
            taken[k] += 1
            left -= lengths[k]
    more = closest_subset(lengths, [m - t for m, t in zip(counts, taken)], max(left, 0.0))
    return [t + m for t, m in zip(taken, more)]


def _fitted(frame: pd.DataFrame) -> pd.DataFrame:
    """One source: of its documents of each length, how often all are taken, and how many once more."""
    frame = frame.sort_values("size", ignore_index=True)
    source_size, target = int(frame["source_size"].iat[0]), float(frame["target"].iat[0])
    rounds = min(int(target // source_size), LIMIT)
    lengths, counts = frame["size"].tolist(), frame["n"].tolist()
    budget = 0.0 if rounds == LIMIT else target - rounds * source_size
    out = frame[["key", "n", "source_size", "target"]].copy()
    out["rounds"], out["more"] = rounds, np.array(fit(lengths, counts, budget), np.int64)
    return out


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (``source_key``, ``source_size``) with ``target``, the words each source is to give.

    Sources weigh ``WEIGHTS`` in turn, by key. A target stops at ``LIMIT`` times the source's size, and the
    others share what is left by weight until none is above; comparisons are of whole numbers.
    """
    ranked = with_places(sizes.withColumn("_all", F.lit(0)), ["_all"], ["source_key"])
    cycle = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    weighed = cut_lineage(ranked.withColumn("weight", F.get(cycle, (F.col("place") % len(WEIGHTS)).cast("int"))))
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, total = total or 0, total or 0

    def above(rest: int, weight: int) -> Column:
        exact = [F.lit(Decimal(x)).cast("decimal(20,0)") for x in (LIMIT * weight, rest)]
        return F.col("source_size").cast("decimal(18,0)") * exact[0] < F.col("weight").cast("decimal(18,0)") * exact[1]

    while total:
        over = above(rest, weight)
        now = weighed.agg(F.sum(F.when(over, LIMIT * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        found = total - (now[0] or 0), now[1]
        if found == (rest, weight):
            break
        rest, weight = found
    if not total:
        return weighed.select("source_key", "source_size", F.lit(0.0).alias("target"))
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(weight))
    most = (LIMIT * F.col("source_size")).cast("double")
    return weighed.select("source_key", "source_size", F.when(above(rest, weight), most).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` is the number of words, ``copies`` (0 to 3) how often the mix takes the document, ``taken`` the
    words it gives so. A source's taken words are within half a word of its target where any subset of the
    last documents can meet it, else as near as they come. NULL is a source of its own, after all others;
    a NULL or empty text has no words and none are taken; repeated rows are documents of their own; an
    empty table gives no rows. Reruns agree for any partitioning; other columns are ignored.
    """
    name = F.col(f"`{source}`").cast("string")
    own = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        name.alias("source"),
        F.coalesce(F.concat(F.lit("="), name), F.lit(">")).alias("source_key"),
        n_words(text).alias("size"),
        F.xxhash64(key_of(id_column), F.lit(seed)).alias("_order"),
    )
    rows = cut_lineage(own.withColumn("key", F.concat(F.col("size").cast("string"), "source_key")))
    counts = cut_lineage(rows.groupBy("key", "source_key", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = cut_lineage(counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    goals = cut_lineage(targets(sizes))
    plain = "key string, n long, source_size long, target double, rounds int, more long"
    wanted = counts.join(goals, "source_key")
    plan = wanted.where("size > 0").groupBy("source_key").applyInPandas(_fitted, plain)
    none = wanted.where("size = 0").select("key", "n", "source_size", "target", F.lit(0).alias("rounds"), F.lit(0).cast("long").alias("more"))
    placed = with_places(rows, ["key"], ["_order", F.col("doc_id")]).drop("total")
    copies = F.when(F.col("size") > 0, F.col("rounds") + (F.col("place") < F.col("more")).cast("int")).otherwise(0)
    chosen = spread_join(placed, cut_lineage(plan.unionByName(none)), "key", "n").withColumn("copies", copies)
    return chosen.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The columns of ``mix`` that a report needs; see there."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
