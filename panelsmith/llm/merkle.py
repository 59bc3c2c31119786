"""Merkle dataset manifest: a hash tree over the rows of a table, and for every row a proof that it is in.

Rows are leaves, a tree per branch (language), its leaves in the order of their ids; every ``FAN``
consecutive nodes become one node above until one, the subroot, is left. The subroots in the order of their
branches are the leaves of a last tree, whose only node is the root.

The tree is cut into superblocks of ``FAN ** ROUNDS`` consecutive nodes. Going up, each superblock is reduced
in one group to the one node that the rest of the tree needs of it; those nodes form superblocks again, so
a tree of any size takes a few passes over tables that shrink by ``FAN ** ROUNDS``. Going down, the nodes of
a superblock are cogrouped with the one row of outer nodes it needs (the siblings above it up to the root):
the group repeats its own reduction, joins inner and outer siblings to the proofs of its nodes, and hands
them to the superblocks below; at the leaves it also folds what a holder presents into a root.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.places import with_places
from panelsmith.session import cut_lineage

FAN = 8
#: Levels of a superblock; it has FAN ** ROUNDS nodes at most.
ROUNDS = 3
SUPER = FAN**ROUNDS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, place long, total long, node binary"
_OUTER = "tree string, block long, siblings string, lefts array<int>, others array<int>, subroot string, root string"


def digest_of(values: list[Column]) -> Column:
    """SHA-256 (binary) of values one after the other, each ``-`` if NULL, else byte count, ``:``, value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(leaf: str, siblings: str, lefts: list[int], others: list[int]) -> str:
    """The root that follows from a leaf and its proof: per level ``others`` siblings, ``lefts`` of them before it."""
    at = 0
    for left, n in zip(lefts, others):
        cut, end = at + 64 * left, at + 64 * n
        leaf, at = _hash(siblings[at:cut] + leaf + siblings[cut:end]), end
    return leaf


def _levels(nodes: list[str], total: int) -> list[list[str]]:
    """A superblock's nodes and the lists above them, of a tree with ``total`` nodes in this pass."""
    levels = [nodes]
    while len(levels[-1]) > 1 if total <= SUPER else len(levels) <= ROUNDS:
        row = levels[-1]
        levels.append([_hash("".join(row[i : i + FAN])) for i in range(0, len(row), FAN)])
    return levels


def _nodes(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]]]:
    frame = frame.sort_values("place", ignore_index=True)
    return frame, _levels([bytes(x).hex() for x in frame["node"]], int(frame["total"].iat[0]))


def _reduced(frame: pd.DataFrame) -> pd.DataFrame:
    tree, place, total = frame["tree"].iat[0], int(frame["place"].min()), int(frame["total"].iat[0])
    top = bytes.fromhex(_nodes(frame)[1][-1][0])
    return pd.DataFrame([(tree, place // SUPER, -(-total // SUPER), top)], columns=["tree", "place", "total", "node"])


def _proofs(levels: list[list[str]], outer: tuple[str, list[int], list[int]]) -> list[tuple[str, list[int], list[int]]]:
    """For each node of the lowest level its siblings up to the root: their text, and the shape by level."""
    above = [outer]
    for row in reversed(levels[:-1]):
        here = []
        for i in range(len(row)):
            a = i - i % FAN
            run = row[a : a + FAN]
            siblings, lefts, others = above[i // FAN]
            here.append(("".join(run[: i - a] + run[i - a + 1 :]) + siblings, [i - a, *lefts], [len(run) - 1, *others]))
        above = here
    return above


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {SUPER}"))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tables above, to the one with a single node per tree."""
    tables = [nodes]
    while len(tables) == 1 or (tables[-1].agg(F.max("total")).first()[0] or 0) > 1:
        below = _blocks(tables[-1].select("tree", "place", "total", "node"))
        tables.append(cut_lineage(below.groupBy("tree", "block").applyInPandas(_reduced, _NODE)))
    return tables


def _inner(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Outer nodes of the superblocks that the nodes of this one stand for."""
    if not len(own):
        return pd.DataFrame(columns=["tree", "block", "siblings", "lefts", "others", "subroot", "root"])
    own, levels = _nodes(own)
    above = outer.iloc[0]
    proofs = _proofs(levels, (above["siblings"], list(above["lefts"]), list(above["others"])))
    siblings, lefts, others = zip(*proofs)
    return pd.DataFrame(
        {
            "tree": own["tree"],
            "block": own["place"],
            "siblings": siblings,
            "lefts": lefts,
            "others": others,
            "subroot": above["subroot"],
            "root": above["root"],
        }
    )


def _outer_nodes(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """Outer nodes (``_OUTER``) of the superblocks of ``tables[0]``; ``top``: those of the single node above."""
    outer = top
    for nodes in reversed(tables[1:-1]):
        blocks = _blocks(nodes).groupBy("tree", "block")
        outer = cut_lineage(blocks.cogroup(outer.groupBy("tree", "block")).applyInPandas(_inner, _OUTER))
    return outer


def _finished(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of a superblock, and the roots that follow from what is presented."""
    own, levels = _nodes(own)
    above = outer.iloc[0]
    proofs = _proofs(levels, (above["siblings"], list(above["lefts"]), list(above["others"])))
    shown = [leaf if p is None else bytes(p).hex() for leaf, p in zip(levels[0], own["presented"])]
    siblings, lefts, others = zip(*proofs)
    return pd.DataFrame(
        {
            "id": own["id"],
            "leaf": levels[0],
            "subroot": above["subroot"],
            "root": above["root"],
            "siblings": siblings,
            "lefts": lefts,
            "others": others,
            "folded_root": [fold(leaf, *proof) for leaf, proof in zip(shown, proofs)],
        }
    )


def leaves(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    id_column: str = "doc_id",
    branch: str = "lang",
    presented: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """A leaf per row: ``id``, ``tree``, ``node`` and, ``where`` it holds, the ``presented`` leaf of a changed row.

    ``columns`` enter the digest in this order; ``presented`` names columns and what a holder shows instead.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    tree = F.col(f"`{branch}`").cast("string")
    picked = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.concat(F.lit("="), tree), F.lit("-")).alias("tree"),
        digest_of(list(own.values())).alias("node"),
        (F.when(where, digest_of(list((own | presented).values()))) if presented else F.lit(None).cast("binary")).alias("presented"),
    )
    return cut_lineage(picked)


def manifest(rows: DataFrame) -> DataFrame:
    """The tree over ``leaves``: per row ``id``, ``leaf``, ``subroot``, ``root``, its proof and ``folded_root``.

    The proof is ``siblings`` (hex digests back to back, level by level from the leaf through the subroot to
    the root, left to right) with ``lefts`` and ``others`` (per level, how many siblings stand before the
    node, and how many there are); ``fold`` applies it. Digests are lowercase hex.

    A NULL branch is a tree of its own, before all others. Inside a tree leaves ascend by id, NULL ids first,
    equal ids by their leaves; rows that are equal in all columns are leaves of their own. NULL, empty and
    long texts are hashed whole. A table of one row has its leaf as the root and an empty proof; an empty
    table gives no rows.
    """
    placed = cut_lineage(with_places(rows, ["tree"], [F.col("id").asc_nulls_first(), F.col("node")]))
    tables = _climb(placed)
    subroots = cut_lineage(
        with_places(tables[-1].select(F.lit("").alias("all"), F.col("tree").alias("branch"), "node"), ["all"], ["branch"])
    )
    forest = _climb(subroots.select(F.col("all").alias("tree"), "branch", "place", "total", "node"))
    no_list = F.array().cast("array<int>")
    nothing = [F.lit("").alias("siblings"), no_list.alias("lefts"), no_list.alias("others")]
    root = F.lower(F.hex("node"))
    top = forest[-1].select("tree", F.col("place").alias("block"), *nothing, root.alias("subroot"), root.alias("root"))
    branches = _outer_nodes([forest[0], *forest], top)  # the places of the subroots are the blocks of this table
    tops = branches.join(subroots.select("branch", F.col("place").alias("block"), "node"), "block").select(
        F.col("branch").alias("tree"), F.lit(0).cast("long").alias("block"), "siblings", "lefts", "others", root.alias("subroot"), "root"
    )
    outer = _outer_nodes(tables, cut_lineage(tops))
    kind = rows.schema["id"].dataType.simpleString()
    shape = (
        f"id {kind}, leaf string, subroot string, root string, siblings string, lefts array<int>, others array<int>, folded_root string"
    )
    own = _blocks(placed).groupBy("tree", "block")
    return own.cogroup(outer.groupBy("tree", "block")).applyInPandas(_finished, shape)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` where every third row, by its id's checksum, is presented with a changed text.

    Returns ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings), ``folded_root``,
    ``verified`` (whether it equals the root). Changed means A-Z in lower case; a text without them, or NULL,
    stays and is verified, and a NULL id is never changed. Ties, empty tables and so on: see ``manifest``.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = leaves(docs, presented={"text": lower}, where=chosen)
    return manifest(rows).select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def sql() -> str:
    """The same for DuckDB, over a table of any size that fits it."""
    step = "SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END AS c FROM ({})"
    table = "SELECT range AS i, range AS c FROM range(256)"
    for _ in range(8):
        table = step.format(table)
    parts = {c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS}
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = parts | {"text": f"coalesce(strlen({lower}) || ':' || {lower}, '-')"}
    crc = (
        "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)),"
        " lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)))"
    )

    def climb(name: str, start: str) -> str:
        return f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, lvl + 1, p // {FAN}, sha256(string_agg(h, '' ORDER BY p)), (n + {FAN - 1}) // {FAN}
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, p // {FAN}, n
), {name}_runs AS (
  SELECT tree, lvl, p // {FAN} AS run, list(h ORDER BY p) AS hs FROM {name} WHERE n > 1 GROUP BY tree, lvl, p // {FAN}
)"""

    def walk(name: str, forest: str, start: str) -> str:
        left = f"array_to_string(hs[1:(w.p % {FAN})::INT], '')"
        right = f"array_to_string(hs[(w.p % {FAN})::INT + 2:], '')"
        return f"""{name} AS (
  {start}
  UNION ALL
  SELECT w.rid, w.tree, w.lvl + 1, w.p // {FAN}, sha256({left} || w.h || {right}), w.proof || {left} || {right}
  FROM {name} w JOIN {forest}_runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.p // {FAN}
), {name}_end AS (
  SELECT rid, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM {name} GROUP BY rid
)"""

    return f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM ({table})),
leaf AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree,
    sha256({" || ".join(parts.values())}) AS leaf,
    CASE WHEN {crc} % 3 = 0 THEN sha256({" || ".join(changed.values())}) ELSE sha256({" || ".join(parts.values())}) END AS shown
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
    count(*) OVER (PARTITION BY tree) AS n FROM leaf
),
{climb("up", "SELECT tree, 0 AS lvl, p, leaf AS h, n FROM placed")},
subroot AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM up WHERE n = 1
),
{climb("top", "SELECT '' AS tree, 0 AS lvl, p, h, n FROM subroot")},
{walk("inner_walk", "up", "SELECT rid, tree, 0 AS lvl, p, shown AS h, '' AS proof FROM placed")},
{walk("outer_walk", "top", "SELECT e.rid, '' AS tree, 0 AS lvl, s.p, e.h, e.proof FROM inner_walk_end e JOIN placed USING (rid) JOIN subroot s ON s.tree = placed.tree")}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM placed JOIN outer_walk_end o USING (rid) JOIN subroot s ON s.tree = placed.tree, (SELECT h FROM top WHERE n = 1) t
"""
