"""Vector codes by product quantisation; the codebooks are learnt by ball k-means on integers.

A vector is cut into equal parts, and each part position has a codebook. A round assigns every part to its
nearest entry and replaces each entry by the mean of its parts. The assignment is exact but rarely compares a
part with all entries. The parts of one entry form a ball around it, of radius r:

* another entry is a neighbour only if its distance is at most 2 r; no part of the ball can be nearer to the rest;
* a part closer to its entry than half the way to the nearest neighbour is in the stable core and keeps its entry;
* the others lie in rings: whoever is farther out than half the way to the m nearest neighbours, but not to the
  next, is compared with these m only.

All distances are squared integers, so the tests are exact, and ties (half the way exactly) stay candidates.
Balls are formed per Arrow batch of a task, whose radii are at most those of the whole ball. A pass reads the
table of the last one (integers and codes), writes the next, and carries a batch's sums beside its first
row; only the codebooks and their sums, sizes fixed by the parameters, are on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelsmith.functions.spread import spread_join
from panelsmith.llm.common import key_of
from panelsmith.session import cut_lineage, drop_table, scratch_path

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6


def _bits(width: int) -> int:
    """Components are held to +-2**bits, so that four times a part's squared distance fits 62 bits."""
    return min(30, (57 - math.ceil(math.log2(max(width, 1)))) // 2)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row and its squared distance; ties go to the lower index."""
    at = np.zeros(len(x), np.int64)
    best = ((x - entries[0]) ** 2).sum(axis=1)
    for e in range(1, len(entries)):
        d = ((x - entries[e]) ** 2).sum(axis=1)
        closer = d < best
        at[closer], best[closer] = e, d[closer]
    return at, best


def ball_nearest(x: np.ndarray, entries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``nearest`` from an earlier assignment ``own``; also how many distances were computed."""
    best, at = ((x - entries[own]) ** 2).sum(axis=1), own.astype(np.int64)
    first = best.copy()
    k, done = len(entries), len(x)
    radius = np.full(k, -1, np.int64)
    np.maximum.at(radius, at, first)
    apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
    # entries beyond twice the radius, and the entry itself, are at no distance that a ring could reach
    far = np.iinfo(np.int64).max
    gaps = np.where((apart <= 4 * radius[:, None]) & ~np.eye(k, dtype=bool), apart, far)
    order = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, order, axis=1)
    outside = np.arange(len(x))
    for m in range(k - 1):
        outside = outside[gaps[own[outside], m] <= 4 * first[outside]]
        if not len(outside):
            break
        other = order[own[outside], m]
        d = ((x[outside] - entries[other]) ** 2).sum(axis=1)
        done += len(outside)
        better = (d < best[outside]) | ((d == best[outside]) & (other < at[outside]))
        moved = outside[better]
        best[moved], at[moved] = d[better], other[better]
    return at, best, done


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    bound = 1 << _bits(width // PARTS)
    return np.clip(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64), -bound, bound)


def _sums(x: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """Per part position and entry the sums of the components, then the number of parts."""
    n, width = x.shape
    w = width // PARTS
    out = np.zeros((PARTS, entries, w + 1), np.int64)
    for p in range(PARTS):
        for i in range(w):
            # sums of 2**20 rows of 2**30 at most, which doubles hold exactly
            out[p, :, i] = np.bincount(codes[:, p], x[:, p * w + i], entries)
        out[p, :, w] = np.bincount(codes[:, p], minlength=entries)
    return out


def _pass(state: DataFrame, books: np.ndarray, width: int, known: list[bool] | None, last: bool) -> DataFrame:
    """The rows with new codes; ``known``: by part, whether the old codes still hold (None: there are none)."""
    schema = to_arrow_schema(state.schema)
    w, entries = width // PARTS, books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1 << 15):
                batch = whole.slice(start, 1 << 15)
                n = batch.num_rows
                x = _matrix(batch.column("v"), width)
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                if known is not None:
                    codes[:] = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, PARTS)
                for p in range(PARTS):
                    part = x[:, p * w : (p + 1) * w]
                    if known is None:
                        codes[:, p], d = nearest(part, books[p])
                    elif known[p] and not last:
                        continue
                    else:
                        codes[:, p], d, _ = ball_nearest(part, books[p], codes[:, p])
                    error += d
                sums = [None] * n
                if not last:
                    sums[0] = _sums(x, codes, entries).tobytes()
                made = {"codes": [c.tobytes() for c in codes], "error": error, "sums": sums}
                columns = [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return state.mapInArrow(run, state.schema)


def _totals(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of all batches: added up per task, then by slot."""
    schema = pa.schema([("slot", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(math.prod(shape), np.int64)
        for batch in batches:
            for blob in batch.column("sums").to_pylist():
                total += np.frombuffer(blob, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=schema)

    parts = state.where(F.col("sums").isNotNull()).select("sums").mapInArrow(run, "slot int, value long")
    out = np.zeros(math.prod(shape), np.int64)
    for slot, value in parts.groupBy("slot").agg(F.sum("value")).collect():
        out[slot] = value
    return out.reshape(shape)


def _integers(rows: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """Kept rows: ``key``, ``id``, ``label`` and the vector's integers ``v``."""
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    bound = float(1 << 30)
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))).cast("int"))
    kept = rows.where(x.isNotNull() & ~bad)
    columns = [key_of(id_column).alias("key"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("label")]
    return kept.select(*columns, scaled.alias("v"))


def encode(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (part, entry, component) they were made with.

    The table has ``id``, ``label``, ``code`` (an entry number per part, two hex digits each) and ``error`` (squared
    distances to the entries, summed over the parts). Components x become floor(4096 x), held to +-2**24 or
    more (by the width of a part; 2**27 for eight components); vectors that are NULL or hold NULL or non-finite
    components are left out, and so are those whose length is not the most frequent one that ``PARTS`` divides.
    Codebooks start with the parts of the ``ENTRIES`` least ids (equal ids by their vectors, NULL ids last);
    with fewer vectors there are fewer entries. Entries without parts stay. Repeated rows count as often as
    they occur. An empty table gives no codes and codebooks without entries.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "codes")
    kept = _integers(rows, id_column, vector, label)
    kept.write.parquet(path)
    kept = spark.read.schema(kept.schema).parquet(path)
    lengths = kept.groupBy(F.size("v").alias("n")).count().where(F.col("n") % PARTS == 0).orderBy(F.desc("count"), F.desc("n")).first()
    width = lengths["n"] if lengths else 0
    w = width // PARTS
    kept = kept.where(F.size("v") == width)
    columns = [*kept.columns, "codes", "error", "sums"]
    empty = {"codes": F.lit(None).cast("binary"), "error": F.lit(0).cast("long"), "sums": F.lit(None).cast("binary")}
    state = kept.withColumns(empty).select(*columns)
    seeds = kept.orderBy("key", "v").limit(ENTRIES).select("v").collect()
    books = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), PARTS, w).transpose(1, 0, 2)
    books = np.clip(books, -(1 << _bits(w)), 1 << _bits(w))
    known = None
    for step in range(ROUNDS + 1 if len(seeds) else 0):
        last = step == ROUNDS
        written = scratch_path(spark, "codes")
        _pass(state, books, width, known, last).write.parquet(written)
        state = spark.read.schema(state.schema).parquet(written)
        drop_table(spark, path)
        path = written
        if not last:
            totals = _totals(state, (PARTS, len(seeds), w + 1))
            counts = totals[:, :, w:]
            means = np.where(counts > 0, totals[:, :, :w] // np.maximum(counts, 1), books)
            known = [bool((means[p] == books[p]).all()) for p in range(PARTS)]
            books = means
    digits = F.lower(F.hex("codes"))
    return state.select("id", "label", digits.alias("code"), "error"), books


def label_totals(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors summed over equal labels (NULLs together; NULL beyond 64 bits)."""
    text = F.col("label").cast("string")
    keyed = codes.withColumn("_label", F.coalesce(F.concat(F.lit("="), text), F.lit("-")))
    totals = cut_lineage(keyed.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    return spread_join(keyed, totals, "_label", "_n").drop("_label", "_n")


def compress(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of an embeddings table; see ``encode``.

    Other columns are ignored; a table without usable vectors gives no rows.
    """
    codes, books = encode(rows)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return label_totals(codes).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def sql() -> str:
    """The same for DuckDB, by comparison with all entries; for vectors of one length."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, part, entry, d FROM (
    SELECT rid, part, entry, sum((x - c) * (x - c)) AS d FROM comp JOIN b{r} USING (part, i) GROUP BY rid, part, entry
  ) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1
)""")
        if r < ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT part, entry, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM b{r} LEFT JOIN (
    SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM comp JOIN a{r} USING (rid, part) GROUP BY part, entry, i
  ) USING (part, entry, i)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v,
    row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, len(embedding) // {PARTS} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS MATERIALIZED (
  SELECT rid, (j - 1) // w AS part, (j - 1) % w AS i, v[j] AS x FROM (SELECT rid, v, w, unnest(range(1, len(v) + 1)) AS j FROM kept)
), b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, i, x AS c FROM comp WHERE rid <= {ENTRIES}),
{", ".join(steps)},
coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""
