"""SimHash near-duplicates, compared bit-sliced.

Fingerprints within the radius agree on enough of their bit blocks (pigeonhole), so they meet under
some block key. Inside a key they are compared vertically: bit plane i holds bit i of 64 fingerprints
per machine word, the sequence is laid against itself at growing distances, and carry-save counters add
the 64 difference planes for all positions at once. Once every position of a stretch has more
differences than the radius allows, the rest of its planes are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.spread import spread_join
from panelsmith.llm.common import NO_ID, arrow_schema, id_of, key_of, raw_text, row_mark
from panelsmith.llm.graph import components
from panelsmith.session import cut_lineage

SHINGLE = 3
RADIUS = 2
#: Fingerprints of one key that one task compares; a larger key is tiled.
TILE = 4096
#: Positions per stretch of the vertical comparison.
_STRETCH = 1 << 16


def _fingerprint(text: bytes, size: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, 42)  # one shingle: its set bits are those over half
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    n = len(words) - size + 1
    hashes = np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # sums of up to 255 bits fit a byte
        planes = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += planes.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, marked: bool = False) -> DataFrame:
    """``key`` (the id, ``NO_ID`` for NULL), ``fp`` (signed 64 bits), if asked ``mark``, per row of ``docs``."""
    shape = "key long, fp long, mark long" if marked else "key long, fp long"
    schema = arrow_schema(docs.sparkSession, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            rest = [c.cast(pa.int64()) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), fps, *rest], schema=schema)

    columns = [key_of().alias("key"), raw_text().alias("text"), *([row_mark(docs).alias("mark")] if marked else [])]
    return docs.select(*columns).mapInArrow(run, shape)


def _planes(values: np.ndarray) -> np.ndarray:
    """[64, words]: row i holds bit i of every value, 64 values per word (padded, one spare word)."""
    words = -(-len(values) // 64) + 1
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(64, words)


def _within(planes: np.ndarray, distance: int, radius: int, live: np.ndarray) -> np.ndarray:
    """Word mask of positions p in ``live`` whose value differs in at most ``radius`` bits from p + distance."""
    jump, shift = divmod(distance, 64)
    words = live.shape[0]
    counters = [np.zeros(words, np.uint64) for _ in range((radius + 1).bit_length())]
    over = ~live
    for i in range(64):
        row = planes[i]
        far = row[jump : jump + words]
        if shift:
            spare = row[jump + 1 : jump + 1 + words]
            spare = np.pad(spare, (0, words - len(spare)))
            far = np.pad(far, (0, words - len(far)))
            far = (far >> np.uint64(shift)) | (spare << np.uint64(64 - shift))
        else:
            far = np.pad(far, (0, words - len(far)))
        carry = row[:words] ^ far
        for k in range(len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if i % 8 == 7:
            above = _exceeds(counters, radius)
            over |= above
            if bool((over == np.uint64(2**64 - 1)).all()):
                break
    return ~(over | _exceeds(counters, radius))


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Positions whose counter is greater than ``radius``."""
    greater = np.zeros_like(counters[0])
    equal = ~greater
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            greater |= equal & counters[k]
            equal &= ~counters[k]
    return greater


def _links(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among ``values`` (sorted by ``groups``): pairs of a group within the radius.

    Every stretch and distance is compared; links that join what is already joined are not returned.
    """
    root = np.arange(len(values))
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    alive = np.repeat(sizes, sizes) > 1
    index = np.flatnonzero(alive)
    values, groups = values[alive], groups[alive]
    left, right = [], []
    distance = 1
    while len(index):
        same = np.zeros(len(index), bool)
        same[: max(0, len(index) - distance)] = groups[distance:] == groups[: max(0, len(index) - distance)]
        if not same.any():
            break
        for at in range(0, len(index), _STRETCH):
            here = same[at : at + _STRETCH]
            if not here.any():
                continue
            planes = _planes(values[at : at + _STRETCH + distance])
            words = -(-len(here) // 64)
            live = np.packbits(np.pad(here, (0, words * 64 - len(here))), bitorder="little").view(np.uint64)
            mask = _within(planes, distance, radius, live)
            p = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[: len(here)]) + at
            if len(p):
                a, b = index[p], index[p + distance]
                a, b = _join(root, a, b)
                left.append(a)
                right.append(b)
        distance += 1
        # positions of groups that end before this distance are left out of the next round
        need = np.zeros(len(index), bool)
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        count = np.diff(np.r_[first, len(groups)])
        need = np.repeat(count > distance, count)
        if not need.all():
            index, values, groups = index[need], values[need], groups[need]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union the pairs in ``root`` (flat: every entry is a root); the pairs that joined two sets."""
    kept_a, kept_b = [], []
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        _, one = np.unique(high, return_index=True)  # each root is hung once a round
        kept_a.append(a[one])
        kept_b.append(b[one])
        parent = np.arange(len(root))
        parent[high[one]] = low[one]
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        root[:] = parent[root]
    if not kept_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(kept_a), np.concatenate(kept_b)


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect all distinct ``fp`` within ``radius`` bits of each other.

    64 bits in ``radius + 2`` blocks: two prints within the radius agree on two blocks at least, so each
    print is dealt out once per pair of blocks, under about 64 * 2 / (radius + 2) key bits. A key with
    more than ``tile`` prints is cut into tiles, and every pair of tiles is a group of its own. Links
    are returned only as far as they join what a task has not yet joined.
    """
    n_blocks = radius + 2
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    choices = [masks[i] | masks[j] for i, j in itertools.combinations(range(n_blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]
    dealt = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)])
        ).alias("key"),
    ).select("fp", "key.choice", "key.part")
    heavy = (
        dealt.groupBy("choice", "part")
        .count()
        .where(F.col("count") > tile)
        .select("choice", "part", F.ceil(F.col("count") / F.lit(tile)).cast("int").alias("tiles"))
    )
    dealt = dealt.join(heavy, ["choice", "part"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    )
    dealt = dealt.select(
        F.xxhash64("choice", "part", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        "fp",
    )
    spark = prints.sparkSession
    schema = arrow_schema(spark, "u long, v long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, values = np.empty(0, np.int64), np.empty(0, np.uint64)

        def done(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _links(c, f, radius)
            fs = f.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fs[a]), pa.array(fs[b])], schema=schema)

        for batch in batches:
            cells = np.r_[cells, batch.column(0).to_numpy(zero_copy_only=False)]
            values = np.r_[values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            whole = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
            if whole >= _STRETCH:
                yield done(cells[:whole], values[:whole])
                cells, values = cells[whole:], values[whole:]
        if len(cells):
            yield done(cells, values)

    return (
        dealt.repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(compare, "u long, v long")
    )


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """``classes`` (one row per ``fp``) with the ``root`` print of the component."""
    roots = components(near_links(classes, radius)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Words are parted by ASCII white space after lower-casing A-Z; a text of fewer words than a shingle
    is one shingle; a text without words (NULL, empty) has fingerprint zero and links like any other.
    ``component_id`` is the least id reachable over links of at most ``radius`` differing bits. A NULL
    id counts as greater than all others. Repeated rows have equal prints, so one component; each is
    returned. Other columns are ignored. Hot fingerprints are one row each from the start.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    classes = _rooted(classes, radius)
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    members = cut_lineage(classes.join(least, "root").select("fp", "component", "n"))
    return spread_join(prints, members, "fp", "n").select(
        id_of("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_of("component").alias("component_id"),
    )


def one_row_per_component(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays: that of the least id, and of rows with that id the least hash of all columns.

    A NULL id counts as greater than all others, so a component without any id keeps one row too. Texts
    under one id that are no near copies are components of their own; each keeps its row. Of rows equal in
    all columns one stays.
    """
    prints = fingerprints(docs, shingle, True)
    classes = cut_lineage(prints.groupBy("fp").agg(F.min(F.struct("key", "mark")).alias("first")))
    kept = _rooted(classes, radius).groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.key").alias("_key"), F.col("first.mark").alias("_mark"))
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    out = docs.select(key_of().alias("_key"), row_mark(docs).alias("_mark"), *columns).join(kept, ["_key", "_mark"], "left_semi")
    out = out.dropDuplicates(["_key", "_mark"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the least of their component: one document of each group stays.

    One row per id stays, whatever its text, and one of all rows without an id: for tables whose ids are unique
    and present. ``one_row_per_component`` loses no text of others; the pipeline uses that.
    """
    found = near_duplicates(docs, **options)
    kept = (
        found.where("doc_id <=> component_id")
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_kept"))
        .distinct()
    )
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    out = docs.select(key_of().alias("_key"), *columns).join(kept, F.col("_key") == F.col("_kept"))
    out = out.dropDuplicates(["_kept"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
