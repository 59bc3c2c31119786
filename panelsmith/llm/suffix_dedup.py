"""Removal of repeated passages by a column-wise suffix sort of the collection.

Every string of ``LENGTH`` bytes that also starts in a document with a smaller id is removed. Which
strings are equal is read from the Burrows-Wheeler transform and common prefixes of the collection, built
column by column (``collection_bwt``): a run of suffixes with common prefixes of at least ``LENGTH`` is one
class of equal strings, and its least document id decides.

To spread this over tasks, strings that may be equal must meet in one:

* the least hash of the anchors (``ANCHOR`` bytes) inside a string of ``LENGTH`` bytes is a function of its
  content, and neighbouring strings mostly share it, so texts fall into segments of one value each;
* a value seen in one document only cannot repeat; its segments stay at home. The others are dealt out by
  value, equal segments of a shard once, with their least document id;
* a value that stands in very many different segments (the end of a common line, say) would burden one
  task. Its segments are cut at fixed distances from the anchor, and dealt out by the bytes that all
  strings of such a part share, their core;
* a core of very many different parts (all of a common line, before or after other text) is counted over
  the shards. Its parts are cut into single strings, each dealt out by the hash of all its bytes.

A symbol of the sort is a group of ``GROUP`` bytes, and every segment is sorted in all ways of grouping, so that a
string of ``LENGTH`` bytes is ``LENGTH / GROUP`` symbols, and a segment takes as many fewer rounds.

Texts travel as shards: compressed rows of some megabytes of whole documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.collection_bwt import Collection
from panelsmith.llm.common import NO_ID, key_of, raw_text
from panelsmith.session import cut_lineage, scratch_path

LENGTH = 50
ANCHOR = 16
#: Bytes per symbol of the sort; it divides ``LENGTH``.
GROUP = 5
#: Strings per segment at most.
SPAN = 36
#: A value with ``DIVERSE`` different segments in each of ``COMMON`` shards or more has its segments cut
#: further, into parts of at most ``PART`` strings.
DIVERSE, COMMON, PART = 16, 8, 9
#: A value with more different segments than this is cut too, and the parts of its cores are counted; a core
#: with more different parts is cut into single strings.
MANY = 1 << 13
#: Bytes of text per shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Expected anchors per task of the first exchange, symbols per task of the second.
ANCHORS_PER_TASK = 2 << 20
SYMBOLS_PER_TASK = 2 << 20

_ROW = "shard long, kind int, part long, body binary"
_SCHEMA = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("body", pa.binary())])
_BODY, _SHARED, _REPLY, _MANY, _DENSE = range(5)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; ``_unpack`` takes their types."""
    raw = b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for t in types:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, t, n, at + 8))
        at += 8 + out[-1].nbytes
    return out


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The six low bytes of each number, byte by byte: the high planes compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).ravel()


def _of_planes(planes: np.ndarray) -> np.ndarray:
    n = len(planes) // 6
    numbers = np.zeros((n, 8), np.uint8)
    numbers[:, :6] = planes.reshape(6, n).T
    return numbers.view("<u8").ravel()


def _pack_sorted(values: np.ndarray, *flags: np.ndarray) -> bytes:
    """Ascending 48-bit values, as byte planes of their gaps, and flags."""
    return _pack(_planes(np.diff(values, prepend=np.uint64(0))), *map(np.packbits, flags))


def _unpack_sorted(blob: bytes, n_flags: int = 1) -> tuple[np.ndarray, ...]:
    planes, *flags = _unpack(blob, "u1", *["u1"] * n_flags)
    values = np.cumsum(_of_planes(planes), dtype=np.uint64)
    return values, *(np.unpackbits(f)[: len(values)].astype(bool) for f in flags)


def _pack_counted(values: np.ndarray, several: np.ndarray, different: np.ndarray) -> bytes:
    """Ascending 48-bit values with a flag and a count each."""
    return _pack(_planes(np.diff(values, prepend=np.uint64(0))), np.packbits(several), _planes(different))


def _unpack_counted(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes, several, different = _unpack(blob, "u1", "u1", "u1")
    values = np.cumsum(_of_planes(planes), dtype=np.uint64)
    return values, np.unpackbits(several)[: len(values)].astype(bool), _of_planes(different).astype(np.int64)


def _among(values: np.ndarray, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``values`` are in ``ascending``, and the place of those."""
    if not len(ascending):
        return np.zeros(len(values), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    found = ascending[at] == values
    return found, at[found]


# --- texts as shards ---------------------------------------------------------------------------


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows of ``_ROW`` with whole documents; ``part`` is the number of text bytes."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        key_of().alias("_key"), raw_text().alias("_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for b in held:
                    stream.write_batch(b)
            body = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
            columns = [[(task << 32) + serial], [_BODY], [size], [body]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            lengths = np.array([len(t.as_buffer()) for t in batch.column(1)], np.int64)
            a = 0
            while a < batch.num_rows:
                total = np.cumsum(lengths[a:])
                n = int(np.searchsorted(total, shard_bytes - size, "right"))
                if n:
                    held.append(batch.slice(a, n))
                    size += int(total[n - 1])
                    a += n
                if a < batch.num_rows:
                    if not held:
                        held.append(batch.slice(a, 1))
                        size += int(lengths[a])
                        a += 1
                    yield flush()
                    held, size, serial = [], 0, serial + 1
        if held:
            yield flush()

    return rows.mapInArrow(run, _ROW)


class _Shard:
    """Documents of a shard: ids, bounds in the joined bytes, the other columns."""

    def __init__(self, body: bytes):
        raw = zstandard.ZstdDecompressor().decompress(body)
        self.table = pa.ipc.open_stream(raw).read_all()
        texts = self.table.column("_text").to_pylist()
        self.ids = self.table.column("_key").to_numpy().astype(np.int64)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.bytes = b"".join(texts)
        self.buffer = np.frombuffer(self.bytes, np.uint8)


# --- anchors and segments ----------------------------------------------------------------------

_ODD = [
    np.uint64(x)
    for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
]


def _anchor_hash(text: np.ndarray) -> np.ndarray:
    """48-bit hash of the ``ANCHOR`` bytes (a sum of two powers of two, 32 at most) from each place on."""
    h = text.astype(np.uint64)
    h += np.uint64(1)
    width, parts = 1, {}
    for odd in _ODD[:4]:
        h = h[..., :-width] * odd + h[..., width:]
        width *= 2
        parts[width] = h
    n, rest = text.shape[-1] - ANCHOR + 1, ANCHOR - 16
    h = parts[16][..., :n] * _ODD[4]
    if rest:
        h += parts[rest][..., 16 : 16 + n]
    h ^= h >> np.uint64(32)
    h *= _ODD[5]
    h ^= h >> np.uint64(29)
    h *= _ODD[0]
    h >>= np.uint64(16)
    return h


def _least_anchor(text: np.ndarray) -> np.ndarray:
    """For each start of ``LENGTH`` bytes the least hash of the anchors inside."""
    h = _anchor_hash(text)
    window, width = LENGTH - ANCHOR + 1, 1
    while 2 * width <= window:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    last = window - width
    return np.minimum(h[: len(h) - last], h[last:])


def _runs(shard: _Shard, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of starts that share the least anchor: first start, number, value, document."""
    usable = np.maximum(shard.lengths - LENGTH + 1, 0)
    total = len(shard.buffer)
    edge = np.zeros(total + 1, bool)
    valid = np.zeros(total + 1, np.int8)
    has = usable > 0
    valid[shard.begins[has]] += 1
    valid[shard.begins[has] + usable[has]] -= 1
    edge[shard.begins[has]] = True
    starts, values = [], []
    before = None
    for a in range(0, total - LENGTH + 1, block):
        least = _least_anchor(shard.buffer[a : min(a + block + LENGTH - 1, total)])
        changes = edge[a : a + len(least)].copy()
        changes[1:] |= least[1:] != least[:-1]
        if before is not None:
            changes[0] |= least[0] != before
        before = least[-1]
        at = np.flatnonzero(changes)
        starts.append(at + a)
        values.append(least[at])
    if not starts:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty
    start, value = np.concatenate(starts), np.concatenate(values)
    inside = np.cumsum(valid, dtype=np.int8)[start] > 0
    document = np.searchsorted(shard.ends, start, "right")
    stop = np.minimum(np.r_[start[1:], total], (shard.begins + usable)[np.minimum(document, len(usable) - 1)])
    keep = inside
    return start[keep], (stop - start)[keep], value[keep], document[keep]


def _task_of(value: np.ndarray, tasks: int) -> np.ndarray:
    return (((value * _ODD[2]) >> np.uint64(20)) % np.uint64(tasks)).astype(np.int64)


def _spans(start: int, count: int, task: int) -> Iterator[tuple[int, int, int]]:
    """A segment as parts of at most ``SPAN`` strings: first start, number, task."""
    for a in range(start, start + count, SPAN):
        yield a, min(SPAN, start + count - a), task


#: Strings of a common segment that are looked at in one go.
_WIDE = 64


def _parts(shard: _Shard, start: np.ndarray, count: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Common segments cut by the distance of each string from the anchor in it: segment, first start, number, core.

    Equal strings hold the anchor at the same distance, and lie in parts with the same shared bytes. Inside a
    run of one byte every place is an anchor, so that each string there is a part of its own.
    """
    places = np.arange(_WIDE + LENGTH - 1)
    text = shard.buffer[np.minimum(start[:, None] + places, len(shard.buffer) - 1)]
    hashes = _anchor_hash(text)
    places = places[: hashes.shape[1]]
    anchors = np.where((hashes == value[:, None]) & (places < count[:, None] + LENGTH - ANCHOR), places, 1 << 20)
    following = np.minimum.accumulate(anchors[:, ::-1], axis=1)[:, ::-1][:, :_WIDE]
    distance = following - places[:_WIDE]
    part = distance // PART
    opens = np.ones(distance.shape, bool)
    opens[:, 1:] = (part[:, 1:] != part[:, :-1]) | (distance[:, 1:] != distance[:, :-1] - 1)
    segment, first = np.nonzero(opens & (places[:_WIDE] < count[:, None]))
    last = np.r_[segment[1:] != segment[:-1], True]
    stop = np.where(last, count[segment], np.r_[first[1:], 0])
    part = part[segment, first]
    cores = (start[segment] + first + distance[segment, first] - PART * part).tolist()
    size = LENGTH - PART + 1
    core = [xxhash.xxh64_intdigest(shard.bytes[c : c + size], k) >> 16 for c, k in zip(cores, part.tolist())]
    return segment, start[segment] + first, stop - first, np.array(core, np.int64)


def _digests(shard: _Shard, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit multilinear hash of each segment; those of equal hash, length and value are compared (``_same``)."""
    out = np.empty(len(start), np.uint64)
    factors = np.random.default_rng(50).integers(0, 1 << 63, SPAN + LENGTH, np.uint64) * np.uint64(2) + np.uint64(1)
    for n in np.unique(count).tolist():
        size = n + LENGTH - 1
        at = np.flatnonzero(count == n)
        windows = np.lib.stride_tricks.sliding_window_view(shard.buffer, size)
        for a in range(0, len(at), 4096):
            rows = windows[start[at[a : a + 4096]]].astype(np.uint64)
            rows += np.uint64(1)
            rows *= factors[:size]
            sums = rows.sum(axis=1, dtype=np.uint64)
            out[at[a : a + 4096]] = sums ^ sums >> np.uint64(31)
    return out


def _same(shard: _Shard, one: np.ndarray, other: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether the bytes of two segments, of ``count`` strings both, are equal."""
    out = np.empty(len(one), bool)
    for n in np.unique(count).tolist():
        at = np.flatnonzero(count == n)
        windows = np.lib.stride_tricks.sliding_window_view(shard.buffer, n + LENGTH - 1)
        for a in range(0, len(at), 4096):
            some = at[a : a + 4096]
            out[some] = (windows[one[some]] == windows[other[some]]).all(axis=1)
    return out


def _cut(shard: _Shard, start: np.ndarray, count: np.ndarray, value: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Common segments as rows of their parts: start, number, document, core, value."""
    found = [np.empty((0, 5), np.int64)]
    which, inner = np.arange(len(start)), np.zeros(len(start), np.int64)
    if len(count) and count.max() > _WIDE:  # long stretches, of repeated anchors, in several goes
        goes = -(-count // _WIDE)
        which = np.repeat(which, goes)
        inner = (np.arange(len(which)) - np.repeat(np.cumsum(goes) - goes, goes)) * _WIDE
    for a in range(0, len(which), 2048):
        own, skip = which[a : a + 2048], inner[a : a + 2048]
        number = np.minimum(count[own] - skip, _WIDE)
        segment, first, n, core = _parts(shard, start[own] + skip, number, value[own])
        own = own[segment]
        found.append(np.stack([first, n, document[own], core, value[own].astype(np.int64)], axis=1))
    return np.concatenate(found)


def _singles(shard: _Shard, parts: np.ndarray, tasks: int) -> np.ndarray:
    """Rows of ``_cut`` as rows of one string each, with the task by the hash of the string instead of the core."""
    n = parts[:, 1]
    rows = np.repeat(parts, n, axis=0)
    rows[:, 0] += np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    rows[:, 1] = 1
    rows[:, 3] = _task_of(_digests(shard, rows[:, 0], rows[:, 1]), tasks)
    return rows


class _Segments:
    """The segments of a shard whose value is shared, each distinct text once, in order of their tasks."""

    def __init__(self, shard: _Shard, shared: list[bytes], dense: list[bytes], tasks: int):
        start, count, value, document = _runs(shard)
        known = [_unpack_sorted(b) for b in shared]
        values = np.concatenate([k[0] for k in known]) if known else np.empty(0, np.uint64)
        common = np.concatenate([k[1] for k in known]) if known else np.empty(0, bool)
        order = np.argsort(values)
        values, common = values[order], common[order]
        pick, at = _among(value, values)
        start, count, value, document = start[pick], count[pick], value[pick], document[pick]
        often = common[at]
        home = _task_of(value, tasks)
        whole = ~often & (count <= SPAN)
        parts = [np.stack([start, count, document, home, value.astype(np.int64)], axis=1)[whole]]
        for a, n, v, d, t in zip(*(x[~often & ~whole].tolist() for x in (start, count, value, document, home))):
            parts.append(np.array([(b, k, d, to, v) for b, k, to in _spans(a, n, t)], np.int64))
        cut = _cut(shard, start[often], count[often], value[often], document[often])
        single, _ = _among(cut[:, 3], np.sort(np.concatenate([_unpack_sorted(b, 0)[0] for b in dense])).astype(np.int64) if dense else cut[:0, 3])
        parts.append(_singles(shard, cut[single], tasks))
        cut = cut[~single]
        cut[:, 3] %= tasks
        parts.append(cut)
        self.start, self.count, self.document, target, value = np.concatenate(parts).T
        look = _digests(shard, self.start, self.count)
        order = np.lexsort((value, look, self.count, target))
        opens = np.ones(len(order), bool)
        for column in (value, look, self.count, target):
            opens[1:] &= column[order[1:]] == column[order[:-1]]
        opens[1:] = ~opens[1:]
        again = np.flatnonzero(~opens)
        opens[again] = ~_same(shard, self.start[order[again - 1]], self.start[order[again]], self.count[order[again]])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(opens) - 1
        self.first = order[opens]
        self.targets, self.counts = target[self.first], self.count[self.first]
        self.least = np.full(len(self.first), NO_ID, np.int64)
        np.minimum.at(self.least, self.which, shard.ids[self.document])

    def texts(self, shard: _Shard, a: int, b: int) -> bytes:
        """The distinct segments ``a`` to ``b``, back to back."""
        first = self.first[a:b]
        pairs = zip(self.start[first].tolist(), (self.start[first] + self.count[first] + LENGTH - 1).tolist())
        return b"".join([shard.bytes[x:y] for x, y in pairs])

    def by_task(self) -> Iterator[tuple[int, int, int]]:
        edges = np.flatnonzero(np.r_[True, self.targets[1:] != self.targets[:-1]]) if len(self.targets) else []
        for a, b in zip(edges, [*edges[1:], len(self.targets)]):
            yield int(self.targets[a]), int(a), int(b)


def _row_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["shard", "kind", "part", "body"])


def _anchor_rows(tasks: int):
    """Per shard and task: the values seen, whether in documents of different ids, in how many different segments."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, body in zip(frame["shard"], frame["body"]):
                shard = _Shard(body)
                start, count, value, document = _runs(shard)
                if len(value):
                    value, several, different = _summary(shard, start, count, value, document)
                    target = _task_of(value, tasks)
                    by = np.argsort(target, kind="stable")
                    value, several, different, target = value[by], several[by], different[by], target[by]
                    edges = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
                    yield _row_frame(
                        [
                            (number, _SHARED, int(target[a]), _pack_counted(value[a:b], several[a:b], different[a:b]))
                            for a, b in zip(edges, [*edges[1:], len(target)])
                        ]
                    )

    return run


def _summary(shard: _Shard, start: np.ndarray, count: np.ndarray, value: np.ndarray, document: np.ndarray):
    """Distinct values, and for each whether its ids are several and the number of its different segments.

    Segments are told apart by their first 48 and last 40 bytes: all of one without repeated anchors.
    """
    order = np.argsort(value, kind="stable")
    value = value[order]
    again = value[1:] == value[:-1]
    alike = np.flatnonzero(np.r_[False, again] | np.r_[again, False])  # only these can differ from others of their value
    eight = np.lib.stride_tricks.sliding_window_view(shard.buffer, 8)
    starts = start[order[alike]]
    ends, hashes = starts + count[order[alike]] + LENGTH - 1, count[order[alike]].astype(np.uint64)
    for at in [*(starts + k for k in range(0, 48, 8)), *(ends - k for k in range(8, 48, 8))]:
        hashes ^= eight[at].copy().view("<u8").ravel()
        hashes *= _ODD[0]
        hashes ^= hashes >> np.uint64(32)
    inner = np.lexsort((hashes, value[alike]))
    look = np.zeros(len(order), np.uint64)
    look[alike] = hashes[inner]
    order[alike] = order[alike[inner]]
    ids = shard.ids[document[order]]
    opens = np.r_[True, value[1:] != value[:-1]]
    first = np.flatnonzero(opens)
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    different = np.add.reduceat((opens | np.r_[True, look[1:] != look[:-1]]).astype(np.int64), first)
    return value[first], several, different


def _share(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one task's values: to each shard those that also stand in another document."""
    lists = [_unpack_counted(b) for b in frame["body"]]
    sizes = [len(v) for v, _, _ in lists]
    value, several, different = (np.concatenate(column) for column in zip(*lists))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(value, kind="stable")
    value, several, different, owner = value[order], several[order], different[order], owner[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    shards = np.diff(np.r_[first, len(value)])
    shared = np.repeat((shards > 1) | np.maximum.reduceat(several, first), shards)
    many = np.add.reduceat(different, first) > MANY
    common = np.repeat(many | (np.add.reduceat((different >= DIVERSE).astype(np.int64), first) >= COMMON), shards)
    many = np.repeat(many, shards)
    value, owner, common, many, different = (x[shared] for x in (value, owner, common, many, different))
    order = np.argsort(owner, kind="stable")  # values stay ascending for each owner
    value, owner, common, many, different = (x[order] for x in (value, owner, common, many, different))
    symbols = np.where(common, different * -(-SPAN // PART) * (LENGTH + PART), different * (LENGTH + ANCHOR // 2))
    edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
    out = []
    for shard, a, b in zip(frame["shard"], edges, edges[1:]):
        if b > a:
            out.append((shard, _SHARED, int(symbols[a:b].sum()), _pack_sorted(value[a:b], common[a:b])))
        if many[a:b].any():
            out.append((shard, _MANY, 0, _pack_sorted(value[a:b][many[a:b]])))
    return _row_frame(out)


def _of_kinds(table: pa.Table, *kinds: int) -> list[list[bytes]]:
    rows = list(zip(table.column("kind").to_pylist(), table.column("body").to_pylist()))
    return [[b for k, b in rows if k == kind] for kind in kinds]


def _row_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(_SCHEMA)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _core_rows(tasks: int):
    """Of one shard: the cores of its values in very many segments, with the number of different parts, by task."""

    def run(body: pa.Table, told: pa.Table) -> pa.Table:
        if not len(told):
            return _row_table([])
        shard = _Shard(body.column("body")[0].as_py())
        many = np.sort(np.concatenate([_unpack_sorted(b, 0)[0] for b in _of_kinds(told, _MANY)[0]]))
        segments = _runs(shard)
        pick, _ = _among(segments[2], many)
        cut = _cut(shard, *(x[pick] for x in segments))
        look = _digests(shard, cut[:, 0], cut[:, 1])
        _, once = np.unique(np.stack([cut[:, 3], cut[:, 1], look.view(np.int64)]), axis=1, return_index=True)
        cores, counts = np.unique(cut[once, 3].astype(np.uint64), return_counts=True)
        target, number = _task_of(cores, tasks), body.column("shard")[0].as_py()
        return _row_table(
            [
                (number, _DENSE, t, _pack_counted(cores[target == t], counts[target == t] > 0, counts[target == t]))
                for t in np.unique(target).tolist()
            ]
        )

    return run


def _dense(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one task's cores: to each shard those with very many parts; ``part`` is the symbols of their strings."""
    lists = [_unpack_counted(b) for b in frame["body"]]
    cores, which = np.unique(np.concatenate([v for v, _, _ in lists]), return_inverse=True)
    total = np.zeros(len(cores), np.int64)
    np.add.at(total, which, np.concatenate([n for _, _, n in lists]))
    out = []
    for shard, (own, _, n) in zip(frame["shard"], lists):
        dense = total[np.searchsorted(cores, own)] > MANY
        if dense.any():
            out.append((shard, _DENSE, int(n[dense].sum()) * PART * LENGTH, _pack_sorted(own[dense])))
    return _row_frame(out)


def _segment_rows(tasks: int):
    """Of one shard: its distinct segments by task, with the least id each occurs in."""

    def run(body: pa.Table, told: pa.Table) -> pa.Table:
        shared, dense = _of_kinds(told, _SHARED, _DENSE)
        out = []
        if shared:
            shard, number = _Shard(body.column("body")[0].as_py()), body.column("shard")[0].as_py()
            found = _Segments(shard, shared, dense, tasks)
            for task, a, b in found.by_task():
                joined = np.frombuffer(found.texts(shard, a, b), np.uint8)
                blob = _pack(found.counts[a:b].astype("u1"), found.least[a:b], joined)
                out.append((number, _BODY, task, blob))
        return _row_table(out)

    return run


def _grouped(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings in groups of ``GROUP`` bytes from the right end, then all from one byte before it, and so on.

    Returns the symbols (groups numbered from 1 in their order), the ends of the strings, and the bytes dropped
    at each end.
    """
    ends = np.cumsum(lengths)
    groups = np.zeros(max(len(text) - GROUP + 1, 0), np.uint64)
    for k in range(GROUP):
        groups <<= np.uint64(8)
        groups |= text[k : k + len(groups)]
    taken, sizes = [], []
    for drop in range(GROUP):
        size = (lengths - drop) // GROUP
        first = ends - drop - GROUP * size
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        taken.append(groups[np.repeat(first, size) + GROUP * inner])
        sizes.append(size)
    symbols = np.concatenate(taken)
    places = 64 - 8 * GROUP
    if len(symbols) < 1 << places:  # a group and its place share a word
        order = symbols << np.uint64(places)
        order |= np.arange(len(symbols), dtype=np.uint64)
        order.sort()
        at = (order & np.uint64((1 << places) - 1)).astype(np.int64)
        order >>= np.uint64(places)
        number = np.empty(len(symbols), np.int64)
        number[at] = np.cumsum(np.r_[True, order[1:] != order[:-1]]) if len(order) else at
    else:
        number = np.unique(symbols, return_inverse=True)[1].ravel() + 1
    dropped = np.repeat(np.arange(GROUP), len(lengths))
    return number, np.cumsum(np.concatenate(sizes)), dropped


def _repeating(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of the different segments whose strings may stand more than once: number of the first string
    (of all segments'), number of strings, and the stretches' bytes.

    Left out is a string with an anchor that occurs once in all segments. Anchors are told apart by their hash,
    so one that occurs once may be taken for repeated, but none that repeats is missed.
    """
    windows = lengths - LENGTH + 1
    hashes = _anchor_hash(text)
    slot = (hashes & np.uint64((1 << (2 * len(hashes)).bit_length()) - 1)).astype(np.int64)
    lone = np.cumsum(np.r_[0, np.bincount(slot)[slot] == 1], dtype=np.int32)
    inside = LENGTH - ANCHOR + 1
    start = np.arange(int(windows.sum())) + np.repeat(np.arange(len(windows)) * (LENGTH - 1), windows)
    kept = np.flatnonzero(lone[start + inside] == lone[start])
    opens = np.r_[True, np.diff(start[kept]) != 1][: len(kept)]
    at = np.flatnonzero(opens)
    first, n = kept[at], np.diff(np.r_[at, len(kept)])
    sizes = n + LENGTH - 1
    places = np.arange(int(sizes.sum())) + np.repeat(start[first] - np.cumsum(sizes) + sizes, sizes)
    return first, n, text[places]


def _classify(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one task's segments: to each shard the least ids of their strings' classes, where they are not its own."""
    seen: dict[bytes, int] = {}
    least: list[int] = []
    asked = []
    for body in frame["body"]:
        counts, ids, text = _unpack(body, "u1", "i8", "u1")
        raw, at, which = text.tobytes(), 0, []
        for n, i in zip(counts.tolist(), ids.tolist()):
            piece = raw[at : at + n + LENGTH - 1]
            at += len(piece)
            k = seen.get(piece)
            if k is None:
                k = seen[piece] = len(seen)
                least.append(i)
            elif i < least[k]:
                least[k] = i
            which.append(k)
        asked.append((np.array(which, np.int64), ids))
    pieces = list(seen)
    lengths = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ids = np.array(least, np.int64)
    windows = lengths - LENGTH + 1
    offsets = np.cumsum(windows) - windows
    answer = np.repeat(ids, windows)
    first, n, cut = _repeating(text, lengths)
    if len(first):
        ids = answer[first]
        sizes, before = n + LENGTH - 1, np.cumsum(n) - n
        run_of = np.empty(int(n.sum()), np.int64)
        symbols, ends, dropped = _grouped(cut, sizes)
        collection = Collection(symbols, ends, LENGTH // GROUP)
        try:
            collection.build()
            run, n_runs = collection.classes()
            best = np.full(n_runs, NO_ID, np.int64)
            for length, strings, at in collection.suffix_places():
                if length >= LENGTH // GROUP:
                    runs, piece = run[at], strings % len(first)
                    np.minimum.at(best, runs, ids[piece])
                    run_of[before[piece] + sizes[piece] - dropped[strings] - GROUP * length] = runs
        finally:
            collection.close()
        answer[np.repeat(first - before, n) + np.arange(len(run_of))] = best[run_of]
    out = []
    for shard, part, (which, own) in zip(frame["shard"], frame["part"], asked):
        n = windows[which]
        begins = np.cumsum(n) - n
        flat = answer[np.repeat(offsets[which] - begins, n) + np.arange(int(n.sum()))]
        other = np.logical_or.reduceat(flat != np.repeat(own, n), begins)
        if other.any():
            flat = flat[np.repeat(other, n)]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            blob = _pack(np.packbits(other), np.diff(np.r_[first, len(flat)]).astype("<u4"), flat[first])
            out.append((shard, _REPLY, part, blob))
    return _row_frame(out)


def _removed(shard: _Shard, found: _Segments, replies: dict[int, bytes]) -> np.ndarray:
    """Per byte of the shard, whether a string that starts in a smaller document covers it."""
    answers = []
    for task, a, b in found.by_task():
        n = found.counts[a:b]
        answers.append(np.repeat(found.least[a:b], n))
        if task in replies:
            other, lengths, values = _unpack(replies[task], "u1", "<u4", "i8")
            answers[-1][np.repeat(np.unpackbits(other)[: b - a].astype(bool), n)] = np.repeat(values, lengths)
    change = np.zeros(len(shard.buffer) + 1, np.int32)
    if answers:
        answer = np.concatenate(answers)
        offsets = np.cumsum(found.counts) - found.counts
        n = found.count
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        least = answer[np.repeat(offsets[found.which], n) + inner]
        start = np.repeat(found.start, n) + inner
        start = start[least < np.repeat(shard.ids[found.document], n)]
        change[start] += 1
        change[start + LENGTH] -= 1
    return np.cumsum(change, out=change)[:-1] > 0


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(tasks: int, cleaned: bool, names: list[str]):
    def run(body: pa.Table, told: pa.Table) -> pa.Table:
        shard = _Shard(body.column("body")[0].as_py())
        shared, dense = _of_kinds(told, _SHARED, _DENSE)
        if shared:
            rows = zip(*(told.column(c).to_pylist() for c in ("kind", "part", "body")))
            replies = {p: b for k, p, b in rows if k == _REPLY}
            removed = _removed(shard, _Segments(shard, shared, dense, tasks), replies)
        else:
            removed = np.zeros(len(shard.buffer), bool)
        sums = np.r_[np.int32(0), np.cumsum(removed, dtype=np.int32)]
        n_removed = sums[shard.ends] - sums[shard.begins]
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inner = shard.begins[shard.lengths > 0]
        opens[inner] = removed[inner]
        spans = np.r_[np.int32(0), np.cumsum(opens, dtype=np.int32)]
        kept = [
            shard.bytes[a:b] if not n else shard.buffer[a:b][~removed[a:b]].tobytes()
            for a, b, n in zip(shard.begins.tolist(), shard.ends.tolist(), n_removed.tolist())
        ]
        if cleaned:
            out, rest = [], iter(range(len(names)))
            for name in names:
                if name == "text":
                    out.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
                else:
                    out.append(shard.table.column(f"c{next(rest)}").combine_chunks())
            return pa.table(out, names=names)
        return pa.table(
            {
                "doc_id": pa.array([None if i == NO_ID else i for i in shard.ids.tolist()], pa.int64()),
                "n_bytes": shard.lengths,
                "n_removed": n_removed.astype(np.int64),
                "n_spans": (spans[shard.ends] - spans[shard.begins]).astype(np.int64),
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            }
        )

    return run


def _bucketed(shards: DataFrame) -> DataFrame:
    """``shards`` as a written table in buckets by shard: cogrouping it with what a shard is told moves no text.

    The table's entry in the catalog is dropped at once; the files stay in the shared folder, as of other tables.
    """
    spark = shards.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, "shards")
    name = "panelsmith_" + path.rsplit("-", 1)[1]
    shards.write.bucketBy(buckets, "shard").option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _run(docs: DataFrame, cleaned: bool, shard_bytes: int) -> DataFrame:
    shards = _bucketed(_shards(docs, shard_bytes))
    bodies = shards.groupBy("shard")
    total = shards.agg(F.sum("part")).first()[0] or 0
    anchors = total * 2 // (LENGTH - ANCHOR + 2)
    tasks = max(1, -(-anchors // ANCHORS_PER_TASK))
    shared = cut_lineage(
        shards.mapInPandas(_anchor_rows(tasks), _ROW).groupBy("part").applyInPandas(_share, _ROW)
    )
    many = shared.where(F.col("kind") == _MANY)
    told = shared.where(F.col("kind") == _SHARED)
    symbols = told.agg(F.sum("part")).first()[0] or 0
    if not many.isEmpty():
        counted = bodies.cogroup(many.groupBy("shard")).applyInArrow(_core_rows(tasks), _ROW)
        dense = cut_lineage(counted.groupBy("part").applyInPandas(_dense, _ROW))
        symbols += dense.agg(F.sum("part")).first()[0] or 0
        told = told.unionByName(dense)
    second = max(1, -(-symbols // SYMBOLS_PER_TASK))
    asked = bodies.cogroup(told.groupBy("shard")).applyInArrow(_segment_rows(second), _ROW)
    replies = asked.groupBy("part").applyInPandas(_classify, _ROW)
    names = docs.columns
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema if cleaned else _DIGEST
    answered = told.unionByName(replies).groupBy("shard")
    return bodies.cogroup(answered).applyInArrow(_finish(second, cleaned, names), schema)


def repeated_passages(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte is removed if a string of 50 bytes covers it that also starts in a document with a smaller id.
    Strings are judged on the input and never cross documents. NULL texts are empty; shorter texts than
    50 bytes lose nothing; a NULL id counts as greater than all others; rows of the same id do not remove
    from each other. Columns other than ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
    """
    return _run(docs.select("doc_id", "text"), False, shard_bytes)


def without_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the bytes of ``repeated_passages`` cut out of ``text``; every row and column stays.

    Bytes of a character that is cut in part go too. A text that is wholly removed, or NULL, is empty.
    """
    return _run(docs, True, shard_bytes)
