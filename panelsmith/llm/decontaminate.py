"""Benchmark decontamination by a distributed positional inverted index.

The corpus is indexed in shards of whole documents. A shard's postings (term -> sorted token
positions) are written once as a table; document frequencies come from that table. A test phrase is
looked up by intersecting the offset-adjusted position lists of its terms, rarest term first, so that
nearly every phrase ends after one short list.

Only terms of the benchmark are indexed: no other list can be asked for. The benchmark is cut into
slices whose words and phrases have a bounded size; one slice at a time is broadcast, so that any
benchmark can be searched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import (
    arrow_schema,
    id_of,
    key_of,
    raw_text,
    row_mark,
    table_of,
    without_marks,
)
from panelsmith.session import cut_lineage

WINDOW = 10
#: Words of a document that hold all words of a window in a proximity match.
SLOP = 20
#: Bytes of benchmark text broadcast at once.
SLICE_BYTES = 16 << 20
#: Tokens per index shard; a longer document is a shard of its own.
SHARD_TOKENS = 4 << 20

#: Bytes of words stay, A-Z become lower case, all others part words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

_INDEX = "shard long, term int, postings binary, width int, df long, rows array<long>, ids array<long>, lengths array<long>"
_FOUND = "row long, doc_id long, n_words long, spans array<int>, items array<string>, near array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split()


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in slices of at most ``limit`` bytes (or one item), streamed through the driver."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), raw_text().alias("text"))
    for item, text in rows.where(F.length("text") > 0).toLocalIterator():
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(("" if item is None else item, bytes(text)))
        size += len(text)
    if held:
        yield held


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], shard_tokens: int) -> DataFrame:
    """Postings per (shard, term), and per shard one row (term -1) with its documents.

    ``docs``: ``row`` (unique), ``doc_id``, ``text`` (binary). Positions count all words of a shard;
    documents are parted by a gap of ``WINDOW`` positions, so that no phrase crosses them.
    """
    spark = docs.sparkSession
    schema = arrow_schema(spark, _INDEX)
    shared = spark.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, task, serial = shared.value.get, TaskContext.get().partitionId(), 0
        parts, meta, base = [], [], 0

        def flush() -> pa.RecordBatch:
            shard = (task << 32) + serial
            term = np.concatenate([p[0] for p in parts])
            place = np.concatenate([p[1] for p in parts])
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else []
            out = {c: [] for c in schema.names}
            for a, b in zip(starts, [*starts[1:], len(term)]):
                gaps = np.diff(place[a:b], prepend=0)
                width = 1 if gaps.max() < 256 else 2 if gaps.max() < 65536 else 4
                blob = gaps.astype(f"<u{width}").tobytes()
                for c, v in zip(schema.names, (shard, int(term[a]), blob, width, int(b - a), None, None, None)):
                    out[c].append(v)
            rows, ids, lengths = zip(*meta)
            for c, v in zip(schema.names, (shard, -1, b"", 0, 0, rows, ids, lengths)):
                out[c].append(v)
            return table_of(out, schema)

        for batch in batches:
            columns = batch.to_pydict()
            for row, key, text in zip(columns["row"], columns["doc_id"], columns["text"]):
                words = words_of(text)
                ids = np.fromiter((find(w, -1) for w in words), np.int32, len(words))
                at = np.flatnonzero(ids >= 0)
                if meta and base + len(words) > shard_tokens:
                    yield flush()
                    parts, meta, base, serial = [], [], 0, serial + 1
                parts.append((ids[at], (at + base).astype(np.int64)))
                meta.append((row, key, len(words)))
                base += len(words) + WINDOW
        if meta:
            yield flush()

    return docs.mapInArrow(index, docs.sparkSession.createDataFrame([], _INDEX).schema)


def _windows(items: list[tuple[str, bytes]], size: int) -> tuple[dict[bytes, int], dict[tuple, list[str]]]:
    """Vocabulary, and each distinct window (as term numbers) with the items that have it."""
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple, list[str]] = {}
    for item, text in items:
        terms = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        for i in range(max(1, len(terms) - size + 1) if terms else 0):
            held = windows.setdefault(tuple(terms[i : i + size]), [])
            if not held or held[-1] != item:
                held.append(item)
    return vocabulary, windows


def search(index: DataFrame, windows: dict[tuple, list[str]], slop: int = 0) -> DataFrame:
    """One row per document and slice: words in exact phrase matches, items matched.

    ``slop`` > 0 adds ``near``: items of which some window has all its distinct terms within ``slop``
    consecutive words of the document (a proximity match, order free).
    """
    spark = index.sparkSession
    frequency = dict(index.where("term >= 0").groupBy("term").agg(F.sum("df")).toLocalIterator())
    asked = []
    for terms, items in windows.items():
        if all(t in frequency for t in terms):
            order = sorted(range(len(terms)), key=lambda i: (frequency[terms[i]], i))
            rare = list(dict.fromkeys(terms[i] for i in order)) if slop else []
            asked.append((terms, order, rare, items))
    shared = spark.sparkContext.broadcast(asked)

    def positions(frame: pd.DataFrame) -> dict[int, np.ndarray]:
        return {
            t: np.cumsum(np.frombuffer(b, f"<u{w}").astype(np.int64))
            for t, b, w in zip(frame["term"], frame["postings"], frame["width"])
            if t >= 0
        }

    def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
        at = np.searchsorted(among, values)
        at[at == len(among)] = 0
        return among[at] == values

    def close(lists: dict[int, np.ndarray], rare: list[int], begins: np.ndarray) -> np.ndarray:
        """Documents with all terms within ``slop`` words: from places of the rarest, stretches are tried at every start."""
        at = lists[rare[0]]
        for t in rare[1:]:
            other = lists.get(t, at[:0])
            first = np.searchsorted(other, at - slop, "right")
            at = at[first < np.searchsorted(other, at + slop)]
            if not len(at):
                return at
        start = np.unique(at[:, None] - np.arange(slop))
        low, high = np.full(len(start), np.iinfo(np.int64).max), np.full(len(start), -1)
        for t in rare:
            other = lists[t]
            i = np.searchsorted(other, start)
            place = other[np.minimum(i, len(other) - 1)]
            fits = (i < len(other)) & (place < start + slop)
            start, place = start[fits], place[fits]
            low, high = np.minimum(low[fits], place), np.maximum(high[fits], place)
        document = np.searchsorted(begins, low, "right") - 1
        return np.unique(document[document == np.searchsorted(begins, high, "right") - 1])

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        lists = positions(frame)
        meta = frame[frame["term"] < 0].iloc[0]
        lengths = np.asarray(meta["lengths"], np.int64)
        begins = np.r_[0, np.cumsum(lengths + WINDOW)]
        change = np.zeros(begins[-1] + 1, np.int32)
        items: dict[int, set] = {}
        near: dict[int, set] = {}
        for terms, order, rare, held in shared.value:
            found = lists.get(terms[order[0]])
            if found is None:
                continue
            found = found - order[0]
            for i in order[1:]:
                other = lists.get(terms[i])
                if other is None or not len(found):
                    found = found[:0]
                    break
                found = found[member(found + i, other)]
            if len(found):
                np.add.at(change, found, 1)
                np.add.at(change, found + len(terms), -1)
                for d in np.unique(np.searchsorted(begins, found, "right") - 1).tolist():
                    items.setdefault(d, set()).update(held)
            if slop:
                for d in close(lists, rare, begins).tolist():
                    near.setdefault(d, set()).update(held)
        covered = np.cumsum(change)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.r_[False, covered, False]))
        firsts, lasts = edges[::2], edges[1::2]
        owner = np.searchsorted(begins, firsts, "right") - 1
        spans: list[list[int]] = [[] for _ in lengths]
        for d, a, b in zip(owner.tolist(), firsts.tolist(), lasts.tolist()):
            spans[d] += [a - int(begins[d]), b - int(begins[d])]
        n = len(lengths)
        return pd.DataFrame(
            {
                "row": list(meta["rows"]),
                "doc_id": list(meta["ids"]),
                "n_words": lengths,
                "spans": spans,
                "items": [sorted(items.get(d, ())) for d in range(n)],
                "near": [sorted(near.get(d, ())) for d in range(n)],
            }
        )

    return index.groupBy("shard").applyInPandas(look, _FOUND)


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """One document's results of several slices as one."""
    spans = sorted((a, b) for s in frame["spans"] for a, b in zip(s[::2], s[1::2]))
    joined: list[list[int]] = []
    for a, b in spans:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out = frame.iloc[:1].copy()
    out["spans"] = [[x for pair in joined for x in pair]]
    out["items"] = [sorted({x for s in frame["items"] for x in s})]
    out["near"] = [sorted({x for s in frame["near"] for x in s})]
    return out


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int = 0,
    slice_bytes: int = SLICE_BYTES,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Per row of ``docs``: its words inside benchmark windows, and the items these come from.

    Returns ``row`` (the row's number), ``doc_id``, ``n_words``, ``spans`` (word positions: start, end,
    start, end ..., maximal and disjoint), ``items`` and ``near`` (item ids as strings, sorted; ``near``
    only with ``slop``, and then ``items`` of windows of at most ``slop`` words are in it too). A
    window is ``window`` consecutive words of an item (at most 10), or the whole of a shorter one.
    NULL and empty texts have no words; empty items match nothing; a repeated document row is
    reported as often as it occurs; items with the same id are one item. Columns other than ``doc_id``
    and ``text`` (``item_id`` and ``text``) are ignored. Empty tables give no matches.
    """
    rows = docs.select(key_of().alias("doc_id"), raw_text().alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    slices = _slices(benchmark, slice_bytes)
    first, second = next(slices, []), next(slices, None)
    if second is not None:  # every slice must see the same row numbers
        rows = cut_lineage(rows)
    later = itertools.chain([second] if second is not None else [], slices)
    parts = [_one_slice(rows, items, window, slop, shard_tokens) for items in itertools.chain([first], later)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if len(parts) > 1:
        found = found.groupBy("row").applyInPandas(_merge, _FOUND)
    return found.withColumn("doc_id", id_of("doc_id"))


def _one_slice(rows: DataFrame, items: list, window: int, slop: int, shard_tokens: int) -> DataFrame:
    vocabulary, windows = _windows(items, window)
    return search(cut_lineage(build_index(rows, vocabulary, shard_tokens)), windows, slop)


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0, **options) -> DataFrame:
    """The digest of ``benchmark_matches`` per row of ``docs``; with ``slop`` also of the proximity matches."""
    found = benchmark_matches(docs, benchmark, slop=slop, **options)
    near = [F.size("near").cast("long").alias("n_near"), F.sha2(F.concat_ws(",", "near"), 256).alias("near_sha256")]
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(
            F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        *(near if slop else []),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window; all columns stay as they are."""
    marked = docs.select(row_mark(docs).alias("doc_id"), "text")
    found = benchmark_matches(marked, benchmark, **options).where(F.size("items") > 0)
    return without_marks(docs, cut_lineage(found.select("doc_id")))
