"""Near-duplicates, repeated passages and benchmark matches against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from corpora import PASSAGE
from hypothesis import given, settings
from hypothesis import strategies as st

from panelsmith.llm import decontaminate, simhash, suffix_dedup
from panelsmith.llm.collection_bwt import Collection
from panelsmith.llm.graph import components


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints):
    """Least id of the component per print."""
    distinct = sorted(set(prints.values()) if isinstance(prints, dict) else set(prints))
    values = np.array(distinct, np.uint64)
    label = list(range(len(distinct)))
    for i in range(len(distinct)):
        close = np.unpackbits((values ^ values[i]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) <= 2
        for j in np.flatnonzero(close).tolist():
            old, new = label[j], label[i]
            if old != new:
                label = [new if x == old else x for x in label]
    return dict(zip(distinct, label))


def check_near(rows, texts):
    prints = {t: fingerprint(t) for _, t in texts}
    label = reachable(prints)
    least = {}
    for doc, text in texts:
        key = 2**63 if doc is None else doc
        group = label[prints[text]]
        least[group] = min(least.get(group, key), key)
    expected = Counter()
    for doc, text in texts:
        group = least[label[prints[text]]]
        expected[doc, f"{prints[text]:016x}", None if group == 2**63 else group] += 1
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == expected


def test_near_duplicates_odd(odd, odd_rows):
    check_near(simhash.near_duplicates(odd).collect(), odd_rows)


def test_near_duplicates_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    check_near(simhash.near_duplicates(docs).collect(), [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_connect_all_close_prints(spark, tile):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {int(c) for c in centre}
    for c in centre.tolist():
        for _ in range(60):
            v = c
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                v ^= 1 << b
            prints.add(v)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), tile=tile)
    joined = defaultdict(set)
    for r in components(links).collect():
        joined[r["root"]].add(r["node"] % 2**64)
        joined[r["root"]].add(r["root"] % 2**64)
    expected = defaultdict(set)
    for p, k in reachable(prints).items():
        expected[k].add(p)
    assert sorted(map(sorted, joined.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_one_per_component(odd, odd_rows, empty_documents):
    kept = simhash.one_per_component(odd)
    assert kept.columns == odd.columns
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == sorted(
        {d for d, c in found if d is not None and d == c}
    )
    assert simhash.one_per_component(empty_documents).count() == 0


BYTES = st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(1 + x % 3 for x in b)), min_size=1, max_size=14)


@settings(max_examples=150, deadline=None)
@given(BYTES, st.sampled_from([1, 2, 5, 1000]), st.sampled_from([3, 50]))
def test_collection_transform(strings, block, limit):
    """Order, symbols and common prefixes of all suffixes, for any block size."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    made = Collection(text, np.cumsum([len(s) for s in strings]), limit, block).build()
    parts = [(b, p) for _, b, p in made._blocks()]
    bwt, lcp = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    suffix = {i: (i, 0) for i in range(len(strings))}
    for length, which, places in made.suffix_places():
        suffix |= {int(p): (int(s), length) for s, p in zip(which, places)}
    assert len(suffix) == made.size == len(text) + len(strings)
    listed = [strings[s][len(strings[s]) - n :] for s, n in (suffix[i] for i in range(made.size))]
    assert listed == sorted(listed)
    for i, (s, n) in sorted(suffix.items()):
        assert bwt[i] == (strings[s][len(strings[s]) - n - 1] if n < len(strings[s]) else 0)
        if i:
            common = next((k for k, (a, b) in enumerate(zip(listed[i - 1], listed[i])) if a != b), min(len(listed[i - 1]), len(listed[i])))
            assert lcp[i] == min(common, limit)


@pytest.mark.parametrize("block", [1 << 17, 1 << 19, 1 << 20])
def test_collection_of_many_symbols(block):
    """More symbols than fit a word beside a place of the block; in blocks of any size the transform is the same."""
    rng = np.random.default_rng(2)
    text = rng.integers(1, 90_000, 40_000)
    text[20_000:30_000] = text[:10_000]
    ends = np.sort(np.r_[rng.choice(np.arange(1, 40_000), 4_000, replace=False), 40_000])

    def columns(size):
        blocks = [b[1:] for b in Collection(text, ends, 5, size).build()._blocks()]
        return [np.concatenate(c) for c in zip(*blocks)]

    one, other = columns(1 << 12), columns(block)
    assert len(one[0]) == 44_000 and all((x == y).all() for x, y in zip(one, other))


def check_passages(rows, texts):
    first = {}
    order = [(2**63 if d is None else d, d, (t or "").encode()) for d, t in texts]
    for key, _, raw in order:
        for a in range(len(raw) - 49):
            s = raw[a : a + 50]
            first[s] = min(first.get(s, key), key)
    expected = Counter()
    for key, doc, raw in order:
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49):
            if first[raw[a : a + 50]] < key:
                gone[a : a + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        expected[doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == expected
    return sum(n for _, _, n, _, _ in expected)


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_passages_odd(odd, odd_rows, shard_bytes):
    assert check_passages(suffix_dedup.repeated_passages(odd, shard_bytes).collect(), odd_rows) > 0


def test_passages_documents(spark, small, monkeypatch):
    """Small shards and tasks, and a low bound for common values, so that every path runs."""
    monkeypatch.setattr(suffix_dedup, "DIVERSE", 1)
    monkeypatch.setattr(suffix_dedup, "COMMON", 3)
    monkeypatch.setattr(suffix_dedup, "ANCHORS_PER_TASK", 5_000)
    monkeypatch.setattr(suffix_dedup, "SYMBOLS_PER_TASK", 50_000)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = suffix_dedup.repeated_passages(docs, shard_bytes=30_000).collect()
    assert check_passages(rows, [tuple(r) for r in docs.collect()]) > 0


def test_strings_with_a_lone_anchor_are_not_sorted(monkeypatch):
    """Segments of one anchor amid other text: the transform gets the shared strings only, the answers are the same."""
    rng = np.random.default_rng(5)

    def noise(n):
        return rng.integers(97, 123, n, np.uint8).tobytes()

    shared, anchor, wave = noise(55), noise(16), b"ab" * 40
    pieces = [noise(15) + shared + noise(15), noise(9) + shared + noise(21), *(noise(34) + anchor + noise(34) for _ in range(200)), wave, wave[1:]]
    ids = [7, 4, *range(10, 210), 3, 2]
    sizes, build = [], Collection.build
    monkeypatch.setattr(Collection, "build", lambda self: sizes.append(len(self.text)) or build(self))
    blobs = [suffix_dedup._pack(np.array([len(p) - 49], "u1"), np.array([i]), np.frombuffer(p, np.uint8)) for p, i in zip(pieces, ids)]
    rows = suffix_dedup._row_frame([(k, 0, k, b) for k, b in enumerate(blobs)])
    first = {}
    for piece, i in zip(pieces, ids):
        for a in range(len(piece) - 49):
            first[piece[a : a + 50]] = min(i, first.get(piece[a : a + 50], i))
    replies = {}
    for k, body in suffix_dedup._classify(rows)[["shard", "body"]].itertuples(index=False):
        _, lengths, values = suffix_dedup._unpack(body, "u1", "<u4", "i8")
        replies[k] = np.repeat(values, lengths).tolist()
    expected = {k: [first[p[a : a + 50]] for a in range(len(p) - 49)] for k, p in enumerate(pieces)}
    assert replies == {k: e for k, e in expected.items() if set(e) != {ids[k]}} and len(replies) == 2
    assert sum(sizes) < 0.05 * sum(map(len, pieces))
    sizes.clear()
    assert suffix_dedup._classify(rows.iloc[2:9]).empty and not sizes


def test_without_repeats(odd, odd_rows, empty_documents):
    cleaned = suffix_dedup.without_repeats(odd)
    assert cleaned.schema == odd.schema and cleaned.count() == odd.count()
    lost = [r["n_removed"] for r in suffix_dedup.repeated_passages(odd).collect()]
    assert sum(lost) == sum(len((t or "").encode()) for _, t in odd_rows) - sum(
        len(r["text"].encode()) for r in cleaned.select("text").collect()
    )
    assert suffix_dedup.without_repeats(empty_documents).count() == 0
    assert suffix_dedup.repeated_passages(empty_documents).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def check_matches(rows, texts, items):
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add(str(item))
    expected = Counter()
    for doc, text in texts:
        words, found = words_of(text), set()
        hit = np.zeros(len(words), bool)
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                held = windows.get(tuple(words[i : i + size]))
                if held:
                    hit[i : i + size] = True
                    found |= held
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected[doc, len(words), int(hit.sum()), len(found), digest, bool(hit.any())] += 1
    assert Counter(tuple(r) for r in rows) == expected
    return sum(e[2] for e in expected)


def odd_items(spark):
    rows = [(1, PASSAGE), (2, "na na na"), (3, None), (4, ""), (5, f"{PASSAGE} more"), (10, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (11, "zzz nowhere")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 120, "shard_tokens": 50}])
def test_matches_odd(spark, odd, odd_rows, options):
    items, table = odd_items(spark)
    rows = decontaminate.contamination(odd, table, **options).collect()
    assert check_matches(rows, odd_rows, items) > 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "gamma x beta y alpha"), (2, "alpha " + "z " * 30 + "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    found = {r["doc_id"]: (r["items"], r["near"]) for r in decontaminate.benchmark_matches(docs, items, slop=6).collect()}
    assert found == {1: ([], ["i"]), 2: ([], [])}


def test_clean_documents(spark, odd, empty_documents):
    _, table = odd_items(spark)
    cleaned = decontaminate.clean_documents(odd, table)
    assert cleaned.schema == odd.schema
    ids = [r["doc_id"] for r in cleaned.select("doc_id").collect()]
    assert sorted(str(i) for i in ids) == sorted(["2", "3", "5", "6", "7", "8"])
    assert decontaminate.clean_documents(empty_documents, table).count() == 0
    assert decontaminate.clean_documents(odd, table.limit(0)).count() == odd.count()
