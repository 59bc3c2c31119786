"""Hash tree, vector codes and source mix against brute force, on odd tables and on the test tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpora import CLASHING
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsmith.llm import merkle, mixing, places, vector_codes

# --- hash tree ---------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(nodes):
    """Levels of a tree, from its leaves to the single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, i, node):
    """What becomes of ``node`` in the place of leaf i, and the siblings on the way."""
    seen = ""
    for level in levels[:-1]:
        a = i // 8 * 8
        left, right = "".join(level[a:i]), "".join(level[i + 1 : a + 8])
        node, seen, i = sha(left + node + right), seen + left + right, i // 8
    return node, seen


def expected_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row["lang"]].append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        built[name] = tree_of([leaf_of(r) for r in trees[name]])
    top = tree_of([built[n][-1][0] for n in names])
    root = top[-1][0]
    out = Counter()
    for k, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            shown = row
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                shown = {**row, "text": re.sub("[A-Z]", lambda m: m[0].lower(), row["text"])}
            sub, inner = climb(built[name], i, leaf_of(shown))
            folded, outer = climb(top, k, sub)
            out[row["doc_id"], leaf_of(row), built[name][-1][0], root, sha(inner + outer), folded, folded == root] += 1
    return out


def check_manifest(docs):
    rows = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.tampered_manifest(docs).collect()
    assert got[0].__fields__ == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] if got else not rows
    assert Counter(tuple(r) for r in got) == expected_manifest(rows)


def test_manifest_odd(odd):
    check_manifest(odd.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(c) for c in ("tree", "place", "total", "node", "id")}))


def test_manifest_documents(spark, small):
    check_manifest(spark.read.parquet(f"{small}/documents.parquet"))


@pytest.mark.parametrize("n, langs", [(1, 1), (2, 2), (9, 1), (700, 2), (5000, 3), (1300, 1300)])
def test_manifest_sizes(spark, n, langs):
    """Trees of one leaf, of one and of several passes; as many branches as rows; the same id on every row."""
    docs = spark.range(0, n, 1, 7).select(
        F.when(F.col("id") % 11 > 0, F.col("id") % 900).alias("doc_id"),
        F.concat(F.lit("Text "), F.col("id") % 50).alias("text"),
        F.when(F.col("id") % langs > 0, F.concat(F.lit("l"), F.col("id") % langs)).alias("lang"),
        F.lit("s").alias("source"),
        F.lit(None).cast("long").alias("n_chars"),
    )
    check_manifest(docs)


def test_manifest_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.tampered_manifest(empty).count() == 0


def test_proofs_fold(spark, small):
    """A proof holds for its leaf and for no other."""
    rows = merkle.manifest(merkle.leaves(spark.read.parquet(f"{small}/documents.parquet"))).collect()
    for row in rows[:40]:
        proof = row["siblings"], row["lefts"], row["others"]
        assert merkle.fold(row["leaf"], *proof) == row["root"] == row["folded_root"]
        assert merkle.fold(sha("another"), *proof) != row["root"]


def test_places(spark):
    """One group with most rows, over more partitions than groups."""
    rows = spark.range(0, 4000, 1, 16).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 4000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = places.with_places(rows, ["g"], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["place"], r["v"], r["total"]))
    assert sum(map(len, by.values())) == 4000
    for found in by.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [v for _, v, _ in found] == sorted(v for _, v, _ in found)
        assert {t for _, _, t in found} == {len(found)}


# --- vector codes ------------------------------------------------------------------------------


def expected_codes(rows):
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((2**63 if vec_id is None else vec_id, [math.floor(4096 * x) for x in vector], vec_id, label))
    kept.sort(key=lambda r: r[:2])
    w = len(kept[0][1]) // 8
    parts = [[r[1][p * w : p * w + w] for r in kept] for p in range(8)]
    codes, errors, numbers = [""] * len(kept), [0] * len(kept), []
    for p in range(8):
        book = [list(x) for x in parts[p][:16]]
        for step in range(7):
            best = [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in parts[p]]
            if step < 6:
                for k in range(len(book)):
                    own = [x for x, (_, at) in zip(parts[p], best) if at == k]
                    if own:
                        book[k] = [sum(c) // len(own) for c in zip(*own)]
        for i, (d, k) in enumerate(best):
            codes[i] += f"{k:02x}"
            errors[i] += d
        numbers += [x for e in book for x in e]
    labels = Counter()
    for r, e in zip(kept, errors):
        labels[r[3]] += e
    digest = sha(",".join(map(str, numbers)))
    return Counter((r[2], c, e, labels[r[3]], digest) for r, c, e in zip(kept, codes, errors))


def check_codes(df):
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    got = vector_codes.compress(df).collect()
    assert Counter(tuple(r) for r in got) == expected_codes(rows)


def test_codes_embeddings(spark, small):
    check_codes(spark.read.parquet(f"{small}/embeddings.parquet"))


@pytest.mark.parametrize("n, width, spread", [(5, 8, 1.0), (40, 16, 0.002), (300, 8, 0.001), (300, 24, 3.0)])
def test_codes_odd(spark, n, width, spread):
    """Few vectors, many ties, repeated rows and ids, NULL ids and labels, vectors that are left out, own columns."""
    rng = np.random.default_rng(n + width)
    rows = [(i if i % 17 else None, [float(np.float32(x)) for x in rng.normal(0, spread, width)], int(i % 3) or None) for i in range(n)]
    rows += [rows[0], rows[-1], (2, rows[1][1], 9)]
    good = [1.0] * width
    rows += [(-5, None, 1), (-4, [None, *good[1:]], 1), (-3, [math.nan, *good[1:]], 1), (-2, [-math.inf, *good[1:]], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    check_codes(df.withColumns({c: F.lit(c) for c in [*CLASHING, "v", "id", "codes", "error", "sums"]}).repartition(5))


def test_codes_defined(spark):
    """Empty tables, no usable vector, other lengths, and numbers beyond all bounds."""
    shape = "vec_id long, embedding array<double>, label int"
    assert vector_codes.compress(spark.createDataFrame([], shape)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [1.0] * 9, 1)], shape)).count() == 0
    rows = [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), (3, [0.5] * 8, 1), (0, [1.0] * 16, 1), (4, [1.0] * 7, 1)]
    assert {r["vec_id"] for r in vector_codes.compress(spark.createDataFrame(rows, shape)).collect()} == {1, 2, 3}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12), st.integers(1, 4), st.integers(1, 30))
def test_ball_assignment_is_exact(seed, k, w, size):
    rng = np.random.default_rng(seed)
    x, entries = rng.integers(-size, size, (200, w)), rng.integers(-size, size, (k, w))
    own = rng.integers(0, k, 200)
    at, best, _ = vector_codes.ball_nearest(x, entries, own)
    expected, distance = vector_codes.nearest(x, entries)
    assert (at == expected).all() and (best == distance).all()


def test_balls_save_work():
    """Parts near their entries are compared with few others."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-4000, 4000, (16, 8))
    own = rng.integers(0, 16, 5000)
    x = entries[own] + rng.integers(-600, 600, (5000, 8))
    own, _ = vector_codes.nearest(x, entries)
    assert vector_codes.ball_nearest(x, entries, own)[2] < 5000 * 16 / 4


# --- source mix --------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.floats(0, 40))
def test_closest_subset(items, target):
    lengths, counts = zip(*items)
    taken = mixing.closest_subset(list(lengths), list(counts), target)
    assert all(0 <= t <= n for t, n in zip(taken, counts))
    sums = [sum(n * c for n, c in zip(lengths, each)) for each in itertools.product(*(range(c + 1) for c in counts))]
    got = sum(n * t for n, t in zip(lengths, taken))
    assert abs(got - target) <= min(abs(s - target) for s in sums) + (0.5 if abs(got - target) <= 0.5 else 0)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 3000), st.integers(1, 400), min_size=1, max_size=60), st.floats(0, 1), st.sampled_from([0, 50, 65536]))
def test_fit(items, share, window):
    lengths, counts = list(items), list(items.values())
    total = sum(n * c for n, c in items.items())
    taken = mixing.fit(lengths, counts, share * total, window)
    assert all(0 <= t <= n for t, n in zip(taken, counts))
    # no single document put in or taken out comes nearer
    off = sum(n * t for n, t in zip(lengths, taken)) - share * total
    assert abs(off) <= max(lengths)


def check_mix(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, weight = total - sum(3 * sizes[s] for s in full), sum(weights[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weights[s] * rest > 3 * sizes[s] * weight}
        if not more:
            break
        full |= more
    goal = {s: 3.0 * sizes[s] if s in full else weights[s] * rest / weight if weight else 0.0 for s in names}
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((r["doc_id"], size(r["text"]), r["source"]) for r in rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(0.5, longest[s] / 2 + 0.5), s
    return got, taken, goal


def test_mix_odd(odd):
    check_mix(odd.withColumns({c: F.lit(c) for c in ("size", "place", "total", "n", "rounds", "more", "target")}))


def test_mix_documents_and_reruns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got, taken, goal = check_mix(docs)
    again = mixing.mix(docs.repartition(13, "text")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_meets_targets(spark):
    """Many documents of few lengths, one source with most of them: every target is met to the word."""
    docs = spark.range(0, 3000, 1, 6).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 13 + 1).cast("int"))).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    _, taken, goal = check_mix(docs)
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)


def test_mix_defined(spark):
    shape = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], shape)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], shape)).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
