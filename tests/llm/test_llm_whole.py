"""Inputs on which a cheaper path gave less than the whole result.

Workers import the modules anew, so patched bounds would not reach them: the inputs meet the real ones.
"""

import numpy as np
import pytest
from test_llm_duplicates import check_passages

from panelsmith.llm import decontaminate, queries, simhash, suffix_dedup, toxicity


def low_bytes(n):
    """Characters whose runs have the least anchor hashes, so that their segments reach into the neighbours."""
    chars = [chr(c) for c in range(32, 127)]
    runs = [np.frombuffer(c.encode() * suffix_dedup.ANCHOR, np.uint8) for c in chars]
    return [c for _, c in sorted((int(suffix_dedup._anchor_hash(r)[0]), c) for r, c in zip(runs, chars))][:n]


def ruled_documents(bytes_, lengths, copies):
    """Runs of equal bytes, each between neighbours of its own."""
    rng = np.random.default_rng(7)
    rows = []
    for n in lengths:
        for b in bytes_:
            for _ in range(copies):
                left, right = ("".join(rng.choice(list("ghijklmnopqr"), 40)) for _ in range(2))
                rows.append((len(rows), f"{left}{b * n}{right}"))
    return rows


def test_passages_one_byte_runs(spark):
    rows = ruled_documents(low_bytes(2), [24, 25, 30, 33, 40, 48, 49, 50, 57, 58, 75, 82, 83, 120, 300], 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert check_passages(suffix_dedup.repeated_passages(docs, 9_000).collect(), rows) > 0


def test_passages_common_line(spark, tmp_path, monkeypatch):
    """A line in very many documents, each time between other texts: no task gets all strings around it."""
    rng = np.random.default_rng(8)
    line = "".join(rng.choice(list("ABCDEFGH"), 44))
    noise = rng.choice(list("ghijklmnopqr"), (9_000, 40))
    rows = [(k, f"{''.join(n[:20])}{line}{''.join(n[20:])}") for k, n in enumerate(noise)]
    rows += [(9_000 + k, rows[k][1][:60]) for k in range(0, 9_000, 3)]
    classify, folder = suffix_dedup._classify, str(tmp_path)

    def watched(frame):
        import os

        strings = sum(len(suffix_dedup._unpack(b, "u1", "i8", "u1")[2]) for b in frame["body"])
        open(f"{folder}/{strings}_{os.urandom(8).hex()}", "w").close()
        return classify(frame)

    monkeypatch.setattr(suffix_dedup, "_classify", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert check_passages(suffix_dedup.repeated_passages(docs, 60_000).collect(), rows) > 0
    sizes = [int(f.name.split("_")[0]) for f in tmp_path.iterdir()]
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_one_row_per_component(spark):
    """Rows without ids, ids with two texts, rows equal but for the place of a NULL."""
    a, b, c, d, e = (" ".join(f"{w}{k}" for k in range(30)) for w in "abcde")
    rows = [(1, a, "x"), (None, a, "x"), (None, a, "y"), (None, b, "x"), (None, b, "y"), (None, c, None), (None, None, c)]
    rows += [(7, d, "x"), (7, e, "x"), (7, e, "x"), (8, e, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = simhash.one_row_per_component(docs)
    assert kept.schema == docs.schema
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(1, a), (None, b), (None, c), (None, None), (7, d), (7, e)], key=str)


LEXICON = {("idiot", False): 3.0, ("moron", False): 2.5, ("trash", True): 2.0}


def test_context_of_all_hits():
    """Words between hits part them; each pair within the context counts, also after the 50th hit."""
    reader = toxicity.Reader(LEXICON)
    words = ["idiot"] * 70 + ["fine"] * 40 + ["idiot", "fine", "moron"] * 40
    places = [i for i, w in enumerate(words) if w != "fine"]
    beside = sum(i != j and abs(i - j) <= toxicity.CONTEXT for i in places for j in places)
    assert reader.features(" ".join(words).encode())[7] == pytest.approx(np.log1p(beside))


def test_terms_with_inner_signs():
    def found(text):
        direct, quoted, near, near_quoted, *_ = toxicity.Reader(LEXICON).features(text.encode())
        return [round(float(np.expm1(v)), 6) for v in (direct, quoted, near, near_quoted)]

    for word, weight in [("id1ot", 3), ("m0ron", 2.5), ("tr*sh", 2), ("tr_shy", 2), ("idi.ot", 3), ("an-id1ot-like", 3)]:
        assert found(f"you {word} there") == [0, 0, weight, 0], word
    assert found('they said "you id1ot there" to me') == [0, 0, 0, 3]
    assert found("well-known idiot-like id2l2ot") == [3, 0, 0, 0]
    assert found("fine " * 20 + "id1ot m0ron idiot") == [3, 0, 5.5, 0]


@pytest.mark.parametrize(("slop", "options"), [(6, {}), (12, {"slice_bytes": 60, "shard_tokens": 100}), (20, {})])
def test_proximity_matches(spark, slop, options):
    rng = np.random.default_rng(slop)
    texts = [(k, " ".join(rng.choice(list("abcdefghijklmnop"), rng.integers(0, 60)))) for k in range(150)]
    texts.append((150, "x " * 10 + "q " * 4 + "r " + "s " + "x " * 4))
    items = [(str(k), " ".join(rng.choice(list("abcdefghijklmnopxqrs"), rng.integers(1, 16)))) for k in range(25)]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    expected = {}
    for doc, text in texts:
        words = text.split()
        stretches = [set(words[i : i + slop]) for i in range(max(1, len(words) - slop + 1))]
        expected[doc] = sorted(
            item
            for item, t in items
            if any(set(t.split()[i : i + 10]) <= s for i in range(max(1, len(t.split()) - 9)) for s in stretches)
        )
    found = decontaminate.benchmark_matches(docs, table, slop=slop, **options).collect()
    assert {r["doc_id"]: r["near"] for r in found} == expected
    assert any(expected.values())


def test_proximity_query(spark, small):
    found = queries.op10(spark, small)
    assert found.columns[-2:] == ["n_near", "near_sha256"]
    assert found.where("n_near < n_items").count() == 0
