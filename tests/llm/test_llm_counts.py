"""Packing, token counts and quality rules against direct computation."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsmith.llm import packing, quality_rules, wordpiece


def true_ids(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    whole = true_ids.__dict__.setdefault("tokenizer", Tokenizer.from_file(path))
    return whole.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab Zé1'.,!\n\t  \x00\U0001f600s")), max_size=40))
def test_ids_equal_the_tokenizer(text):
    assert np.frombuffer(packing._encoder("byte_bpe_50k").encode(text), "<u4").tolist() == true_ids(text)[:-1]


def test_a_text_is_encoded_in_one_call():
    encoder, calls = packing.ByteBpe(), []
    whole = encoder._encode
    encoder._encode = lambda text: calls.append(text) or whole(text)
    text = "one two  three\nfour Z\u00e9 " + "word " * 500 + "end"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == true_ids(text)[:-1]
    assert np.frombuffer(encoder.encode("a plain text"), "<u4").tolist() == true_ids("a plain text")[:-1]
    assert calls == [text, "a plain text"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.first_fit_decreasing(lengths, 64)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [b for b, room in enumerate(rooms) if room >= lengths[i]]
        if not fits:
            rooms.append(64)
        b = fits[0] if fits else len(rooms) - 1
        assert (bins[i], offsets[i]) == (b, 64 - rooms[b])
        rooms[b] -= lengths[i]


def check_packed(rows, texts):
    """Every id in one piece, pieces in gapless sequences."""
    expected = Counter()
    for doc, text in texts:
        ids = true_ids(text)
        for at in range(0, len(ids), 1024):
            piece = ids[at : at + 1024]
            expected[doc, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert got == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_odd(odd, odd_rows):
    check_packed(packing.pack(odd, group=8).collect(), odd_rows)


def test_packing_fills(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    full = sum(r["length"] for r in rows) / (1024 * len({r["sequence_id"] for r in rows}))
    assert full > 0.97


def test_packing_keeps_ids(odd):
    for r in packing.pack(odd, keep_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_empty_tables(empty_documents):
    assert packing.pack(empty_documents).count() == 0
    assert quality_rules.judge(empty_documents).count() == 0
    path = packing.tokenizer_path("byte_bpe_50k.json")
    assert wordpiece.token_counts(empty_documents, path).count() == 0


def greedy(word, opening, inner):
    pieces, at = 0, 0
    while at < len(word):
        listed = inner if at else opening
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in listed), 0)
        if not size:
            return 1
        at, pieces = at + size, pieces + 1
    return pieces


WORDS = st.text("abc", min_size=1, max_size=4)


@settings(max_examples=400, deadline=None)
@given(st.sets(WORDS, max_size=8), st.sets(WORDS, max_size=8), st.text("abc", max_size=12))
def test_longest_match(opening, inner, word):
    opening, inner, word = {w.encode() for w in opening}, {w.encode() for w in inner}, word.encode()
    assert wordpiece.LongestMatch(opening, inner).count(word) == greedy(word, opening, inner)


def test_token_counts_odd(odd, odd_rows):
    path = packing.tokenizer_path("byte_bpe_50k.json")
    opening, inner = map(set, wordpiece.word_pieces(path))
    counted = {}
    expected = Counter()
    for doc, text in odd_rows:
        words = (text or "").encode().split()
        for w in set(words):
            counted.setdefault(w, greedy(w, opening, inner))
        expected[doc, len(words), sum(counted[w] for w in words)] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in wordpiece.token_counts(odd, path).collect())
    assert got == expected


def base_counts(text):
    import re

    word = r"[^\x20\x09-\x0D]+"
    words = re.findall(word, text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    lines = [x for x in text.split("\n") if re.search(word, x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_rules_odd(odd, odd_rows):
    rows = quality_rules.judge(odd).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter(
        (d, *base_counts(t or "")) for d, t in odd_rows
    )
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_rules_drop_outliers(spark):
    rng = np.random.default_rng(1)

    def text(i):
        return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(80))

    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(900)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in text(i).split()), "en", "s0") for i in range(20)]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] for i in range(900)) and not any(kept[1000 + i] for i in range(20))


def test_sketches_merge(spark):
    """Counts added over parts give the sketch of the whole, and quartiles within one bucket."""
    values = np.random.default_rng(2).integers(0, 5000, 4000).tolist()
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v long, part int")
    whole = quality_rules.sketches(df, ["v"], [])
    parts = quality_rules.sketches(df, ["v"], ["part"]).groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    key = lambda r: (r["measure"], r["bucket"], r["n"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, parts.collect()))
    q = quality_rules.quartiles(whole, []).first()
    for got, p in ((q["q1"], 0.25), (q["q3"], 0.75)):
        assert got == pytest.approx(np.quantile(values, p, method="inverted_cdf"), rel=1 / 32)
