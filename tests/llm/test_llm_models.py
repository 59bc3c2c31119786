"""Language identification, quality, toxicity and chat roles: parts against direct computation, the
whole by held-out accuracy."""

import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsmith.llm import chat_roles, langid, quality, toxicity
from panelsmith.llm.places import with_places

LABELS = "doc_id long, quality int, toxic int"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- language ----------------------------------------------------------------------------------


def test_declared_codes(spark):
    tags = [(t,) for t in ("en", "EN-us", " de_AT ", "eng", "e", "", None, "en us", "x-en")]
    rows = spark.createDataFrame(tags, "t string").select("t", langid.code_of(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == {
        "en": "en", "EN-us": "en", " de_AT ": "de", "eng": None, "e": None, "": None, None: None, "en us": None, "x-en": None
    }


def test_language_by_text_alone(spark):
    """Declarations that are missing or wrong are recovered from the text and the host."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    spoilt = docs.withColumn(
        "lang",
        F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 17 == 0, F.lit("fr")).otherwise(F.col("lang")),
    )
    found = langid.identify(langid.document_evidence(spoilt, "doc_id")).join(docs, "doc_id")
    rows = found.where("length(text) > 40").select("lang", "language", "kept", "confidence").collect()
    assert np.mean([r["lang"] == r["language"] for r in rows]) > 0.97
    assert np.mean([r["kept"] for r in rows]) > 0.97
    assert all(0 <= r["confidence"] <= 1 for r in rows)


def test_host_prior_decides_short_texts(spark):
    rows = [("ab cd ef gh", "en", "h1")] * 40 + [("uv wx yz st", "de", "h2")] * 40
    rows += [("mm", None, "h1"), ("mm", None, "h2")]
    df = spark.createDataFrame(rows, "text string, declared string, host string").withColumn("suffix", F.lit("org"))
    found = langid.identify(df.withColumn("at", F.col("host"))).where("text_language is not null").collect()
    assert {(r["at"], r["language"]) for r in found} == {("h1", "en"), ("h2", "de")}


def test_language_odd(spark, odd, empty_documents):
    found = langid.identify(langid.document_evidence(odd, "doc_id")).collect()
    assert len(found) == odd.count() and not any(r["kept"] for r in found if r["language"] is None)
    none = langid.identify(langid.document_evidence(odd.withColumn("lang", F.lit("?")))).collect()
    assert len(none) == odd.count() and not any(r["kept"] for r in none)  # no declaration, no model
    known = odd.unionByName(table_like(spark, odd))
    found = langid.identify(langid.document_evidence(known, "doc_id"))
    silent = found.where("language is null").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in silent) == [2, 3, 6]
    kept = langid.identified_documents(known)
    assert kept.schema == known.schema and kept.count() == found.where("kept").count()
    assert langid.identify(langid.document_evidence(empty_documents)).count() == 0
    assert langid.identified_documents(empty_documents).count() == 0


def table_like(spark, odd):
    texts = [("en", "the house of the people and the words that they know"), ("de", "das haus der leute und die worte die sie kennen")]
    rows = [(100 + i, f"{texts[i % 2][1]} {i}", texts[i % 2][0], "s9") for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.select(*[F.col(c) if c in made.columns else F.lit(None).cast("string").alias(c) for c in odd.columns])


def test_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found = langid.identify(langid.page_evidence(pages)).join(pages, "page_id")
    rows = found.select("language", F.regexp_extract("html", 'lang="(..)"', 1).alias("lang")).collect()
    assert np.mean([r["language"] == r["lang"] for r in rows]) > 0.95


# --- quality and toxicity ----------------------------------------------------------------------


@pytest.mark.parametrize(("module", "label", "folds", "held"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out(spark, module, label, folds, held):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = module.score(docs, labels)
    rows = scored.join(labels, "doc_id").select("held_out", "score", "predicted", label).collect()
    assert scored.count() == docs.count()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held
    assert scored.where(F.col("held_out") != fold).count() == 0
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == r[label] for r in rows if r["held_out"]]) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_odd(spark, module, odd, empty_documents):
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (7, 1, 0), (77, 0, 1)], LABELS)
    for labels in (none, one):
        rows = module.score(odd, labels).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
        assert all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(empty_documents, one).count() == 0


def test_preferences_rank():
    """A feature that separates gets the weight, and the threshold keeps the share of good ones."""
    rng = np.random.default_rng(0)
    y = (np.arange(400) % 4 > 0).astype(float)
    x = rng.normal(size=(400, quality.N_FEATURES))
    x[:, 3] += 5 * y
    ranking = quality.Ranking(x, y, pairs=5000)
    assert np.argmax(np.abs(ranking.weights)) == 3
    assert np.mean((ranking.score(x) >= quality.THRESHOLD) == y) > 0.95


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, z in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != z))
    return row[-1]


TERMS = st.dictionaries(st.tuples(st.text("abc", min_size=1, max_size=6), st.booleans()), st.floats(1, 9), max_size=6)


@settings(max_examples=400, deadline=None)
@given(TERMS, st.text("abcd", min_size=1, max_size=9))
def test_automaton_finds_terms_within_one_edit(lexicon, word):
    exact = near = 0.0
    for (term, stem), weight in lexicon.items():
        heads = [word[:k] for k in range(1, len(word) + 1)] if stem else [word]
        if term in heads:
            exact = max(exact, weight)
        if len(term) >= toxicity.FUZZY_FROM and any(edits(term, h) == 1 for h in heads):
            near = max(near, weight)
    got = toxicity.TermTrie(lexicon).hits(word)
    assert got[0] == exact and (got[1] == near or got[1] >= near and exact)
    met = toxicity.Reader(lexicon)
    met.features(word.encode())
    assert (met._look(word) if len(word) <= toxicity.HEAD or met._heads[word[: toxicity.HEAD]] else None) == (got if any(got) else None)


def test_quotation_counts_apart():
    reader = toxicity.Reader({("idiot", False): 5.0})
    plain, quoted = reader.features(b"you idiot there"), reader.features(b'they said "idiot" there')
    assert plain[0] > 0 == plain[1] and quoted[1] > 0 == quoted[0]
    assert reader.features("one idiott more".encode())[2] > 0
    assert reader.features(b"")[:8] == [0.0] * 8


# --- chat --------------------------------------------------------------------------------------


def test_chat_roles_are_recovered(spark, small, monkeypatch):
    monkeypatch.setattr(chat_roles, "CHUNK", 4)  # long conversations pass several levels
    chats = table(spark, small, "conversations")
    hidden = chats.withColumn(
        "role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0, None).otherwise(F.col("role"))
    )
    found = chat_roles.format_chats(hidden).where("piece = 0").withColumnRenamed("role", "found")
    rows = chats.join(found.select("conv_id", "turn", "found"), ["conv_id", "turn"]).collect()
    assert len(rows) == chats.count()
    assert np.mean([r["role"] == r["found"] for r in rows]) > 0.95


def test_chat_path_is_the_best(spark, monkeypatch):
    """The chunked decoding of one long conversation equals plain Viterbi over all its lines."""
    monkeypatch.setattr(chat_roles, "CHUNK", 3)
    rng = np.random.default_rng(5)
    rows = []
    for turn in range(40):
        text = "\n".join(rng.choice(["What is it?", "It is a long line of words, as answers are.", "User: hm", "- point"], rng.integers(1, 4)))
        rows.append((1, turn, rng.choice([None, "user", "assistant", "who"]), text))
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("mark", F.lit(0).cast("long"))
    observed = chat_roles._chunks(with_places(chat_roles._observations(df), ["conv"], ["turn", "mark"]))
    model = chat_roles._learn(observed)
    states = {r["turn"]: r["states"] for r in chat_roles._states(observed, model).collect()}
    steps, got = [], []
    for r in sorted(observed.collect(), key=lambda r: r["turn"]):
        steps += model.steps([r])
        got += states[r["turn"]]

    def total(path):
        return sum(s[a, b] for s, a, b in zip(steps, [chat_roles._START, *path], path))

    assert total(got) == pytest.approx(total(chat_roles._path(steps, chat_roles._START, -1)))


def test_chat_more_partitions_than_chunks(spark):
    """One conversation of most rows over many partitions that stay apart: a bounded number of jobs."""
    rows = spark.range(0, 3005, 1, 16).select(
        F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")).alias("role"),
        F.when(F.col("id") % 2 == 0, "What is it?").otherwise("It is a long line of words, as answers are.").alias("text"),
    )
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("chat", "one long conversation")
        found = chat_roles.format_chats(rows).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("chat"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs < 60
    assert len(found) == 3005
    assert np.mean([r["role"] == ("user" if r["turn"] % 2 == 0 else "assistant") for r in found if r["conv_id"] == 7]) > 0.99


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    steps = [np.log(rng.random((7, 7))) for _ in range(4)]
    best = max(
        (sum(s[a, b] for s, a, b in zip(steps, (6, *p), p)), p) for p in product(range(7), repeat=4)
    )
    assert chat_roles._path(steps, 6, -1) == list(best[1])
    assert chat_roles._product(steps)[6].max() == pytest.approx(best[0])


def test_chat_odd(spark):
    rows = [
        (1, 0, "user", "User: hi\nthere\nAssistant: hello\nHuman: bye"),
        (1, 1, None, None),
        (1, 1, None, None),
        (1, None, "assistant", "last"),
        (None, 0, "BOT:", ""),
        (2, 0, "user", "x " * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("own"))
    out = chat_roles.format_chats(df).collect()
    first = [(r["role"], r["content"]) for r in sorted((r for r in out if (r["conv_id"], r["turn"]) == (1, 0)), key=lambda r: r["piece"])]
    assert first == [("user", "hi\nthere"), ("assistant", "hello"), ("user", "bye")]
    assert sum((r["conv_id"], r["turn"]) == (1, 1) for r in out) == 1
    assert {r["role"] for r in out if r["conv_id"] is None} == {"assistant"}
    assert all(re.fullmatch(r"<\|(system|user|assistant)\|>\n(.|\n)*\n<\|end\|>", r["rendered"]) for r in out)
    assert chat_roles.format_chats(df.limit(0)).count() == 0
