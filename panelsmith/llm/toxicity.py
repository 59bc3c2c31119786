"""Toxicity scores: a lexicon learnt from labels, searched with Levenshtein automata.

Terms are words, and stems that words start with, which stand in toxic documents far more often than in
others. They form a trie; a word is run through the trie and through the automaton that accepts all strings
within one edit of a term, both at once, so that misspelled terms are found too. Each hit is weighed by
its term and looked at in its context window: inside quotation marks it counts apart. A logistic
regression on these sums gives the score. Words that one digit or sign parts (id1ot) are also read as one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm import logistic
from panelsmith.llm.common import arrow_schema, id_of, key_of, raw_text
from panelsmith.llm.labelled import remainder, sample
from panelsmith.session import cut_lineage

FOLDS, HELD_OUT = 4, 2
#: Labelled documents that the lexicon and the weights are learnt from.
SAMPLE = 30_000
THRESHOLD = 0.3
#: A term stands in at least so many toxic documents of the sample and in such a part of them, and at
#: least so large a share of its documents is toxic.
MIN_TOXIC, MIN_PART, MIN_SHARE = 5, 0.005, 0.8
#: Stems tried for longer words.
STEMS = range(4, 8)
#: Terms of at least so many letters are also found one edit away.
FUZZY_FROM = 5
#: Words on either side that a hit is read with.
CONTEXT = 6
#: Letters of a word whose automaton states are remembered, and how many such beginnings at a time.
HEAD, REMEMBER = 6, 500_000

_WORD = re.compile(r"[^\W\d_]+|[\"“”„«»]")
#: The first of two words with one digit or sign between them, and the rest up to the end of the second.
_TORN = re.compile(r"(?<![^\W\d_])([^\W\d_]++)(?=((?:[\d_]|[^\w\s\"“”„«»])[^\W\d_]++))")
_QUOTES = frozenset("\"“”„«»")

Lexicon = dict[tuple[str, bool], float]


class TermTrie:
    """Terms (text, is_stem) -> weight; finds those within one edit of a word or of its beginning."""

    def __init__(self, lexicon: Lexicon):
        self._children: list[dict[str, int]] = [{}]
        self._ends: list[list[tuple[bool, float, int]]] = [[]]
        for (term, stem), weight in sorted(lexicon.items()):
            node = 0
            for c in term:
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._ends.append([])
                node = self._children[node][c]
            self._ends[node].append((stem, weight, len(term)))
        self._start = self._closed({(0, 0)})
        self._steps: dict[tuple[frozenset, str], frozenset] = {}

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the states reached by leaving out one letter of a term."""
        more = {(child, 1) for node, edits in states if not edits for child in self._children[node].values()}
        return frozenset(states | more)

    def _step(self, states: frozenset, c: str) -> frozenset:
        known = self._steps.get((states, c))
        if known is None:
            after = set()
            for node, edits in states:
                child = self._children[node].get(c)
                if child is not None:
                    after.add((child, edits))
                if not edits:
                    after.add((node, 1))  # a letter too many
                    after.update((x, 1) for x in self._children[node].values())  # another letter
            known = self._closed(after)
            if len(self._steps) < 200_000:
                self._steps[states, c] = known
        return known

    def run(self, states: frozenset, text: str, ended: bool) -> tuple[frozenset, float, float]:
        """Read on from ``states``: the states after ``text``, and the greatest weights met (0: none)."""
        exact = near = 0.0
        for i, c in enumerate(text):
            states = self._step(states, c)
            if not states:
                break
            last = ended and i == len(text) - 1
            for node, edits in states:
                for stem, weight, length in self._ends[node]:
                    if stem or last:
                        if not edits:
                            exact = max(exact, weight)
                        elif length >= FUZZY_FROM:
                            near = max(near, weight)
        return states, exact, near

    def hits(self, word: str) -> tuple[float, float]:
        """Greatest weight of a term that fits exactly, and of one that fits with one edit (0: none)."""
        return self.run(self._start, word, True)[1:]

    def begin(self, head: str) -> tuple[frozenset, float, float]:
        """The states after the beginning of a longer word, and what was met so far."""
        return self.run(self._start, head, False)


def _terms(text: str) -> set[tuple[str, bool]]:
    words = {w for w in _WORD.findall(text.lower()) if w not in _QUOTES}
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms with their smoothed log-odds, from ``text`` and ``y`` of a bounded sample.

    A stem replaces the longer stems and the words that begin with it, unless they tell much more.
    """
    schema = arrow_schema(rows.sparkSession, "term string, stem boolean, toxic long, clean long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: Counter = Counter()
            clean: Counter = Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                (toxic if y else clean).update(_terms(text.decode("utf-8", "replace")))
            terms = list(toxic | clean)
            columns = [[t[0] for t in terms], [t[1] for t in terms], [toxic[t] for t in terms], [clean[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.select("text", "y").mapInArrow(run, "term string, stem boolean, toxic long, clean long")
    found = (
        counted.groupBy("term", "stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= max(MIN_TOXIC, MIN_PART * n_toxic)) & (F.col("toxic") >= MIN_SHARE * (F.col("toxic") + F.col("clean"))))
        .collect()
    )  # at most as many as the sample has terms MIN_TOXIC times
    lexicon: Lexicon = {}
    for r in sorted(found, key=lambda r: (len(r["term"]), r["term"], r["stem"])):
        odds = math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1))
        stems = range(1, len(r["term"]) + (not r["stem"]))
        covered = any(lexicon.get((r["term"][:k], True), 0.0) >= odds - 1 for k in stems)
        if odds > 1 and not covered:
            lexicon[r["term"], r["stem"]] = odds
    return lexicon


class Reader:
    """Features of a text by a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self._trie = TermTrie(lexicon)
        self._short: dict[str, tuple[float, float] | None] = {}
        self._heads: dict[str, tuple[frozenset, float, float] | None] = {}

    def _look(self, word: str) -> tuple[float, float] | None:
        """Weights of a word's hits; None without any. Words of one beginning share their first steps."""
        if len(word) <= HEAD:
            if word not in self._short:
                hit = self._trie.hits(word) if word not in _QUOTES else (0.0, 0.0)
                self._short[word] = hit if any(hit) else None
            return self._short[word]
        states, exact, near = self._heads[word[:HEAD]]
        _, more_exact, more_near = self._trie.run(states, word[HEAD:], True)
        hit = max(exact, more_exact), max(near, more_near)
        return hit if any(hit) else None

    def _with_torn(self, text: str, hits: list[tuple[int, float, float]]) -> list[tuple[int, float, float]]:
        """``hits`` and, in order, those of words torn by one digit or sign of which neither half is a hit."""
        known, more, word, at = {i for i, _, _ in hits}, [], 0, 0
        for torn in _TORN.finditer(text):
            exact, near = self._trie.hits(torn[1] + torn[2])
            if exact or near:
                word += sum(1 for _ in _WORD.finditer(text, at, torn.start()))
                at = torn.start()
                if word not in known and word + 1 not in known:
                    more.append((word, exact, near))
        return sorted(hits + more) if more else hits

    def features(self, text: bytes) -> list[float]:
        text = text.decode("utf-8", "replace").lower()
        words = _WORD.findall(text)
        heads, begin, hits = self._heads, self._trie.begin, []
        if len(heads) + len(self._short) > REMEMBER:
            heads.clear()
            self._short.clear()
        for i, w in enumerate(words):
            if len(w) > HEAD:
                head = w[:HEAD]
                try:
                    met = heads[head]
                except KeyError:
                    met = begin(head)
                    met = heads[head] = met if any(met) else None
                if met is None:  # no term can fit any more
                    continue
            hit = self._look(w)
            if hit:
                hits.append((i, *hit))
        hits = self._with_torn(text, hits)
        places = [i for i, _, _ in hits]
        direct = quoted = near_direct = near_quoted = top = beside = 0.0
        for i, exact, near in hits:
            before = sum(w in _QUOTES for w in words[max(0, i - CONTEXT) : i])
            after = sum(w in _QUOTES for w in words[i + 1 : i + 1 + CONTEXT])
            inside = before % 2 == 1 and after > 0
            if exact:
                top = max(top, exact)
                if inside:
                    quoted += exact
                else:
                    direct += exact
            elif inside:
                near_quoted += near
            else:
                near_direct += near
            beside += bisect_right(places, i + CONTEXT) - bisect_left(places, i - CONTEXT) - 1
        n = max(1, len(words))
        return [
            math.log1p(direct),
            math.log1p(quoted),
            math.log1p(near_direct),
            math.log1p(near_quoted),
            top,
            min(direct / n, 5.0),
            min(near_direct / n, 5.0),
            math.log1p(beside),
            math.log(n),
        ]


N_FEATURES = 9


def _feature_rows(rows: DataFrame, lexicon: Lexicon, column: str) -> DataFrame:
    """``column`` (long) and ``x`` from ``column`` and ``text``."""
    shape = f"{column} long, x array<double>"
    schema = arrow_schema(rows.sparkSession, shape)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            x = [reader.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(column).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], schema=schema
            )

    return rows.select(column, "text").mapInArrow(run, shape)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[Lexicon, np.ndarray, np.ndarray]:
    """Lexicon, feature scales and weights (the intercept last) from a bounded sample."""
    chosen = cut_lineage(sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows))
    lexicon = learn_lexicon(chosen)
    found = _feature_rows(chosen, lexicon, "y").collect()
    x = np.array([r["x"] for r in found], float).reshape(-1, N_FEATURES)
    y = np.array([r["y"] for r in found], float)
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0) if len(x) else np.ones(N_FEATURES)
    if not len(y) or y.min() == y.max():
        prior = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return lexicon, scale, np.r_[np.zeros(N_FEATURES), math.log(prior / (1 - prior))]
    return lexicon, scale, logistic.fit(x / scale, y, ridge=1.0)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.3).

    NULL texts are empty; a text without words has no hits. A NULL id stays NULL and is not held out.
    Without labels of both kinds every score is the share of toxic ones (0.001 without labels). Repeated
    rows are scored each; only ``doc_id``, ``text`` and ``labels.toxic`` are read.
    """
    lexicon, scale, weights = learn(docs, labels, rows)
    texts = docs.select(key_of().alias("key"), raw_text().alias("text"))
    linear = F.lit(float(weights[-1]))
    for k in range(N_FEATURES):
        linear = linear + F.get("x", F.lit(k)) * F.lit(float(weights[k] / scale[k]))
    scored = _feature_rows(texts, lexicon, "key").select(
        id_of("key").alias("doc_id"), (1.0 / (1.0 + F.exp(-linear))).alias("score")
    )
    return scored.select(
        "doc_id",
        F.coalesce(remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
