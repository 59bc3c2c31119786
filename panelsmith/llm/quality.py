"""Quality scores by Bradley-Terry ranking.

A document's strength is linear in its features. Preference pairs (a good one over a bad one) give the
weights by logistic loss on feature differences. The threshold is a quantile of the strengths: as large
a share of the labelled documents lies above it as is labelled good.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm import logistic
from panelsmith.llm.common import arrow_schema, id_of, key_of, raw_text
from panelsmith.llm.labelled import remainder, sample

FOLDS, HELD_OUT = 5, 0
#: Labelled documents the ranking is learnt from, and preference pairs drawn among them.
SAMPLE = 20_000
PAIRS = 200_000
#: Score of a document whose strength is at the threshold.
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 stop, 6 mark, 7 beyond ASCII, 8 control
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (
        7 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit()
        else 4 if _c in " \t\n\r\x0b\f" else 5 if _c in ".,;:'\"-()!?" else 6 if _b >= 33 and _b != 127 else 8
    )


def features(text: bytes) -> list[float]:
    """Numbers that describe a text's form; zeros for the empty text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * N_FEATURES
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=bytes_, minlength=9) / size
    p = bytes_[bytes_ > 0] / size
    counts = Counter(words)
    top = counts.most_common(3)
    same = sum(a == b for a, b in zip(words, words[1:]))
    triples = Counter(zip(words, words[1:], words[2:]))
    again = sum(c for c in triples.values() if c > 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = sum(w[-1:] in b".!?" for w in words)
    doubled = sum(len(w) > 1 and w[-1] == w[-2] and not 97 <= w[-1] <= 122 for w in words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    opened = sum(65 <= w[0] <= 90 for w in words)
    return [
        math.log(n),
        min(n, 50) / 50,
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        *kinds[1:].tolist(),
        float(-(p * np.log(p)).sum()),
        len(counts) / n,
        math.log(len(counts)) / math.log(n + 1),
        top[0][1] / n,
        sum(c for _, c in top) / n,
        same / n,
        again / max(1, n - 2),
        1 - len(set(lines)) / len(lines),
        n / len(lines) / 100,
        stops / n,
        doubled / n,
        opened / n,
        float(bytes_.max() / size),
    ]


N_FEATURES = 5 + 8 + 13


class Ranking:
    """Weights, and the map from strength to score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 42):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
        spread = x.std(axis=0) if len(x) else np.ones(N_FEATURES)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        self.weights, self.slope, self.cut = np.zeros(N_FEATURES), 0.0, 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        z = self._z(x)
        rng = np.random.default_rng(seed)
        winners = np.r_[rng.choice(good, pairs), np.resize(good, len(bad))]
        losers = np.r_[rng.choice(bad, pairs), bad]
        self.weights = logistic.fit(z[winners] - z[losers], np.ones(len(winners)), ridge=1.0, intercept=False)
        strength = z @ self.weights
        self.cut = float(np.quantile(strength, len(bad) / (len(good) + len(bad))))
        self.slope = max(1e-6, float(logistic.fit((strength - self.cut)[:, None], y, ridge=1e-3)[0]))

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.slope * (self._z(x) @ self.weights - self.cut)
        return logistic.sigmoid(at + math.log(THRESHOLD / (1 - THRESHOLD)))


def _feature_rows(rows: DataFrame) -> DataFrame:
    """``y`` and ``x`` (features) from ``y`` and ``text``."""
    schema = arrow_schema(rows.sparkSession, "y int, x array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), x], schema=schema)

    return rows.select("y", "text").mapInArrow(run, "y int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, pairs: int = PAIRS) -> Ranking:
    """The ranking from a bounded sample of the labelled documents outside the held-out fold."""
    found = _feature_rows(sample(docs, labels, "quality", FOLDS, HELD_OUT, rows)).collect()
    found.sort(key=lambda r: (r["y"], r["x"]))  # one order, so that the drawn pairs repeat
    x = np.array([r["x"] for r in found], float).reshape(-1, N_FEATURES)
    return Ranking(x, np.array([r["y"] for r in found], float), pairs)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, pairs: int = PAIRS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.3).

    NULL texts are empty; a text without words has all features zero and is scored like any other. A
    NULL id stays NULL and is not held out. Without labels of both kinds every score is 0.3. Repeated
    rows are scored each; only ``doc_id``, ``text`` and ``labels.quality`` are read.
    """
    ranking = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows, pairs))
    schema = arrow_schema(docs.sparkSession, "key long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], float).reshape(-1, N_FEATURES)
            scores = pa.array(ranking.value.score(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), scores], schema=schema)

    scored = docs.select(key_of().alias("key"), raw_text().alias("text")).mapInArrow(run, "key long, score double")
    return scored.select(id_of("key").alias("doc_id"), "score").select(
        "doc_id",
        F.coalesce(remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
