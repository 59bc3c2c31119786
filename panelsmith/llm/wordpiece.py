"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links as in the linear-time MaxMatch construction: when no edge
leads on, the failure link jumps to the state that stands for the text after the longest pieces were
taken off, and a stored count says how many pieces that were. A word is read once, character by
character; only counts are added, no piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelsmith.llm.common import arrow_schema, id_of, key_of, raw_text

#: Distinct words whose counts one worker remembers at a time.
REMEMBER = 500_000


def word_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that open a word and pieces that continue one, of a byte-level vocabulary file.

    In that file a leading space (written by its stand-in) marks the opening pieces; every single byte is
    a continuing piece, and opens a word where no spaced form is listed.
    """
    import json

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in printable}
    stand_in |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    opening, inner = [], []
    for piece in vocabulary:
        if all(c in stand_in for c in piece):
            raw = bytes(stand_in[c] for c in piece)
            if raw[:1] == b" ":
                if len(raw) > 1:
                    opening.append(raw[1:])
            else:
                inner.append(raw)
    opening += [bytes([b]) for b in range(256)]
    return opening, inner + [bytes([b]) for b in range(256)]


class LongestMatch:
    """Greedy longest-match counts; a word that cannot be cut wholly into pieces counts as one unknown."""

    def __init__(self, opening: Iterable[bytes], inner: Iterable[bytes]):
        # state 0: a word's start; state 1: inside a word, nothing pending
        self._next: list[dict[int, int]] = [{}, {}]
        accepting = [False, False]
        parent: list[tuple[int, int]] = [(0, -1), (1, -1)]
        for root, listed in ((0, opening), (1, inner)):
            for piece in listed:
                state = root
                for b in piece:
                    if b not in self._next[state]:
                        self._next[state][b] = len(self._next)
                        self._next.append({})
                        accepting.append(False)
                        parent.append((state, b))
                    state = self._next[state][b]
                accepting[state] = True
        n = len(self._next)
        #: where to go on after popping, or -1; and how many pieces that pops
        self._fail, self._pops = [-1] * n, [0] * n
        queue = deque([*self._next[0].values(), *self._next[1].values()])
        while queue:
            state = queue.popleft()
            queue.extend(self._next[state].values())
            if accepting[state]:
                self._fail[state], self._pops[state] = 1, 1
                continue
            up, b = parent[state]
            at, popped = self._fail[up], self._pops[up]
            while at >= 0 and b not in self._next[at]:
                popped += self._pops[at]
                at = self._fail[at]
            if at >= 0:
                self._fail[state], self._pops[state] = self._next[at][b], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (unknown) where no cut exists, 0 for the empty word."""
        if not word:
            return 0
        edges, fail, pops = self._next, self._fail, self._pops
        state = total = 0
        for b in word:
            while True:
                on = edges[state].get(b)
                if on is not None:
                    state = on
                    break
                total += pops[state]
                state = fail[state]
                if state < 0:
                    return 1
        while state > 1:
            total += pops[state]
            state = fail[state]
            if state < 0:
                return 1
        return total


_AUTOMATA: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def _automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = LongestMatch(*word_pieces(path)), {}
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_tokens`` (word pieces, all words).

    ``vocabulary``: a byte-level vocabulary file. Words are parted by ASCII white space. NULL and empty
    texts have no words; repeated rows are counted each; a NULL id stays NULL; other columns are ignored.
    """
    schema = arrow_schema(docs.sparkSession, "key long, n_words long, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(vocabulary)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = text.as_py().split()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = known[w] = automaton.count(w)
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
                if len(known) > REMEMBER:
                    known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_tokens, np.int64))],
                schema=schema,
            )

    found = docs.select(key_of().alias("key"), raw_text().alias("text")).mapInArrow(
        run, "key long, n_words long, n_tokens long"
    )
    return found.select(id_of("key").alias("doc_id"), "n_words", "n_tokens")
