"""Chat formatting: speaker roles of transcript lines by a hidden Markov model, then canonical turns.

Hidden states are (role, whether the line opens a turn); a line shows a speaker marker (its own prefix, or
the role its row is filed under), whether it starts a row, and its form. Line forms, turn lengths and the
order of roles are counted from the rows whose marker is known; the most likely state sequence of each
conversation is found by Viterbi's method.

A conversation may be any part of the table, so it is not brought together. Its rows are numbered over all
tasks and cut into chunks of ``CHUNK``. A conversation of one chunk is decoded as it is. Of a longer one, each
chunk is summed up by its max-plus product, chunks of chunks likewise, until one is the whole conversation.
Its best path fixes the states at the chunk borders, and from there each chunk is decoded on its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.common import arrow_schema, id_of, key_of
from panelsmith.llm.places import with_places
from panelsmith.session import cut_lineage

ROLES = ("system", "user", "assistant")
#: Names that speakers go by.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions", "context", "developer"),
    "user": ("user", "human", "customer", "client", "prompt", "question", "q", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "chatbot", "model", "gpt", "answer", "a", "response"),
}
#: Rows per chunk, and chunks per chunk of chunks.
CHUNK = 256
#: Log-probability weights of what a line shows, given its state.
MARKER_FITS, MARKER_OTHER, MARKER_UNKNOWN, MARKER_NONE = 0.90, 0.01, 0.03, 0.05
INSIDE_MARKED = 0.0075
START_OPENS, START_INSIDE = 0.95, 0.001

_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
_PREFIX = re.compile(r"^\s*(?:[#*>\-\[(<|]+\s*)?([A-Za-z]{1,14})\s*(?:[*\])|>]*\s*:|[\])|>]+:?)\s*")
_UNKNOWN, _NONE = 3, 4
_OPEN, _START, _K = 3, 6, 7  # states 0-2 inside a turn, 3-5 opening one, 6 before the first line
_FORMS = 48


def marker(line: str) -> tuple[int, int]:
    """Role (or none) of a line's own prefix, and the prefix's length."""
    found = _PREFIX.match(line)
    if found:
        role = _ROLE_OF.get(found.group(1).lower())
        if role is not None:
            return role, found.end()
    return _NONE, 0


def filed(role: str | None) -> int:
    """Marker of a row's role column: a known name, an unknown one, or none."""
    name = (role or "").strip().strip(":").lower()
    return _ROLE_OF.get(name, _UNKNOWN) if name else _NONE


def form(line: str) -> int:
    """A line's form: length on a log scale, question mark at the end, list or code sign in front."""
    text = line.strip()
    size = min(7, len(text).bit_length() * 2 // 3)
    sign = 0 if not text else 1 if text[0] in "-*#`0123456789" else 2 if text[0].isupper() else 0
    return (size * 3 + sign) * 2 + text.endswith("?")


def _observations(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv, turn, mark): its markers and forms by line."""
    shape = "conv long, turn long, mark long, role int, markers array<int>, forms array<int>"
    schema = arrow_schema(rows.sparkSession, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            markers, forms, roles = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                lines = (text or "").split("\n")
                seen = [marker(x)[0] for x in lines]
                of_row = filed(role)
                if seen[0] == _NONE:
                    seen[0] = of_row
                markers.append(seen)
                forms.append([form(x) for x in lines])
                roles.append(seen[0])
            columns = [batch.column("conv"), batch.column("turn"), batch.column("mark"), pa.array(roles), pa.array(markers), pa.array(forms)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, shape).dropDuplicates(["conv", "turn", "mark"])


def _by_chunk(rows: DataFrame, shape: str, run) -> DataFrame:
    """``run(conv, chunk, rows of it by place)`` for every chunk (at most ``CHUNK`` rows); it yields result rows."""
    schema = arrow_schema(rows.sparkSession, shape)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv"], row["chunk"]) != key:
                    if held:
                        out += run(*key, held)
                    key, held = (row["conv"], row["chunk"]), []
                held.append(row)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if held:
            out += run(*key, held)
        yield pa.RecordBatch.from_pylist(out, schema)

    dealt = rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "place")
    return dealt.mapInArrow(stream, shape)


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk", F.expr(f"place div {CHUNK}"))


class Model:
    """Log-probabilities: ``move`` between states, ``forms`` by role, ``shown`` for markers."""

    def __init__(self, first: np.ndarray, order: np.ndarray, forms: np.ndarray, rows: float, lines: float):
        turn = (rows + 1) / (lines + 2)
        follow = np.log((order + 1) / (order + 1).sum(axis=1, keepdims=True))
        self.move = np.full((_K, _K), -np.inf)
        for r in range(3):
            for s in (r, r + _OPEN):
                self.move[s, _OPEN : _OPEN + 3] = math.log(turn) + follow[r]
                self.move[s, r] = math.log1p(-turn)
        self.move[_START, _OPEN : _OPEN + 3] = np.log((first + 1) / (first + 1).sum())
        by_role = np.log((forms + 1) / (forms + 1).sum(axis=1, keepdims=True))
        self.forms = np.full((_K, _FORMS), -np.inf)
        self.forms[:3] = self.forms[_OPEN : _OPEN + 3] = by_role
        self.shown = np.full((_K, 5), -np.inf)
        for r in range(3):
            self.shown[r] = np.log([INSIDE_MARKED] * 4 + [1 - 4 * INSIDE_MARKED])
            row = [MARKER_OTHER, MARKER_OTHER, MARKER_OTHER, MARKER_UNKNOWN, MARKER_NONE]
            row[r] = MARKER_FITS
            self.shown[r + _OPEN] = np.log(row)
        self.starts = np.full((2, _K), -np.inf)
        self.starts[1, :3], self.starts[1, _OPEN : _OPEN + 3] = math.log(START_INSIDE), math.log(START_OPENS)
        self.starts[0, :3], self.starts[0, _OPEN : _OPEN + 3] = math.log(1 - START_INSIDE), math.log(1 - START_OPENS)
        shows = self.starts[:, None, None] + self.shown.T[None, :, None] + self.forms.T[None, None]
        #: Matrices (state before, state of the line) by row start, marker and form.
        self.matrices = self.move + shows[:, :, :, None, :]

    def steps(self, rows: list[dict]) -> Iterator[np.ndarray]:
        """For each line of ``rows`` its matrix."""
        for row in rows:
            for i, (m, f) in enumerate(zip(row["markers"], row["forms"])):
                yield self.matrices[int(i == 0), m, f]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _product(steps: Iterable[np.ndarray]) -> np.ndarray:
    out = None
    for step in steps:
        out = step if out is None else _times(out, step)
    return out


def _path(steps: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """Best states after each step, from ``entry`` to ``exit_`` (-1: any)."""
    score, back = steps[0][entry], []
    for step in steps[1:]:
        through = score[:, None] + step
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    state = int(score.argmax()) if exit_ < 0 else exit_
    path = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        path.append(state)
    return path[::-1]


def _learn(rows: DataFrame) -> Model:
    """Counts over all rows whose first marker is a known role."""
    known = rows.where(F.col("role") < 3)
    forms = np.zeros((3, _FORMS))
    for r, f, n in known.select("role", F.explode("forms").alias("f")).groupBy("role", "f").count().collect():
        forms[r, f] = n
    total = rows.agg(F.count("*"), F.sum(F.size("forms"))).first()
    # neighbours inside a chunk by a window of its rows; across chunks by one row on either side
    order, first = np.zeros((3, 3)), np.zeros(3)
    after = F.lead("role").over(Window.partitionBy("conv", "chunk").orderBy("place"))
    inside = rows.select("role", after.alias("then"))
    begins = rows.where(F.col("place") % CHUNK == 0)
    ends = rows.where(F.col("place") % CHUNK == CHUNK - 1).select("conv", (F.col("chunk") + 1).alias("chunk"), "role")
    across = ends.join(begins.select("conv", "chunk", F.col("role").alias("then")), ["conv", "chunk"]).select("role", "then")
    for a, b, n in inside.unionByName(across).where("role < 3 and then < 3").groupBy("role", "then").count().collect():
        order[a, b] += n
    for r, n in begins.where("place = 0 and role < 3").groupBy("role").count().collect():
        first[r] += n
    return Model(first, order, forms, float(total[0] or 0), float(total[1] or 0))


_SUMS = "conv long, place long, total long, product array<double>"
_BOUNDS = "conv long, chunk long, entry int, exit int"


def _matrices(rows: list[dict]) -> list[np.ndarray]:
    return [np.asarray(r["product"]).reshape(_K, _K) for r in rows]


def _summed(conv: int, chunk: int, rows: list[dict], product: np.ndarray) -> dict:
    return {"conv": conv, "place": chunk, "total": rows[0]["total"], "product": product.ravel().tolist()}


def _within(conv: int, chunk: int, rows: list[dict]) -> Iterator[dict]:
    """States before and after each of a chunk's rows, which are chunks of the table below."""
    states = _path(_matrices(rows), rows[0]["entry"], rows[0]["exit"])
    for row, before, after in zip(rows, [rows[0]["entry"], *states[:-1]], states):
        yield {"conv": conv, "chunk": row["place"], "entry": before, "exit": after}


def _bounds(rows: DataFrame, model) -> DataFrame:
    """States before and after each chunk on the best path of its conversation, for those of several chunks.

    The tables above are a ``CHUNK``-th each, so there are as many as the longest conversation needs, for any
    partitioning; one row is left of every conversation in the last.
    """

    def above(table: DataFrame, steps) -> DataFrame:
        sums = _by_chunk(table, _SUMS, lambda conv, chunk, held: [_summed(conv, chunk, held, _product(steps(held)))])
        return cut_lineage(sums.withColumn("total", F.expr(f"(total + {CHUNK - 1}) div {CHUNK}")))

    first = rows.where(F.col("total") > CHUNK).select("conv", "place", "total", "chunk", "markers", "forms")
    tables = [above(first, lambda held: model.value.steps(held))]
    while (tables[-1].agg(F.max("total")).first()[0] or 0) > 1:
        tables.append(above(_chunks(tables[-1]), _matrices))
    bounds = tables[-1].select("conv", F.col("place").alias("chunk"), F.lit(_START).alias("entry"), F.lit(-1).alias("exit"))
    for table in reversed(tables[:-1]):
        bounds = cut_lineage(_by_chunk(_chunks(table).join(bounds, ["conv", "chunk"]), _BOUNDS, _within))
    return bounds


def _states(rows: DataFrame, model: Model) -> DataFrame:
    """Per row of ``rows`` (observations with their chunks) the state of each line."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def decoded(conv: int, chunk: int, held: list[dict]) -> Iterator[dict]:
        path = iter(_path(list(shared.value.steps(held)), held[0]["entry"], held[0]["exit"]))
        for row in held:
            yield {"conv": conv, "turn": row["turn"], "mark": row["mark"], "states": [next(path) for _ in row["forms"]]}

    wanted = rows.select("conv", "turn", "mark", "place", "total", "chunk", "markers", "forms")
    bounds = _bounds(wanted, shared)
    ends = {"entry": F.coalesce("entry", F.lit(_START)), "exit": F.coalesce("exit", F.lit(-1))}
    return _by_chunk(wanted.join(bounds, ["conv", "chunk"], "left").withColumns(ends), "conv long, turn long, mark long, states array<int>", decoded)


def format_chats(rows: DataFrame) -> DataFrame:
    """Canonical turns of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``): one row per recovered turn.

    Returns ``conv_id``, ``turn`` (of its row), ``piece`` (from 0 inside the row), ``role``, ``n_lines``,
    ``content`` (speaker prefixes taken off) and ``rendered`` (``<|role|>``, content, ``<|end|>``).

    Rows of a conversation follow each other by turn; equal turns by a hash of role and text; NULL turns
    come last. Rows equal in all four columns are one. A NULL conversation is one conversation of its own.
    A NULL or unknown role is recovered from the lines and the neighbours; a NULL text is one empty line.
    Other columns are ignored; an empty table gives no turns.
    """
    named = rows.select(
        key_of("conv_id").alias("conv"),
        key_of("turn").alias("turn"),
        F.xxhash64("role", "text").alias("mark"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    observed = cut_lineage(_chunks(with_places(cut_lineage(_observations(named)), ["conv"], ["turn", "mark"])))
    states = _states(observed, _learn(observed))
    shape = "conv long, turn long, piece int, role string, n_lines int, content string"
    schema = arrow_schema(rows.sparkSession, shape)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turn, text, path in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "text", "states"))):
                held: list[tuple[int, list[str]]] = []
                for line, state in zip((text or "").split("\n"), path):
                    if not held or state >= _OPEN or held[-1][0] != state:
                        held.append((state % _OPEN, []))
                    held[-1][1].append(line[marker(line)[1] :])
                out += [(conv, turn, k, ROLES[r], len(x), "\n".join(x).strip()) for k, (r, x) in enumerate(held)]
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    texts = named.dropDuplicates(["conv", "turn", "mark"]).drop("role")
    made = texts.join(states, ["conv", "turn", "mark"]).mapInArrow(turns, shape)
    return made.select(
        id_of("conv").alias("conv_id"),
        id_of("turn").alias("turn"),
        "piece",
        "role",
        "n_lines",
        "content",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")).alias("rendered"),
    )
