"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents are tokenized and cut at multiples of the sequence length where they are read. Pieces, which
are rows of a few numbers, are dealt by a hash into groups of a bounded expected size. Inside a group,
pieces are taken in decreasing length, and a tournament tree over the bins' free room finds the first bin
that fits in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import arrow_schema, id_of, key_of, raw_text
from panelsmith.session import cut_lineage

LENGTH = 1024
END = 0
#: Expected pieces per group.
GROUP = 8192
VOCABULARY = "byte_bpe_50k"

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """The byte-level BPE ids of a text, little-endian unsigned 32-bit.

    The merges come from the rank file that holds the same vocabulary, and a text is encoded in one call;
    the tests hold the ids against the tokenizer file. Texts with a special token's string go through that.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._file, self._whole = tokenizer_path(f"{vocabulary}.json"), None
        with open(self._file, encoding="utf-8") as file:
            self._special = [t["content"] for t in json.load(file)["added_tokens"]]

    def _encode_whole(self, text: str) -> bytes:
        """By the tokenizer itself, loaded when first needed."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._file)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return self._encode_whole(text)
        return np.array(self._encode(text), "<u4").tobytes()


_ENCODERS: dict[str, ByteBpe] = {}


def _encoder(vocabulary: str) -> ByteBpe:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ByteBpe(vocabulary)
    return _ENCODERS[vocabulary]


def pieces(
    docs: DataFrame,
    length: int = LENGTH,
    end: int = END,
    vocabulary: str = VOCABULARY,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``length`` ids of every document: ``doc_id``, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``salt`` (random by content and place), with ``keep_ids`` also ``ids``.
    """
    schema = arrow_schema(docs.sparkSession, _PIECE + (", ids array<int>" if keep_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail, row = _encoder(vocabulary).encode, np.array([end], "<u4").tobytes(), 0
        for batch in batches:
            out, ids_out = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py().decode("utf-8", "replace")) + tail
                row += 1
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at : at + 4 * length]
                    crc = zlib.crc32(piece)
                    out.append((key, at // 4, len(piece) // 4, crc, len(ids) // 4, row * 2654435761 ^ crc))
                    if keep_ids:
                        ids_out.append(np.frombuffer(piece, "<i4"))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, schema)], schema=schema
            )

    text = docs.select(key_of().alias("key"), raw_text().alias("text"))
    return text.mapInArrow(run, _PIECE + (", ids array<int>" if keep_ids else ""))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset per length (none above ``capacity``).

    A tournament tree holds the greatest free room below each node; bins not yet opened are whole. The
    descent takes the left child wherever it has room enough, so it ends in the first bin that fits.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)  # each of these opens a bin and fills it
    leaves = 1 << max(0, (n - full - 1)).bit_length()
    room = [capacity] * (2 * leaves)
    for i in order[full:].tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = full + node - leaves, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left >= right else right
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins, offsets


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    end: int = END,
    vocabulary: str = VOCABULARY,
    group: int = GROUP,
    seed: int = 42,
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: ``sequence_id`` and ``offset`` (from 0, without gaps).

    A document is its ids and one ``end`` id; a NULL or empty text is the ``end`` id alone. Pieces of a
    document may lie in different sequences. Ties in length are taken in the order of (doc_id, start,
    salt). Repeated rows are packed as often as they occur; their salts differ, so they spread over the
    groups. A NULL id stays NULL. Other columns are ignored; an empty table gives no pieces. Sequences
    may be padded to ``length`` by the reader; at most about one bin per group is loosely filled.
    """
    made = cut_lineage(pieces(docs, length, end, vocabulary, keep_ids))
    groups = max(1, -(-made.count() // group))
    width = 1 << 32

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "salt"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), length)
        frame["sequence_id"] = frame.pop("group") * width + bins
        frame["offset"] = offsets
        return frame.drop(columns="salt")

    dealt = made.withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "start", "salt", F.lit(seed)), F.lit(groups)).cast("long")
    )
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    columns += ", ids array<int>" if keep_ids else ""
    placed = dealt.groupBy("group").applyInPandas(place, columns + ", sequence_id long, offset long")
    return placed.withColumn("doc_id", id_of("doc_id"))
