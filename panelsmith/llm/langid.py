"""Language identification by Bayesian fusion of four kinds of evidence.

* the text: likelihood of its hashed byte trigrams under each language, trained on what rows declare;
* the declared markup language: how often texts of each language carry each declaration;
* the address: the prior of a host is smoothed towards that of its address suffix, and that towards the
  whole corpus. All these are grouped counts of the languages that the texts alone suggest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.functions.spread import spread_join
from panelsmith.llm.common import arrow_schema, raw_text, row_mark, without_marks
from panelsmith.session import cut_lineage

#: Hashed trigrams per language. Languages are two-letter codes, so a model has at most 676 rows of these.
BUCKETS = 8192
#: A declared code becomes a language of the model if so many rows declare it.
MIN_ROWS = 5
#: Trigrams overlap and repeat; a text counts as at most so many independent ones.
INDEPENDENT = 60
#: Weight, in rows, of the wider level when the prior of a narrower one is smoothed.
STRENGTH = 20.0
#: A row is kept if its language is at least so probable.
CONFIDENT = 0.65
_BLOCK = 1 << 20

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if _LETTER[b] else 32 for b in range(256)], np.uint8)


def code_of(column: Column) -> Column:
    """Two-letter primary code of a declared language tag, else NULL."""
    primary = F.lower(F.regexp_extract(F.trim(column), r"^([A-Za-z]+)(?:[-_].*)?$", 1))
    return F.when(F.length(primary) == 2, primary)


def _grams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: number of the first, hashed trigrams of all, and grams per text."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= _BLOCK):
            size += len(texts[b])
            b += 1
        joined = np.frombuffer(b"".join(b" " + t + b" " for t in texts[a:b]), np.uint8)
        folded = _FOLD[joined].astype(np.uint32)
        hashed = folded[:-2] * np.uint32(0x9E3779B1) + folded[1:-1] * np.uint32(0x85EBCA77) + folded[2:] * np.uint32(0xC2B2AE3D)
        hashed ^= hashed >> np.uint32(15)
        hashed = (hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13)
        sizes = np.array([len(t) + 2 for t in texts[a:b]], np.int64)
        owner = np.repeat(np.arange(b - a), sizes)
        inner = _LETTER[joined[1:-1]] & (owner[:-2] == owner[2:])
        yield a, hashed[inner], np.bincount(owner[:-2][inner], minlength=b - a)
        a = b


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and their log-probabilities per trigram bucket, from ``declared`` and ``text``."""
    schema = arrow_schema(rows.sparkSession, "code string, bucket array<int>, n array<long>, docs long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            codes = np.array(batch.column(0).to_pylist(), object)
            known, which = np.unique(codes.astype(str), return_inverse=True)
            for a, hashed, sizes in _grams(batch.column(1).to_pylist()):
                owner = np.repeat(which[a : a + len(sizes)], sizes)
                table = np.bincount(owner * BUCKETS + hashed, minlength=len(known) * BUCKETS)
                for k, code in enumerate(known):
                    counts[code] = counts.get(code, 0) + table[k * BUCKETS : (k + 1) * BUCKETS]
            for k, n in zip(known, np.bincount(which, minlength=len(known)).tolist()):
                docs[k] = docs.get(k, 0) + n
        for code, table in counts.items():
            at = np.flatnonzero(table)
            columns = [[str(code)], [at], [table[at]], [docs[code]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    declared = rows.where("declared is not null").select("declared", "text")
    found = cut_lineage(declared.mapInArrow(run, "code string, bucket array<int>, n array<long>, docs long"))
    enough = found.groupBy("code").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_ROWS)
    languages = sorted(r["code"] for r in enough.collect())
    table = np.full((len(languages), BUCKETS), 0.5)
    index = {c: i for i, c in enumerate(languages)}
    cells = found.select("code", F.explode(F.arrays_zip("bucket", "n")).alias("c"))
    sums = cells.groupBy("code", "c.bucket").agg(F.sum("c.n").alias("n"))
    for code, bucket, n in sums.where(F.col("code").isin(languages)).toLocalIterator():
        table[index[code], bucket] += n
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def text_scores(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` without its text, with ``scores`` (log-likelihood per language) and ``n_grams``."""
    others = [c for c in rows.columns if c != "text"]
    fields = [f for f in rows.schema.fields if f.name != "text"]
    empty = rows.sparkSession.createDataFrame([], "scores array<double>, n_grams long").schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType(fields + empty.fields)
    schema = to_arrow_schema(struct)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            scores, grams = [], []
            for _, hashed, sizes in _grams(batch.column("text").to_pylist()):
                bounds = np.r_[0, np.cumsum(sizes)]
                weight = np.minimum(1.0, INDEPENDENT / np.maximum(sizes, 1))
                part = np.empty((len(sizes), len(logs)))
                for k in range(len(logs)):
                    sums = np.r_[0.0, np.cumsum(logs[k][hashed])]
                    part[:, k] = (sums[bounds[1:]] - sums[bounds[:-1]]) * weight
                scores += list(part)
                grams += sizes.tolist()
            columns = [batch.column(c) for c in others] + [pa.array(scores, pa.list_(pa.float64())), pa.array(grams, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, struct)


def _best(scores: Column) -> Column:
    """Place of the greatest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def identify(rows: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """Language per row of ``rows`` (``text``, ``declared``, ``host``, ``suffix`` and others, which stay).

    Adds ``language`` (NULL where there are no letters), ``confidence`` (its probability),
    ``text_language`` (by the text alone) and ``kept``: the text has letters and its language is at
    least ``confident``. NULL texts are empty; a declaration that is NULL or no two-letter code is no
    evidence; NULL hosts and suffixes are groups of their own; repeated rows count each. Ties go to the
    first language in code order. With no usable declaration at all no language is known, nothing is kept.
    """
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(
        *[F.col(f"`{c}`") for c in others if c not in ("declared", "host", "suffix")],
        code_of(F.col("declared")).alias("declared"),
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("suffix", F.lit("")).alias("suffix"),
        raw_text().alias("text"),
    )
    languages, model = train(rows)
    passed = [c for c in rows.columns if c != "text" and c not in ("declared", "host", "suffix")]
    if not languages:
        return rows.select(
            *[F.col(f"`{c}`") for c in passed],
            F.lit(None).cast("string").alias("language"),
            F.lit(0.0).alias("confidence"),
            F.lit(None).cast("string").alias("text_language"),
            F.lit(False).alias("kept"),
        )
    scored = cut_lineage(text_scores(rows, model).withColumn("_by_text", F.when(F.col("n_grams") > 0, _best(F.col("scores")))))
    n_lang = len(languages)

    # counts of what the texts suggest, level by level; each count is one partial aggregate
    of = [F.count(F.when(F.col("_by_text") == k, 1)).cast("double") for k in range(n_lang)]
    counts = F.array(*of)
    hosts = scored.groupBy("suffix", "host").agg(counts.alias("n"), F.count("*").alias("rows"))
    hosts = cut_lineage(hosts)
    sums = F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(n_lang)])
    suffixes = hosts.groupBy("suffix").agg(sums.alias("n_suffix"))
    total = np.array(hosts.agg(sums).first()[0] or [0.0] * n_lang, float)
    corpus = (total + 1) / (total.sum() + n_lang)

    def smoothed(n: Column, wider: Column) -> Column:
        whole = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, wider, lambda x, p: (x + F.lit(STRENGTH) * p) / (whole + F.lit(STRENGTH)))

    wide = suffixes.select("suffix", smoothed(F.col("n_suffix"), F.array(*map(F.lit, corpus.tolist()))).alias("wide"))
    priors = hosts.join(wide, "suffix").select(
        F.struct("suffix", "host").alias("_site"), "rows", smoothed(F.col("n"), F.col("wide")).alias("prior")
    )

    # how often a text of each language declares each code
    declared = {
        (k, c): n
        for k, c, n in scored.where("_by_text is not null and declared is not null")
        .groupBy("_by_text", "declared")
        .count()
        .collect()
    }
    codes = sorted({c for _, c in declared})
    says = np.array([[declared.get((k, c), 0) + 0.5 for c in codes] for k in range(n_lang)]).reshape(n_lang, len(codes))
    says = np.log(says / np.maximum(says.sum(axis=1, keepdims=True), 1e-300))
    table = rows.sparkSession.createDataFrame(
        [(c, says[:, i].tolist()) for i, c in enumerate(codes)], "declared string, says array<double>"
    )  # at most 676 codes

    joined = spread_join(scored.withColumn("_site", F.struct("suffix", "host")), cut_lineage(priors), "_site", "rows")
    joined = joined.join(F.broadcast(table), "declared", "left")
    zero = F.array(*[F.lit(0.0)] * n_lang)
    fused = F.zip_with(
        F.zip_with("scores", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b),
        F.coalesce("says", zero),
        lambda a, b: a + b,
    )
    joined = joined.withColumn("_fused", fused).withColumn("_top", F.array_max("_fused"))
    joined = joined.withColumn(
        "confidence",
        1.0 / F.aggregate(F.transform("_fused", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x),
    )
    names = F.array(*map(F.lit, languages))
    return joined.select(
        *[F.col(f"`{c}`") for c in passed],
        F.when(F.col("n_grams") > 0, F.get(names, _best(F.col("_fused")))).alias("language"),
        "confidence",
        F.get(names, F.col("_by_text")).alias("text_language"),
        ((F.col("n_grams") > 0) & (F.col("confidence") >= confident)).alias("kept"),
    )


def document_evidence(docs: DataFrame, *more: Column | str) -> DataFrame:
    """Documents as rows for ``identify``: the language column is the declaration, the source the host."""
    return docs.select(
        *more,
        "text",
        F.col("lang").alias("declared"),
        F.col("source").alias("host"),
        F.lit(None).cast("string").alias("suffix"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages as rows for ``identify``: markup declaration, host, the last label of its address."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select(
        "page_id",
        body.alias("text"),
        F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1).alias("declared"),
        host.alias("host"),
        F.element_at(F.split(host, r"\."), -1).alias("suffix"),
    )


def identified_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is certain enough; all columns stay as they are."""
    found = identify(document_evidence(docs, row_mark(docs).alias("_mark")))
    return without_marks(docs, cut_lineage(found.where("not kept").select("_mark")))
