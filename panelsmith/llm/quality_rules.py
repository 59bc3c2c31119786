"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed rules fail a text outright. The others compare it with its own kind: per language and source, a
quantile sketch of each measure gives quartiles, and texts far outside them (Tukey's outer fences) are
dropped. A sketch is a table of counts in log-linear buckets (exact below 64, within 1/32 above), so
sketches merge by adding counts, in any order, with one result. Groups of few texts use the sketch merged
over their language, or over all texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelsmith.functions.spread import spread_join
from panelsmith.session import cut_lineage

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A group with fewer texts than this borrows the sketch of the next wider one.
MIN_GROUP = 200
#: How many interquartile ranges beyond the quartiles a fence lies.
REACH = 3
#: Measures with the room each fence has besides (in the measure's own unit).
SLACK = {"word_length": 100, "symbols": 20, "dup_lines": 500, "repeats": 350}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the text."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def repeated(sorted_: Column) -> Column:
        again = F.filter(
            sorted_,
            lambda x, i: (x["h"] == F.get(sorted_, i - 1)["h"]) | (x["h"] == F.get(sorted_, i + 1)["h"]),
        )
        return _let(F.sort_array(F.transform(again, lambda x: x["p"])), covered)

    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )
    return _let(F.sort_array(windows), repeated)


def measures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``lang``, ``source`` and the counts that the rules read.

    Windows of three words are told apart by 64-bit hashes inside one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = F.translate(text, SPACES, " " * len(SPACES))
    words = F.filter(F.split(spaces, " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counted = docs.select(
        "doc_id",
        "lang",
        "source",
        _let(
            words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))
        ).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"),
            ),
        ).alias("l"),
    )
    return counted.select(
        "doc_id",
        "lang",
        "source",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.d").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
    )


def _ratio(part: str, whole: str, unit: int) -> Column:
    return F.expr(f"({unit} * `{part}`) div greatest(`{whole}`, 1L)")


def _measured(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "word_length": _ratio("word_chars", "n_words", 100),
            "symbols": _ratio("n_symbols", "word_chars", 1000),
            "dup_lines": _ratio("n_dup_lines", "n_lines", 1000),
            "repeats": _ratio("n_repeat_words", "n_words", 1000),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def sketches(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Counts per group, measure and log-linear bucket (its least value) of non-negative longs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in names]))
    shift = F.greatest(F.length(F.bin("v")) - 6, F.lit(0))
    long_rows = rows.select(*by, pairs.alias("m")).select(*by, "m.measure", "m.v")
    bucket = F.expr("shiftleft(shiftright(v, _shift), _shift)")
    return (
        long_rows.withColumn("_shift", shift)
        .groupBy(*by, "measure", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group and measure: number of values, first and third quartile (bucket starts)."""
    order = Window.partitionBy(*by, "measure").orderBy("bucket")
    whole = Window.partitionBy(*by, "measure")
    ranked = sketch.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(whole))
    return ranked.groupBy(*by, "measure").agg(
        F.max("_all").alias("n"),
        F.min(F.when(4 * F.col("_upto") >= F.col("_all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("_upto") >= 3 * F.col("_all"), F.col("bucket"))).alias("q3"),
    )


def _fences(sketch: DataFrame, groups: DataFrame, min_group: int, reach: int) -> DataFrame:
    """Per group: lower and upper fence of each measure, from the narrowest sketch with enough texts."""
    names = list(SLACK)
    narrow = quartiles(sketch, ["lang", "source"])
    per_lang = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    wide = quartiles(per_lang, ["lang"])
    whole = quartiles(per_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n")), [])

    def flat(table: DataFrame, by: list[str], tag: str) -> DataFrame:
        return table.groupBy(*by).agg(
            *[
                F.first(F.when(F.col("measure") == m, F.struct("n", "q1", "q3")), ignorenulls=True).alias(f"{tag}{m}")
                for m in names
            ]
        )

    out = groups.join(flat(narrow, ["lang", "source"], "a_"), ["lang", "source"], "left")
    out = out.join(flat(wide, ["lang"], "b_"), "lang", "left")
    corpus = {r["measure"]: r for r in whole.collect()}  # one row per measure
    for m in names:
        every = [F.lit(corpus[m][c] if m in corpus else None).cast("long").alias(c) for c in ("n", "q1", "q3")]
        use = (
            F.when(F.col(f"a_{m}.n") >= min_group, F.col(f"a_{m}"))
            .when(F.col(f"b_{m}.n") >= min_group, F.col(f"b_{m}"))
            .otherwise(F.struct(*every))
        )
        wide_by = reach * (use["q3"] - use["q1"]) + F.lit(SLACK[m])
        out = out.withColumn(f"low_{m}", use["q1"] - wide_by).withColumn(f"high_{m}", use["q3"] + wide_by)
    return out.select("lang", "source", "rows", *[f"{s}_{m}" for m in names for s in ("low", "high")])


def judge(docs: DataFrame, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """Per row of ``docs`` the counts, ``base_failed`` and ``kept``.

    A text fails outright with fewer than 50 words, or if more than half of its words repeat. Otherwise
    it is kept if no measure lies beyond its group's fence: mean word length on both sides; symbols,
    duplicate lines and repeated words above. Sketches hold the texts that do not fail outright.

    NULL texts are empty; NULL languages and sources are groups like any other; a NULL id stays NULL;
    repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        "text",
    )
    rows = cut_lineage(_measured(measures(rows)))
    sketch = cut_lineage(sketches(rows.where("not base_failed"), list(SLACK), ["lang", "source"]))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    key = F.struct("lang", "source").alias("_group")
    fences = cut_lineage(_fences(sketch, groups, min_group, reach).select(key, "*").drop("lang", "source"))
    joined = spread_join(rows.withColumn("_group", F.struct("lang", "source")), fences, "_group", "rows")
    inside = F.col("word_length") >= F.col("low_word_length")
    for m in SLACK:
        inside &= F.col(m) <= F.col(f"high_{m}")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def _bucket_sql(v: str) -> str:
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return f"({v} >> {shift}) << {shift}"


def sql() -> str:
    """The same in SQL."""
    word = r"[^\x20\x09-\x0D]+"
    names = list(SLACK)
    by_level = {"a": "lang, source", "b": "lang", "c": "1"}
    levels = []
    for tag, by in by_level.items():
        keys = "" if tag == "c" else f"{by}, "
        part = "measure" if tag == "c" else f"{by}, measure"
        levels.append(
            f"{tag}_sk AS (SELECT {keys}measure, bucket, sum(n) AS n FROM sk GROUP BY {keys}measure, bucket), "
            f"{tag} AS (SELECT {keys}measure, max(total) AS n, min(bucket) FILTER (WHERE 4 * upto >= total) AS q1, "
            f"min(bucket) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM (SELECT *, "
            f"sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {part}) AS total "
            f"FROM {tag}_sk) GROUP BY {keys}measure)"
        )
    joins, inside = [], []
    for m in names:
        joins.append(
            f"LEFT JOIN a AS a_{m} ON a_{m}.lang = r.lang AND a_{m}.source = r.source AND a_{m}.measure = '{m}' "
            f"LEFT JOIN b AS b_{m} ON b_{m}.lang = r.lang AND b_{m}.measure = '{m}' "
            f"LEFT JOIN c AS c_{m} ON c_{m}.measure = '{m}'"
        )
        q1, q3 = (
            f"(CASE WHEN a_{m}.n >= {MIN_GROUP} THEN a_{m}.{q} WHEN b_{m}.n >= {MIN_GROUP} THEN b_{m}.{q} ELSE c_{m}.{q} END)"
            for q in ("q1", "q3")
        )
        inside.append(f"r.{m} <= {q3} + {REACH} * ({q3} - {q1}) + {SLACK[m]}")
        if m == "word_length":
            inside.append(f"r.{m} >= {q1} - {REACH} * ({q3} - {q1}) - {SLACK[m]}")
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM r WHERE NOT base_failed" for m in names)
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents),
win AS (SELECT i, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
win2 AS (SELECT i, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS x FROM win),
again AS (SELECT i, p, lead(p) OVER (PARTITION BY i ORDER BY p) AS q
  FROM (SELECT i, p, count(*) OVER (PARTITION BY i, x) AS n FROM win2) WHERE n >= 2),
rep AS (SELECT i, sum(least(3, coalesce(q - p, 3))) AS n FROM again GROUP BY i),
m AS (SELECT d.i, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN rep ON rep.i = d.i),
r AS (SELECT *, 100 * word_chars // greatest(n_words, 1) AS word_length,
  1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
sk AS (SELECT lang, source, measure, {_bucket_sql("v")} AS bucket, count(*) AS n FROM ({pairs})
  GROUP BY lang, source, measure, bucket),
{", ".join(levels)}
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
  NOT r.base_failed AND coalesce({" AND ".join(inside)}, true) AS kept
FROM r {" ".join(joins)}"""
