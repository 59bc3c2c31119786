"""Documents that operators must not trip over."""

from pyspark.sql import functions as F

#: Names that operators use inside, as columns of the input they must not trip over.
CLASHING = ["n_words", "fp", "key", "row", "score", "component_id", "kept", "shard", "group", "_mark", "_key", "c0", "part", "y", "x"]

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions in the old tower by the sea"


def odd_documents(spark, clashing=True):
    """Nulls, empty and very long texts, repeated rows, an id with two texts, odd characters."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, f"First text. {PASSAGE}. End of it", "en", "s0"),
        (2, None, "en", "s0"),
        (3, "", None, None),
        (None, f"no id {PASSAGE} here", "en", "s1"),
        (4, long_text, "en", "s0"),
        (5, f"Copy {PASSAGE} one", "de", "s0"),
        (5, f"Copy {PASSAGE} one", "de", "s0"),
        (5, "another text under the same id", "de", None),
        (6, " \t\n ", "xx-YY", "s0"),
        (7, "a\x00b éè \U0001f600    x", "nonsense!", "s0"),
        (8, "ends with <|endoftext|> inside  two  spaces \n\n", "fr", "s2"),
        (-9, "na " * 3000, "en", "s0"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    if clashing:
        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df
