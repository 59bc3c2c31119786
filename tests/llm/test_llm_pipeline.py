"""The pipeline: order, columns, and stages against what their operators say."""

import corpus_pipeline
from corpora import PASSAGE, odd_documents
from pyspark.sql import functions as F

from panelsmith.llm import decontaminate, langid, simhash
from panelsmith.llm.packing import pack
from panelsmith.session import cut_lineage


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut_lineage(stage(spark, docs, small))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            links = simhash.near_duplicates(docs)
            assert links.where("doc_id <> component_id").count() == 0
        if k == 2:
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if k == 3:
            benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
            assert decontaminate.contamination(docs, benchmark).where("contaminated").count() == 0
            kept = docs
    assert sizes[1] < sizes[0] and sizes[1] == sizes[2] and 0 < sizes[3] < sizes[2]
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    rows = sorted(map(key, corpus_pipeline.run(spark, small).collect()))
    assert rows == sorted(map(key, pack(kept).collect()))


def test_stages_odd(spark, small):
    odd = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, small)
            assert out.columns == odd.columns and out.count() <= odd.count()


def test_rows_that_differ_in_the_place_of_a_null(spark):
    """What becomes of a row does not hold for one with the same values in other columns."""
    rows = [(1, PASSAGE, None), (1, None, PASSAGE), (2, "some clean text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    items = spark.createDataFrame([("a", PASSAGE)], "item_id string, text string")
    kept = decontaminate.clean_documents(docs, items).collect()
    assert sorted((r["doc_id"], r["text"] is None) for r in kept) == [(1, True), (2, False)]
    rows = [(k, f"{PASSAGE} number {k}", "s") for k in range(60)] + [(-1, "s", None), (-1, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    found = langid.identify(langid.document_evidence(docs.withColumn("k", F.monotonically_increasing_id()), "k")).where("kept").count()
    assert langid.identified_documents(docs).count() == found
