import pytest
from corpora import odd_documents


@pytest.fixture()
def odd(spark):
    return odd_documents(spark)


@pytest.fixture()
def odd_rows(spark):
    return [(r["doc_id"], r["text"]) for r in odd_documents(spark, False).collect()]


@pytest.fixture()
def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
