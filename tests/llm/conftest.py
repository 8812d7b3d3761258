import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A small table of documents from (doc_id, text[, lang, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "web"))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string")

    return make


@pytest.fixture(scope="session")
def documents(spark, data):
    rows = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}
