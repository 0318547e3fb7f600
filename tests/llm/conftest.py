import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts, with ids 0.. or (id, text) pairs, and columns that clash with the operators' own."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", None, 7, "x", -1) for i, t in rows], f"{DOCS}, hits string, n_lines int")
        return df.withColumnsRenamed({"n_chars": "score"}).repartition(3)

    return make
