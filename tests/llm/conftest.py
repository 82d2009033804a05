import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, TEXT string"


@pytest.fixture
def as_docs(spark, docs_schema):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table with clashing extra columns."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None, "x", "y") for r in rows]
        return spark.createDataFrame(full, docs_schema)
    return make
