import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """A documents table from (doc_id, text) pairs or whole rows."""
    def make(rows, schema=DOCS):
        full = [r if len(r) > 2 else (*r, "en", f"src{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)
    return make
