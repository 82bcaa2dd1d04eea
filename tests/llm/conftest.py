import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) with extra columns of clashing names."""

    def make(rows, extra=()):
        schema = DOCS + "".join(f", {c} string" for c in extra)
        full = [(i, t, "en", "src0", len(t or ""), *["x"] * len(extra)) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


CLASH = ["host", "path", "score", "root", "line", "first", "start", "end", "keys", "fp", "words", "rank", "item_id", "kind", "spans"]
