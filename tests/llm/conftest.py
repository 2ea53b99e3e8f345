import pytest

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (id, text[, source]) rows, with columns whose names clash with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 1, "x") for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + ", n_words int, key string")
    return make


@pytest.fixture
def bare_docs(spark):
    return lambda rows: spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1) for r in rows], DOC_SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
