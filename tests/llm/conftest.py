import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(*rows):
        """Rows of (doc_id, text[, lang]); two extra columns have names that clash with ones
        the operators use inside."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, 1, "x") for r in rows]
        return spark.createDataFrame(full, DOCS + ", k long, sid string").repartition(3)

    return make


@pytest.fixture(scope="session")
def sample():
    """Whole texts of the smallest test table."""
    import os

    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{path}'").fetchall()
