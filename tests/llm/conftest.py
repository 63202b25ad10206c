import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, key string"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table with further columns whose names clash with those the operators make."""
    def build(rows):
        full = [(r[0], r[1], *(r[2:4] or (None, None)), None if r[1] is None else len(r[1]), 9.0, "r", "k") for r in rows]
        return spark.createDataFrame(full, COLUMNS)
    return build
