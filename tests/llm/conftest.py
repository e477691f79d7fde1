import pytest

DOCS = "doc_id bigint, text string, source string, lang string, n_chars bigint, kept boolean, id string, row string, n bigint, h binary, key string, hashes string, signature string"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text, source) with columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "en", -1, None, "x", "y", 3, None, "k", "z", "w") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
