import pytest

ODD_TEXTS = [None, "", " \n\t ", "one", "a b c", "Ünï cödé ñ € 😀 text\nline two\n\nline two", "x" * 5000, "word " * 3000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, "s", t, i % 2, "k") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[3], (None, "a b c", None, None, None, None), (4, "another text of the same id", "s", None, 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, host string, n_words int, key string")
