import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, bucket int, items string, row string, name string, word string, n int, token string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text) rows, with further columns whose names the operators use too."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), 7, "k", 1, "x", "r", "nm", "w", 3, "t") for i, t in rows], SCHEMA)

    return make


ODD_ROWS = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (4, "two words"), (None, "one"), (None, None), (5, "é" * 50 + " <|endoftext|> 12 don't!"), (6, "word " * 30_000)]


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return documents(ODD_ROWS)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
