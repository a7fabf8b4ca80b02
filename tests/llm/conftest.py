import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text[, lang, source]) rows."""

    def make(rows):
        full = [(r + (None, None, None))[:4] + (len(r[1] or ""),) for r in map(tuple, rows)]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, and repeated rows."""
    long_text = " ".join(f"word{k % 977}" for k in range(60_000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", "a"),
        (4, "one", "en", "a"),
        (4, "one", "en", "a"),
        (4, "two words", "en", None),
        (None, "a row without an id has words too", "en", "b"),
        (None, None, "en", "b"),
        (7, long_text, "en", "c"),
        (8, long_text, "en", "c"),
        (9, "Ünïcödé \U0001f600 text <|endoftext|> it's \x00 odd", None, "d"),
    ]
