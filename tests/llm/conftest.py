import pytest

DOC = "doc_id long, text string, lang string, n_words long, row string, `a.b` int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns whose names clash."""
    words = [f"w{i}" for i in range(60)]
    long = " ".join(f"v{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, None), (2, "", "en", 5, "r", 1), (3, " \n\t ", "en", 5, "r", 1),
        (4, " ".join(words), "en", 5, "r", 1), (4, " ".join(words), "en", 5, "r", 1), (5, " ".join(words), "de", 6, "s", 2),
        (None, " ".join(words[::-1]), None, None, None, None), (None, None, None, None, None, None),
        (6, long, "en", 7, "t", 3), (7, "one", "en", 7, "t", 3), (8, "one two", "en", 7, "t", 3),
        (9, "Äöü ﬁ 😀 " * 12, "de", 7, "t", 3),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
