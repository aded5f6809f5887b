import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, class string, __at int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, text, "en", "a", 1, 0.5, "x", 1),
        (1, text, "en", "a", 1, 0.5, "x", 1),
        (2, text, None, "a", None, None, None, None),
        (3, None, "en", None, 1, 0.1, "y", 2),
        (4, "", None, "b", 0, 0.1, "y", 2),
        (5, "   \n\t ", "fr", "b", 0, 0.1, "y", 2),
        (6, "short one", "en", "b", 0, 0.1, "y", 2),
        (7, "short one", "en", "b", 0, 0.1, "y", 2),
        (8, "café über 🙂 " * 5000, "de", "c", 9, 0.1, "y", 2),
        (9, "x" * 100_000, "de", "c", 9, 0.1, "y", 2),
        (None, text, "en", "c", 9, 0.1, "y", 2),
        (10, "12345 67890 ... !!!", "es", "c", 9, 0.1, "y", 2),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, None), (None, 1, 1), (6, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
