import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, label int, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with names that clash."""
    long = " ".join(f"word{i % 977}" for i in range(60_000)) + "\n" + "tail line that is long enough to count\n" * 3
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, 0.5, 1, "k"),
        (3, " \t\n\x0b\x0c\r ", "en", "a", 7, 0.5, 1, "k"),
        (4, long, "en", "a", len(long), 0.1, 0, "k"),
        (5, "one two three", "en", "b", 13, 0.1, 0, "k"),
        (5, "one two three", "en", "b", 13, 0.1, 0, "k"),
        (None, "a text without an id but with a few words in it", "fr", "b", 47, None, None, None),
        (7, "éàü 日本語 😀 é ﬁ ▁x 　 z", "de", None, 1, 0.0, 0, ""),
        (8, "A shared line of some length here\nown eight", "es", "a", 1, 0.0, 0, ""),
        (9, "own nine\n  a SHARED line of some length here\t", "es", "a", 1, 0.0, 0, ""),
        (10, "a shared line of some length here\na shared line of some length here", "es", "c", 1, 0.0, 0, ""),
        (-(1 << 63), "12345 67890 !!! ???", None, "c", 1, 0.0, 0, ""),
        ((1 << 63) - 1, "x" * 5_000, "en", "c", 1, 0.0, 0, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    """A few hundred given documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
