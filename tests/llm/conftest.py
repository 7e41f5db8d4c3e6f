import pytest

#: Null and empty texts, ties, repeated rows, few and many words, clashing extra columns.
ROWS = [
    (1, "Hello World", "en", "s1"),
    (2, "hello world", "en", "s1"),
    (3, None, None, None),
    (4, "", "de", "s1"),
    (5, "HELLO WORLD", "en", "s2"),
    (5, "HELLO WORLD", "en", "s2"),
    (6, "É hello", "fr", "s1"),
    (7, "é hello", "fr", "s1"),
    (8, " \n\t\n", "en", "s1"),
    (9, "one two three four five six seven " * 2000, "en", "s1"),
    (None, "Hello World", "en", "s1"),
    (None, "a null id of its own", "en", "s1"),
    (10, "12345 678 !!", "en", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents with columns whose names operators use within."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(k) for k, c in enumerate(["row", "digest", "key", "score", "count", "a", "b", "id", "t", "sig", "n_chars"])})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
