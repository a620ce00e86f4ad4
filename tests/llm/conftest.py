import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and
    extra columns named like the operators' own results."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta " * 20, "en", "a", 460, 9, True),
        (1, "alpha beta gamma delta " * 20, "en", "a", 460, 9, True),
        (2, None, "en", "a", None, 9, None),
        (3, "", None, None, 0, None, True),
        (None, "one two three four five six seven", "de", "b", 33, 9, False),
        (4, "one two three four five six seven", "de", None, 33, 9, False),
        (5, long, "en", "b", len(long), 9, True),
        (6, " \n\t ", "en", "c", 4, 9, True),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, kept boolean").cache()


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return spark.createDataFrame([], odd_documents.schema)
