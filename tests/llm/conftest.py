import re

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless and long texts, repeated rows, and a column whose name clashes with inner ones."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today "
    rows = [
        (1, base * 12, "en", "s", 5),
        (1, base * 12, "en", "s", 5),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (4, " \t\n", "fr", "s", 3),
        (5, "x" * 200_000, "en", "s", 1),
        (6, "日本 😀 ñ\ufeff a\u2028b", "es", "s", 1),
        (None, base * 3, "en", "s", 1),
        (7, "one two", "en", None, 7),
        (8, "One TWO", "en", "s", 7),
    ]
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS score", "'x' AS found", "0 AS n_words", "'y' AS lang_pred", "2 AS block")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
