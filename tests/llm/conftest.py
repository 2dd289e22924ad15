import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls in every column, blank and long texts, ties, repeated rows, and clashing extra columns."""
    rows = [(1, "a b c d e f g h", "en", "x", 15), (1, "a b c d e f g h", "en", "x", 15), (2, None, None, None, None), (None, "a b c d e f g h", None, None, None),
            (3, "", "en", "y", 0), (4, " \n\t", "en", "y", 3), (5, "word", "en", "y", 4), (6, "w" * 30_000, "de", "x", 30_000), (7, "long text\n" * 5_000, "de", "x", 50_000)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("ids", "_text", "_t", "_d", "_keep", "score", "h"):
        frame = frame.selectExpr("*", f"'extra' AS {name}")
    return frame


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
