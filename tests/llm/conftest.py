import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, place string"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(30000))
    a = ("the quick brown fox jumps over the lazy dog near the old river bank today", "en", "s1")
    rows = [(1, *a), (1, *a), (2, *a), (3, None, "en", "s1"), (4, "", None, None), (5, long, "de", "s2"), (None, "no id here but words that go on for a while and more of them", "en", None), (6, "short", "fr", "s3"), (7, "x " * 40, "fr", "s3"), (1, "same id other text entirely, with enough words to count as a document", "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "clash", "clash") for r in rows], DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
