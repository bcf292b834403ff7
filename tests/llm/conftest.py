from __future__ import annotations

import pytest

EXTRA = "kept boolean, text_sha256 string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns named like results."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5, True, "x"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5, False, None),
        (3, "", "en", None, 0, None, None),
        (4, None, None, None, None, None, None),
        (5, long, "en", "b", len(long), True, "y"),
        (6, long + " tail", "en", "b", len(long), True, "y"),
        (7, "x", "de", "a", 1, True, "z"),
        (7, "x", "de", "a", 1, True, "z"),
        (8, "eins", "de", "a", 1, True, "z"),
        (8, "zwei drei", "de", "a", 1, True, "z"),
        (None, "ohne id", "de", "c", 7, True, "z"),
        (9, " \t\n ", "fr", "c", 4, True, "z"),
        (10, "... !!! 123", None, "c", 4, True, "z"),
        (11, "é" * 5000 + " 日本語 🙂", "fr", "c", 4, True, "z"),
    ]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
