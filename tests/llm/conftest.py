from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, and a column of a clashing name."""
    words = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix strange potions".split()
    long = " ".join(f"{words[i * i % 15]}{i % 97}" for i in range(30_000))
    rows = [
        (1, "", "en", 1.0),
        (2, None, "en", None),
        (3, "  \n\t ", None, 2.0),
        (4, long, "en", 3.0),
        (5, " ".join(words * 3), "en", 4.0),
        (5, " ".join(words * 3), "en", 4.0),
        (6, " ".join(words * 3), None, 5.0),
        (None, " ".join(words), "xx", 6.0),
        (None, None, None, None),
        (7, "one", "de", 7.0),
        (8, "one two", "de", 8.0),
        (9, "ONE two three ÄÖ 🙂 \x00 x", "de", 9.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
