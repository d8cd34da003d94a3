"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# documents with nulls in any column, empty and repeated rows, ties, and columns whose names operators use themselves
ODD_DOCS = [
    (1, "the quick brown fox jumps over the lazy dog\nline two\nline three\nline four", "en", "a", 70),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "the quick brown fox jumps over the lazy dog\nline two\nline three\nline four", "en", None, 70),
    (4, "the quick brown fox jumps over the lazy dog\nline two\nline three\nline four", "en", "b", 70),
    (4, "the quick brown fox jumps over the lazy dog\nline two\nline three\nline four", "en", "b", 70),
    (4, "another text under the same id", "en", "b", 30),
    (5, "   \n\t ", "en", "a", 6),
    (6, "naïve café — 日本語 text 🙂", "fr", "a", 24),
    (7, "x" * 50_000, "en", "a", 50_000),
    (8, "word " * 30_000, "en", "a", 150_000),
]
EXTRA = ["shard", "slot", "size", "fp", "key", "ids", "matches", "_runs", "runs", "_text", "_doc", "component_id", "h", "w", "count"]


@pytest.fixture()
def odd_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD_DOCS, DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
