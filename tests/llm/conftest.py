"""Small tables with the cases every operator must bear."""

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, source) of the smallest table."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like results."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    some = "the quick brown fox jumps over the lazy dog and runs away from the small red house near the river bank today"
    rows = [
        (1, some, "a"), (2, some, "a"), (2, some, "a"), (3, some.upper() + " now", None), (4, None, "b"), (5, "", "b"), (6, " \n\t ", None),
        (None, some, "c"), (None, None, None), (7, long, "a"), (8, "one two", "b"), (9, "ONE  two", "b"), (10, "x@y.example +1 (903) 555-1234 <|endoftext|> ok", "é"),
        (11, "日本語 テキスト 👩‍👩‍👧 naïve\u00a0café\u2028x", "é"),
    ]
    rows = [(i, t, s, 1.5, "kept", 7) for i, t, s in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double, kept string, size int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
