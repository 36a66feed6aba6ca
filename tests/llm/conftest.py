import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long = " ".join(f"word{i % 97}" for i in range(30_000))
    rows = [
        (1, "one two three four five", "a", 1, "x"),
        (1, "one two three four five", "a", 1, "x"),
        (2, "one two three four five", None, 2, None),
        (3, None, "a", None, "x"),
        (4, "", "b", 4, "x"),
        (None, "mail me at some.one@example.com now", "b", 5, "x"),
        (None, None, None, None, None),
        (5, long, "b", 6, "x"),
        (6, "éè 日本語 \U0001f389 ▁ <|endoftext|> <s> \t\n", "c", 7, "x"),
        (7, "x" * 20_000, "c", 8, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp long, size string").selectExpr("*", "doc_id AS h", "doc_id AS target", "source AS mask", "1 AS n")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
