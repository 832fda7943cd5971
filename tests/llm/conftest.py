import json
import os

import pytest

SF = os.environ.get("TEXTLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns whose names operators use inside."""
    long_text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3000
    rows = [
        (1, "Hello world, this is a small text with a dozen words in it today.", "en", "s", 1),
        (1, "Hello world, this is a small text with a dozen words in it today.", "en", "s", 1),
        (2, None, "en", "s", None),
        (3, "", None, None, 0),
        (4, " \t\n", "en", "s", 3),
        (5, long_text, "en", "s", len(long_text)),
        (6, "x" * 5000, "de", "s", 5000),
        (7, "ÄÖÜ é 中文字   emoji 😀 <|endoftext|> a b", "fr", "s", 9),
        (None, "no id here but words enough to count for something at all", None, "s", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "doc_id as rid", "text as words", "1 as shard", "'k' as kind", "lang as gid", "n_chars as score")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
