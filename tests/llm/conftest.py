import os

import pytest

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    return SF_DIR


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators use inside."""
    long_text = " ".join(f"Word{i % 997} of{i}." for i in range(150_000)) + "\nlast line"
    rows = [
        (1, None, "en", "a", 1), (2, "", "en", "b", 1), (3, " \t\n ", None, None, 1), (4, "one two", "en", "a", 1), (4, "one two", "en", "a", 1),
        (5, "One TWO", "en", "a", 2), (6, long_text, "en", "b", 3), (7, long_text + " x", "en", "b", 3), (None, "no id here at all", "en", "c", 1),
        (8, "ÀÉ straße 你好 ZEBRA\r\nline", "fr", "a", 1), (9, "ÀÉ straße 你好 zebra\nline", "fr", "a", 1), (10, None, None, None, None),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, key string, score double, segment string, shard int"
    return spark.createDataFrame([(*r, 1, "k", 0.5, "s", 3) for r in rows], schema)
