import pytest

LONG = " ".join(f"w{i}" for i in range(30_000))

#: Nulls in every column, empty, blank and very long texts, ties, repeated rows; further columns bear names the operators use.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank\nA second line of words here", "en", "a", 10, 5, "x", 1, 2.0, 3),
    (2, "The quick brown fox jumps over the lazy dog near the river bank\nA second line of words here", "en", "a", 10, 5, "x", 1, 2.0, 3),
    (2, "The quick brown fox jumps over the lazy dog near the river bank\nA second line of words here", "en", "a", 10, 5, "x", 1, 2.0, 3),
    (3, None, "en", "b", None, None, None, None, None, None),
    (4, "", None, None, 0, 0, "", 0, 0.0, 0),
    (5, " \t\r\n \x0b\x0c", "de", None, 0, 0, "", 0, 0.0, 0),
    (None, "a row without an id but with words", "fr", "b", 1, 1, "y", 1, 1.0, 1),
    (None, None, None, None, None, None, None, None, None, None),
    (6, LONG, "en", "a", 1, 1, "z", 1, 1.0, 1),
    (7, "été \U0001f600 日本語 Ünïcödé ŝ", "fr", "c", 1, 1, "z", 1, 1.0, 1),
    (8, "one", "en", "c", 1, 1, "z", 1, 1.0, 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id string, n_shingles long, score double, removed_lines int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()
