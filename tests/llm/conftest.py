import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, copies, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3), (5, "one two", "en", "b", 7),
        (6, LONG, "en", "c", len(LONG)), (7, LONG, "en", "c", len(LONG)), (8, "Ünïcode 今天 天气 😀 x", None, "c", 20), (9, "one two three four", "en", None, 18),
        (10, "ONE two\nthree\rfour", "en", "a", 18), (None, "no id here at all", "en", "a", 17), (11, "same row", "en", "a", 8), (11, "same row", "en", "a", 8),
        (12, "x" * 50_000, "zz", "b", 50_000), (-3, "below zero", "en", "b", 10),
    ]
    rows = [(*r, "shadow", 7, 1.5) for r in rows]
    return spark.createDataFrame(rows, SCHEMA + ", fingerprint string, size int, score double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


