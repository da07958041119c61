"""Golden examples and properties of the chunkers."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import chunking


def split(text, size, overlap):
    return chunking.split_recursively(text, size, overlap)


def test_recursive_goldens():
    assert split("Alpha one. Beta two. Gamma three.\n\nDelta four", 20, 8) == ["Alpha one. Beta two", ". Gamma three.", "Delta four"]
    assert split("abcdefghijklmnopqrstuvwxyz", 10, 3) == ["abcdefghij", "hijklmnopq", "opqrstuvwx", "vwxyz"]
    assert split("今天天气好。我们去公园！你来吗？", 8, 2) == ["今天天气好", "。我们去公园", "！你来吗？"]
    assert split("a b c d e f g h i j", 7, 3) == ["a b c d", "d e f", "f g h", "h i j"]
    assert split("", 10, 2) == split(" \n ", 10, 2) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!？", max_size=120), st.integers(4, 30), st.integers(0, 3))
def test_recursive_properties(text, size, overlap):
    pieces = split(text, size, overlap)
    assert all(p.strip() and len(p) <= size and p in text for p in pieces)
    at = 0
    for p in pieces:  # all but white space is covered, in order
        found = text.find(p, max(0, at - overlap - size))
        assert found >= 0
        at = max(at, found + len(p))
    bare = lambda t: "".join(t.split())
    if overlap == 0:
        assert "".join(map(bare, pieces)) == bare(text)


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_windows(spark):
    rows = chunking.fixed(texts(spark, "abcdefghijkl", "abcde", "abcdefgh", "", None), 5, 2).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.content) for r in rows] == [(0, "abcde"), (0, "defgh"), (0, "ghijk"), (0, "jkl"), (1, "abcde"), (2, "abcde"), (2, "defgh")]
    rows = chunking.fixed(texts(spark, "abcdefghij"), 5, 5).orderBy("start_char").collect()
    assert [(r.start_char, r.end_char) for r in rows] == [(0, 5), (5, 10)]
    assert chunking.fixed(texts(spark, "abc"), 0, 0).count() == 0


def test_delimiter(spark):
    found = lambda text, d: [r.content for r in chunking.delimited(texts(spark, text), d).orderBy("chunk_index").collect()]
    assert found("intro ## A ## B", "## ") == ["intro", "## A", "## B"]
    assert found("## A## B", "## ") == ["## A", "## B"]
    assert found("all of it", "") == ["all of it"]
    assert found("a.*b.*c", ".*") == ["a", ".*b", ".*c"]


def test_statistics_of_nothing(spark):
    row = chunking.statistics(spark.createDataFrame([], "content string")).first()
    assert tuple(row) == (0, 0, 0, 0, 0)


def test_recursive_operator(spark):
    rows = chunking.recursive(texts(spark, "a b c d e f g h i j", None, ""), 7, 3).select("doc_id", "content", F.col("chunk_index"))
    assert [r.content for r in rows.orderBy("doc_id", "chunk_index").collect()] == ["a b c d", "d e f", "f g h", "h i j"]


def test_recursive_check_of_texts_that_repeat_themselves(spark, tmp_path):
    """Chunks of a text that says the same again and again are compared where they start, not where they are found first."""
    from lectern.plans.registry import QUERIES

    texts = ["Ier " * 5000, "De du. " * 700 + "\n" + "De " * 900, "a" * 2500, " \n ", "x  y" * 400 + "\n\n" + "ab " * 1200, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["chunk_recursive_checked"](spark, f"file://{tmp_path}").collect()}
    assert all(tuple(rows[i])[2:] == (True,) * 5 for i in range(5)) and [rows[i].has_chunks for i in range(6)] == [True, True, True, False, True, False]
    for text in texts[:5]:
        spans = chunking.split_spans(text, 100, 20)
        assert all(text[at : at + len(piece)] == piece for at, piece in spans) and [piece for _, piece in spans] == chunking.split_recursively(text, 100, 20)
