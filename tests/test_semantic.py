"""The learnt embedder against numpy and on near copies."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import bm25, semantic, vectors
from lectern.plans import base


def test_singular_values(spark):
    """The same as those of the whole matrix, made at once."""
    rows = bm25.count_tokens(base.chunks(spark, "/root/testdata/sf0.001")).select("toks", "tfs")
    model = semantic.fit(rows, 8, rounds=12)
    texts = [dict(zip(r.toks, r.tfs)) for r in rows.collect()]
    df = Counter(t for c in texts for t in c)
    number = {t: i for i, t in enumerate(df)}
    matrix = np.zeros((len(texts), len(df)))
    for i, c in enumerate(texts):
        for t, n in c.items():
            matrix[i, number[t]] = (1 + np.log(n)) * np.log((len(texts) + 1) / (df[t] + 1))
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    expected = np.linalg.svd(matrix, compute_uv=False)[:8]
    assert model.singular[:5] == pytest.approx(expected[:5], rel=1e-2) and model.singular == pytest.approx(expected, rel=5e-2)
    assert np.allclose(model.basis.T @ model.basis, np.eye(8), atol=1e-9)


def test_like_texts_are_near(spark):
    """Words of one subject are near though no text has both; a provider under a name of its own."""
    subjects = [["lion", "tiger", "panther"], ["bond", "stock", "share"]]
    context = [["jungle", "prey", "paw", "roar"], ["market", "price", "trade", "yield"]]
    draw = np.random.default_rng(0)
    texts = [(i, f"{subjects[i % 2][i // 2 % 3]} {' '.join(draw.choice(context[i % 2], 3))}") for i in range(240)] + [(900, ""), (901, None)]
    rows = spark.createDataFrame(texts, "document_id long, content string").withColumn("chunk_index", F.lit(0))
    semantic.register(spark, semantic.fit(bm25.count_tokens(rows), 2), "semantic-test")
    found = {r.content: np.array(r.embedding) for r in vectors.embed(spark.createDataFrame([("lion",), ("panther",), ("stock",), ("",), (None,), ("unknown",)], "content string"), 2, provider="semantic-test").collect()}
    assert found["lion"] @ found["panther"] > 0.95 > 0.5 > abs(found["lion"] @ found["stock"])
    assert not found[""].any() and not found[None].any() and not found["unknown"].any()
    with pytest.raises(ValueError, match="dimensions"):
        vectors.embed(rows, 3, provider="semantic-test")
    assert vectors.dimension(spark, "semantic-test", 2) == 2
    assert semantic.fit(bm25.count_tokens(rows.limit(0)), 4).basis.shape[0] == 0
    del vectors.EMBEDDERS["semantic-test"]


def test_near_copies_come_first(spark):
    """A text with some words changed is nearest to its original."""
    rows = base.chunks(spark, "/root/testdata/sf0.001").where("length(content) > 600 and chunk_index = 0")
    semantic.register(spark, semantic.fit(bm25.count_tokens(rows), 32), "semantic-copies")
    embedded = vectors.embed(rows, 32, provider="semantic-copies").select("document_id", "chunk_index", "embedding")
    changed = rows.where("document_id % 5 = 0").select(F.col("document_id").alias("query_id"), F.concat(F.lit("other words here "), F.substring("content", 1, 500)).alias("content"))
    wanted = vectors.embed(changed, 32, provider="semantic-copies").select("query_id", "embedding")
    # Copies among the documents tie, so the original is among the first few.
    found = vectors.nearest(embedded, wanted, ["document_id", "chunk_index"], 5).collect()
    ids = {r.query_id for r in found}
    assert len(ids) > 5 and sum(any(r.document_id == q for r in found if r.query_id == q) for q in ids) >= 0.9 * len(ids)
    del vectors.EMBEDDERS["semantic-copies"]


def test_tokens_become_numbers_once(spark, monkeypatch):
    """Rounds read the stored matrix: the texts' tokens are read for their frequencies and for the entries, not again in each round."""
    made, before = [], semantic.written
    monkeypatch.setattr(semantic, "written", lambda df, path: made.append(before(df, path)) or made[-1])
    rows = bm25.count_tokens(base.chunks(spark, "/root/testdata/sf0.001"))
    semantic.fit(rows, 4, rounds=3)
    assert len(made) == 1 and made[0].agg(F.sum("n")).first()[0] == rows.count()
    tokens, entries = rows.select(F.sum(F.size("toks"))).first()[0], made[0].agg(F.sum(F.octet_length("data") / 8)).first()[0]
    assert entries == tokens
