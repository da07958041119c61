"""The learnt reranker against explicit pairs, on held-out passages and on odd hits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import rerank
from lectern.plans import search_queries
from lectern.sources import shared

HITS = "query_id long, document_id long, chunk_index int, vector_score double, bm25_score double, score double, content string"


def judged(spark, n=30, hits=8, seed=3):
    """Hits whose relevance hangs on three features and noise."""
    draw, rows = np.random.default_rng(seed), []
    for q in range(n):
        x = draw.normal(size=(hits, len(rerank.FEATURES))) * np.arange(1, 9)
        x[:, 6] = 5.0  # the same in all hits
        worth = x[:, 1] - 0.2 * x[:, 4] + 0.3 * x[:, 7] + draw.normal(size=hits)
        rows += [(q, x[i].tolist(), bool(worth[i] >= np.sort(worth)[-2])) for i in range(hits)]
    return rows, spark.createDataFrame(rows, "query_id long, features array<double>, relevant boolean")


def test_optimum_over_all_pairs(spark, monkeypatch):
    """At the weights found, the gradient of the loss over pairs made one by one, and of the ridge, is zero; so it is with blocks of three hits."""
    rows, frame = judged(spark)
    model = rerank.fit(frame, ridge=0.01)
    lists = [[[f for i, f, r in rows if i == q and r == yes] for yes in (True, False)] for q in range(30)]
    lists = spark.createDataFrame(lists, "good array<array<double>>, other array<array<double>>")
    whole = rerank._pass(lists, model.weight)
    monkeypatch.setattr(rerank, "ROWS", 3)
    assert all(np.allclose(a, b) for a, b in zip(whole, rerank._pass(lists, model.weight)))
    spread = np.std([f for _, f, _ in rows], axis=0)
    slope, loss = np.zeros(8), 0.0
    for q in range(30):
        good, other = ([np.array(f) for i, f, r in rows if i == q and r == yes] for yes in (True, False))
        for a in good:
            for b in other:
                margin = model.weight @ (a - b)
                loss += np.log1p(np.exp(-margin)) / len(good) / len(other) / 30
                slope -= (a - b) / (1 + np.exp(margin)) / len(good) / len(other) / 30
    used = spread > 1e-9
    assert model.queries == 30 and model.loss == pytest.approx(loss, rel=1e-6) and model.weight[6] == 0
    assert np.allclose(slope[used] / spread[used] + 0.01 * model.weight[used] * spread[used], 0, atol=1e-4)  # by weights in units of the spread
    assert model.weight[1] > 0.3 > 0 > model.weight[4] and model.weight[7] > 0
    nothing = rerank._pass(lists.limit(0), np.zeros(8))
    assert nothing[0] == 0 and not nothing[1].any()


def test_untaught_models_keep_the_fused_order(spark):
    """Queries of one kind of hits teach nothing; nulls are no relevance."""
    rows = [(0, [1.0] * 8, True), (0, [2.0] * 8, True), (1, [1.0] * 8, False), (1, [3.0] * 8, None)]
    for few in (rows, []):
        model = rerank.fit(spark.createDataFrame(few, "query_id long, features array<double>, relevant boolean"))
        assert model.queries == 0 and model.weight.tolist() == [0, 0, 0, 0, 1, 0, 0, 0]
    hits = spark.createDataFrame([(0, 5, 0, 0.5, None, 0.3, "a b"), (0, 4, 0, None, 2.0, 0.6, None), (0, 3, 0, 0.1, 1.0, 0.3, "")], HITS)
    found = rerank.reranked(hits, spark.createDataFrame([(0, "A, b!"), (1, "no hits")], "query_id long, text string"), model, 5).orderBy("rank").collect()
    assert [(r.document_id, r.rerank_score) for r in found] == [(4, 0.6), (3, 0.3), (5, 0.3)]


def test_features(spark):
    hits = spark.createDataFrame([(0, 1, 0, 0.9, 3.0, 0.8, "Red green, blue"), (0, 2, 0, 0.5, None, 0.3, "green red"), (0, 3, 0, 0.1, 1.0, 0.2, None), (1, 1, 0, 0.4, None, 0.4, "x")], HITS)
    rows = rerank.features(hits, spark.createDataFrame([(0, "red green red"), (1, None)], "query_id long, text string")).orderBy("query_id", "document_id").collect()
    expected = [
        [1, 1, 1 / 11, 1 / 11, 0.8, 1, 0.5 + 0.5 * 0, np.log(4)], [0.5, 0, 1 / 12, 0, 0.3, 1, 0.5, np.log(3)],
        [0, 0, 1 / 13, 1 / 12, 0.2, 0, 0, 0], [1, 0, 1 / 11, 0, 0.4, 0, 0, np.log(2)],
    ]
    assert np.allclose([r.features for r in rows], expected)


def test_model_round_trip(spark, tmp_path):
    model, path = rerank.fit(judged(spark)[1]), f"file://{tmp_path}/model"
    rerank.save(spark, model, path)
    again = rerank.load(spark, path)
    assert (again.weight == model.weight).all() and (again.queries, again.loss) == (model.queries, model.loss)
    shared.written(spark.read.parquet(path).withColumn("feature", F.lit("other")), f"file://{tmp_path}/other")
    with pytest.raises(ValueError, match="other features"):
        rerank.load(spark, f"file://{tmp_path}/other")


def test_held_out_passages(spark):
    """Passages that the model never saw come nearer to the top than in the fused order."""
    queries, rows = search_queries.judged_hits(spark, "/root/testdata/sf0.01")
    fused, learnt = rerank.reciprocal_rank(rows).first(), rerank.reciprocal_rank(search_queries.learnt_order(queries, rows, 20)).first()
    assert fused.n_queries == learnt.n_queries > 10 and learnt.mrr > max(0.9, fused.mrr)
