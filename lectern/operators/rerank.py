"""A reranker that is learnt: hits in the order of a weighted sum of what is known of them, fitted on judged hits.

The weights minimise the pairwise logistic loss: of a query's hits each relevant one should score above each other one, and every query
counts the same. It is convex, so Newton steps find the one optimum; a step is a distributed pass over stored lists of hits, of which
only a loss, a gradient and a square matrix of ``FEATURES`` come to the driver. A query's pairs are summed as matrix products, never made.

Defined results: a missing leg counts as its lowest score and no rank, a null content or question as an empty one; queries whose hits are all
relevant or none teach nothing; a model that nothing taught has the fused score's order; of equal scores the smaller key comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators.bm25 import KEY
from lectern.sources.shared import scratch, written

#: What a hit is judged by: the legs' scores within 0..1 of the query's, their places, the fused score, shares of the question's tokens and of their pairs, and the content's length.
FEATURES = ("vector", "keyword", "vector_place", "keyword_place", "fused", "tokens", "pairs", "length")
#: Added to a place before its reciprocal is taken; weight of the squares of the weights against a query's loss; passes; other hits that meet all relevant ones at a time.
PLACE, RIDGE, PASSES, ROWS = 10, 0.01, 40, 4096


@dataclass
class Model:
    """``weight`` belongs to ``FEATURES`` as they are; ``queries`` taught it, and ``loss`` is left to each of the ln 2 that weights of 0 have."""

    weight: np.ndarray
    queries: int
    loss: float


def _share(asked: Column, has: Column) -> Column:
    return F.size(F.array_intersect(asked, has)) / F.greatest(F.size(asked), F.lit(1))


def _pairs(words: Column) -> Column:
    """Each token with the one that follows it."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def features(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``hits`` (query_id, key, vector_score, bm25_score, score, content) of ``queries`` (query_id, text) with ``features``, an array in the order of ``FEATURES``.

    Places and ranges are those within the query's hits.
    """
    query = Window.partitionBy("query_id")

    def leg(score: str) -> tuple[Column, Column]:
        low, high = F.min(score).over(query), F.max(score).over(query)
        scaled = F.when(high > low, (F.col(score) - low) / (high - low)).when(F.col(score).isNotNull(), 1.0)
        place = F.when(F.col(score).isNotNull(), 1.0 / (PLACE + F.rank().over(query.orderBy(F.col(score).desc_nulls_last()))))
        return F.coalesce(scaled, F.lit(0.0)), F.coalesce(place, F.lit(0.0))

    (vector, vector_place), (keyword, keyword_place) = leg("vector_score"), leg("bm25_score")
    asked = queries.select("query_id", tokens(F.coalesce("text", F.lit(""))).alias("_asked"))
    asked = asked.select("query_id", F.array_distinct("_asked").alias("_words"), F.array_distinct(_pairs(F.col("_asked"))).alias("_asked_pairs"))
    rows = hits.join(asked, "query_id").withColumn("_has", tokens(F.coalesce("content", F.lit(""))))
    known = [
        vector, keyword, vector_place, keyword_place, F.coalesce("score", F.lit(0.0)),
        _share(F.col("_words"), F.col("_has")), _share(F.col("_asked_pairs"), _pairs(F.col("_has"))), F.log1p(F.size("_has")),
    ]
    return rows.withColumn("features", F.array(*[c.cast("double") for c in known])).drop("_words", "_asked_pairs", "_has")


def _pass(lists: DataFrame, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums of the loss, its gradient and its second derivatives over all queries."""
    n = len(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + n + n * n)
        for batch in batches:
            for good, other in zip(batch.column(0), batch.column(1)):
                good, other = (np.asarray(side.values.flatten(), dtype=float).reshape(-1, n) for side in (good, other))
                count, score = len(good) * len(other), good @ weight
                for at in range(0, len(other), ROWS):
                    rest = other[at : at + ROWS]
                    margin = score[:, None] - (rest @ weight)[None, :]
                    wrong = 0.5 * (1 - np.tanh(margin / 2))
                    bend = wrong * (1 - wrong)
                    mixed = good.T @ bend @ rest
                    total[0] += np.logaddexp(0, -margin).sum() / count
                    total[1 : 1 + n] -= (wrong.sum(axis=1) @ good - wrong.sum(axis=0) @ rest) / count
                    square = (good.T * bend.sum(axis=1)) @ good + (rest.T * bend.sum(axis=0)) @ rest - mixed - mixed.T
                    total[1 + n :] += square.ravel() / count
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = lists.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = np.zeros(1 + n + n * n)
    for i, x in parts.collect():  # 73 rows
        total[i] = x
    return total[0], total[1 : 1 + n], total[1 + n :].reshape(n, n)


def fit(judged: DataFrame, ridge: float = RIDGE, passes: int = PASSES) -> Model:
    """Learn from ``judged`` (query_id, features, relevant), hits of searches that have a k; features are weighed by their spread."""
    spark, n = judged.sparkSession, len(FEATURES)
    side = lambda yes: F.collect_list(F.when(F.coalesce("relevant", F.lit(False)) == yes, F.col("features")))
    lists = judged.groupBy("query_id").agg(side(True).alias("good"), side(False).alias("other")).where((F.size("good") > 0) & (F.size("other") > 0))
    lists = written(lists.select("good", "other"), scratch(spark, "judged-hits"))
    every = lists.select(F.explode(F.concat("good", "other")).alias("f")).agg(*[F.stddev_pop(F.col("f")[i]) for i in range(n)]).first()
    queries, spread = lists.count(), np.array([s or 0.0 for s in every])
    if not queries:
        return Model(np.eye(n)[FEATURES.index("fused")], 0, 0.0)
    usable = spread > 1e-9  # of what is the same in all hits nothing is learnt
    scale = np.where(usable, 1 / np.where(usable, spread, 1), 0.0)

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, bend = _pass(lists, u * scale)
        return loss / queries + ridge / 2 * u @ u, slope * scale / queries + ridge * u, bend * np.outer(scale, scale) / queries + ridge * np.eye(n)

    here = np.zeros(n)
    loss, slope, bend = at(here)
    step = np.linalg.solve(bend, -slope)
    for _ in range(passes):
        found = at(here + step)
        if found[0] > loss + 1e-12:
            step = step / 2
            continue
        here, gain, (loss, slope, bend) = here + step, loss - found[0], found
        if gain < 1e-9:
            break
        step = np.linalg.solve(bend, -slope)
    return Model(here * scale, queries, float(loss - ridge / 2 * here @ here))


def score(model: Model, features: Column) -> Column:
    """The weighted sum, in the JVM."""
    return sum((F.lit(float(w)) * features[i] for i, w in enumerate(model.weight)), F.lit(0.0))


def reranked(hits: DataFrame, queries: DataFrame, model: Model, k: int, decimals: int = 6) -> DataFrame:
    """The k best of the hits by the model, with rerank_score and rank; of equal scores the smaller key comes first."""
    rows = features(hits.drop("rank"), queries).withColumn("rerank_score", F.round(score(model, F.col("features")), decimals)).drop("features")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), *KEY)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank(ranked: DataFrame, relevant: str = "relevant") -> DataFrame:
    """One row: the queries that have a relevant hit, and the mean reciprocal rank of their first one."""
    first = ranked.where(F.col(relevant)).groupBy("query_id").agg(F.min("rank").alias("first"))
    return first.agg(F.count("*").alias("n_queries"), F.avg(1 / F.col("first")).alias("mrr"))


def save(spark: SparkSession, model: Model, path: str) -> None:
    rows = [(i, name, float(w), model.queries, model.loss) for i, (name, w) in enumerate(zip(FEATURES, model.weight))]
    spark.createDataFrame(rows, "i int, feature string, weight double, queries long, loss double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).orderBy("i").collect()  # a row per feature
    if tuple(r.feature for r in rows) != FEATURES:
        raise ValueError("the model was fitted on other features")
    return Model(np.array([r.weight for r in rows]), rows[0].queries, rows[0].loss)
