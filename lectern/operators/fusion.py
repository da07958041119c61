"""Hybrid retrieval: two ranked legs, normalised and put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators.bm25 import KEY


def min_max(hits: DataFrame, score: str, into: str) -> DataFrame:
    """Per query to 0..1; where all scores are equal, 0."""
    query = Window.partitionBy("query_id")
    low, high = F.min(score).over(query), F.max(score).over(query)
    return hits.withColumn("_low", low).withColumn("_high", high).withColumn(
        into, F.when(F.col("_high") > F.col("_low"), (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    ).drop("_low", "_high")


def _fused(vector: DataFrame, keyword: DataFrame, score: Column, k: int | None, decimals: int) -> DataFrame:
    rows = vector.join(keyword, ["query_id", *KEY], "full_outer").withColumn("score", F.round(score, decimals))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *KEY)
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows if k is None else rows.where(F.col("rank") <= k)
    return rows.select("query_id", "rank", *KEY, "vector_score", "bm25_score", "score")


def weighted(vector: DataFrame, keyword: DataFrame, alpha: float, k: int | None = None, decimals: int = 6) -> DataFrame:
    """alpha times the normalised vector score and the rest of the normalised BM25 score; a missing side is 0."""
    v, b = min_max(vector, "vector_score", "_v"), min_max(keyword, "bm25_score", "_b")
    return _fused(v, b, alpha * F.coalesce("_v", F.lit(0.0)) + (1 - alpha) * F.coalesce("_b", F.lit(0.0)), k, decimals)


def reciprocal_rank(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, k: int | None = None, constant: int = 60, decimals: int = 6) -> DataFrame:
    """Weight over ``constant`` + rank, summed over the legs; ranks as the legs have them."""
    v, b = vector.withColumnRenamed("rank", "_v"), keyword.withColumnRenamed("rank", "_b")
    part = lambda weight, rank: F.coalesce(weight / (constant + F.col(rank)), F.lit(0.0))
    return _fused(v, b, part(F.lit(alpha), "_v") + part(F.lit(1 - alpha), "_b"), k, decimals)


def raw(vector: DataFrame, keyword: DataFrame, k: int | None = None, decimals: int = 6) -> DataFrame:
    """The legs' own scores side by side, the vector leg's first: kept for comparison with services that rank so."""
    return _fused(vector.drop("rank"), keyword.drop("rank"), F.coalesce("vector_score", "bm25_score"), k, decimals)


def reranked(hits: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], k: int, decimals: int = 6) -> DataFrame:
    """The k best of the hits (query_id, key, content) by ``score(query text, content)``; a cross encoder plugs in as a function of two columns.

    Add rerank_score and rank; of equal scores the smaller key comes first.
    """
    rows = hits.drop("rank").join(queries.select("query_id", "text"), "query_id")
    rows = rows.withColumn("rerank_score", F.round(score(F.col("text"), F.col("content")), decimals)).drop("text")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), *KEY)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def overlap(query: Column, content: Column) -> Column:
    """The share of a query's different tokens that a content has."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(content))) / F.when(F.size(asked) > 0, F.size(asked)).otherwise(1)
