"""Dense vectors: normalising, hashing embedder, exact cosine search, clustering into lists."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators import scan

#: Bytes of query vectors that one broadcast may have; more run in blocks.
QUERY_BYTES = 32 << 20


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(vector: Column) -> Column:
    """To length 1; a zero vector stays."""
    size = norm(vector)
    size = F.array(F.when(size == 0, 1.0).otherwise(size))  # bound by the outer lambda, else each element would find it anew
    return F.transform(size, lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_embedding(dim: int):
    """A function of a column of token lists: hashed token counts as a dense vector of length 1; without tokens all zeros."""

    @F.arrow_udf("array<double>")
    def embed(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null([])
        coded = lists.flatten().dictionary_encode()
        kinds = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim if t is not None else 0 for t in coded.dictionary.to_pylist()]
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = row * dim + np.array(kinds, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(row) else row
        flat = _unit(np.bincount(at, minlength=len(lists) * dim).astype(np.float64).reshape(len(lists), dim)).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat))

    return embed


#: Embedders by provider: functions of (text column, dimension). A model plugs in under a name of its own.
EMBEDDERS: dict[str, Callable[[Column, int], Column]] = {"hashing": lambda text, dim: hash_embedding(dim)(tokens(text))}


def embedder(provider: str) -> Callable[[Column, int], Column]:
    if provider not in EMBEDDERS:
        raise ValueError(f"unknown embedding provider: {provider}")
    return EMBEDDERS[provider]


def dimension(spark: SparkSession, provider: str, dim: int = 64) -> int:
    """The length of a provider's vectors, by embedding one word."""
    return spark.range(1).select(F.size(embedder(provider)(F.lit("ping"), dim))).first()[0]


def embed(rows: DataFrame, dim: int, text: str = "content", provider: str = "hashing") -> DataFrame:
    """Add ``embedding`` of the column ``text``."""
    return rows.withColumn("embedding", embedder(provider)(F.col(text), dim))


def hash_embed(chunks: DataFrame, dim: int, *keys: str, text: str = "content") -> DataFrame:
    """keys, bucket, weight: what is not 0 of the hashing embedder's vectors."""
    rows = embed(chunks.select(*keys, text), dim, text)
    return rows.select(*keys, F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")


def top_k(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None, scope: Column | None = None, decimals: int = 6) -> DataFrame:
    """vec_id, score of the k vectors nearest to one query by cosine; ``scope`` filters before scoring, ``threshold`` after."""
    if scope is not None:
        vectors = vectors.where(scope)
    size = math.sqrt(sum(x * x for x in query)) or 1.0
    wanted = F.array(*[F.lit(float(x) / size) for x in query])
    own = norm(F.col("embedding"))
    scored = vectors.select("vec_id", F.round(dot(F.col("embedding"), wanted) / F.when(own == 0, 1.0).otherwise(own), decimals).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(sizes == 0, 1, sizes)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cosines(wanted: np.ndarray, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    own = _unit(_matrix(batch.column("embedding")))
    for start in range(0, len(wanted), 256):
        yield from wanted[start : start + 256] @ own.T


def _cosines_of_others(wanted: tuple, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    matrix, ids = wanted
    own = batch.column("vec_id").to_numpy(zero_copy_only=False)
    for i, scores in zip(ids, _cosines(matrix, batch)):
        scores[own == i] = -np.inf
        yield scores


def nearest(
    vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, threshold: float | None = None, score: str = "score", decimals: int = 6, query_bytes: int = QUERY_BYTES,
    others_only: bool = False,
) -> DataFrame:
    """query_id, rank, keys, score: the k rows of ``vectors`` (keys, embedding) nearest to each query (query_id, embedding) by cosine.

    Queries are broadcast in blocks of bounded bytes, and vectors are never shuffled. Rows whose embedding is null, or
    of another length than the queries', are no hits, nor are those with values that are no numbers; such queries find nothing.
    """
    spark = vectors.sparkSession
    n, dim = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim, parts = dim or 1, []
    fit = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull())
    rows = vectors.select(*keys, "embedding").where(fit)
    for block in scan.blocks(queries.where(fit), ["query_id", "embedding"], n * dim * 8, query_bytes):
        ids = [r[0] for r in block]
        wanted = _unit(np.array([r[1] for r in block], dtype=np.float64).reshape(len(block), dim))
        shared = spark.sparkContext.broadcast((ids, (wanted, ids) if others_only else wanted))  # query_bytes
        parts.append(scan.best_rows(rows, keys, queries.schema["query_id"], shared, _cosines_of_others if others_only else _cosines, k, score, threshold, decimals))
    return scan.together(parts)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, decimals: int = 6, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for every row of ``queries`` (query_id, embedding), not the query's own row."""
    return nearest(vectors, queries, ["vec_id"], k, threshold, "score", decimals, query_bytes, others_only=True)


def cluster(vectors: DataFrame, n_lists: int, seed: int = 7) -> tuple[DataFrame, list]:
    """(vectors with their list ``cid``, the centroids): k-means by cosine, for inverted-file search."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector(normalize(F.col("embedding"))))
    model = KMeans(k=n_lists, seed=seed, distanceMeasure="cosine", predictionCol="cid", maxIter=10).fit(rows)
    return model.transform(rows).drop("features"), [np.asarray(c) for c in model.clusterCenters()]
