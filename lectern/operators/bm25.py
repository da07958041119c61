"""BM25 over chunks keyed by (document_id, chunk_index).

The index is a forward one: a chunk's row holds its tokens and how often each occurs, counted in
the row by Arrow batches, so neither texts nor exploded tokens are shuffled to build it. Search
reads it once for a block of queries and keeps the best where the chunks are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lectern.config import DEFAULTS, Settings
from lectern.functions.text import tokens
from lectern.operators import scan
from lectern.sources.shared import written

KEY = ["document_id", "chunk_index"]
#: Bytes of query text that one pass over the index answers; more run in blocks.
QUERY_BYTES = 8 << 20


COUNTED = StructType([StructField("toks", ArrayType(StringType())), StructField("tfs", ArrayType(IntegerType()))])


def count_lists(lists: pa.Array) -> pa.Array:
    """Of each list of tokens the different ones and how often they occur."""
    lists = lists.fill_null([])
    coded = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    kinds = max(1, len(coded.dictionary))
    keys, n = np.unique(row * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, which = np.divmod(keys, kinds)
    offsets = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32))
    toks, tfs = coded.dictionary.take(pa.array(which)), pa.array(n.astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, toks), pa.ListArray.from_arrays(offsets, tfs)], names=["toks", "tfs"])


@F.arrow_udf(COUNTED)
def counted(lists: pa.Array) -> pa.Array:
    return count_lists(lists)


@dataclass
class Index:
    """``postings``: key, dl, toks, tfs. ``idf``: tok, idf. ``stats``: one row n, mean_dl."""

    postings: DataFrame
    idf: DataFrame
    stats: DataFrame

    @property
    def tf(self) -> DataFrame:
        """key, tok, tf, dl."""
        return self.postings.select(*KEY, "dl", F.explode(F.arrays_zip("toks", "tfs")).alias("p")).select(*KEY, F.col("p.toks").alias("tok"), F.col("p.tfs").cast("long").alias("tf"), "dl")

    @property
    def lengths(self) -> DataFrame:
        """key, dl, chunks without tokens too."""
        return self.postings.select(*KEY, "dl")


def count_tokens(chunks: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """Add dl, toks and tfs to chunks with a ``content``."""
    made = F.coalesce(tokenize(F.col("content")), F.array().cast("array<string>"))
    return chunks.select("*", F.size(made).alias("dl"), counted(made).alias("_counted")).select(*chunks.columns, "dl", "_counted.*")


def index_of(postings: DataFrame, settings: Settings = DEFAULTS, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Index:
    """The weights of counted chunks. A token in more than half of them would weigh less than 0 and weighs epsilon times the mean weight instead.

    ``keep(table, name)`` may write the tables; then each is made once.
    """
    stats = keep(postings.agg(F.count("*").alias("n"), F.avg("dl").alias("mean_dl")), "stats")
    raw = postings.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df")).join(F.broadcast(stats))  # one row
    raw = raw.select("tok", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    raw = keep(raw, "raw")
    mean = raw.agg(F.avg("raw").alias("mean_raw"))
    idf = raw.join(F.broadcast(mean)).select("tok", F.when(F.col("raw") < 0, settings.bm25_epsilon * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))  # one row
    return Index(postings, keep(idf, "idf"), stats)


def build(chunks: DataFrame, settings: Settings = DEFAULTS, tokenize: Callable[[Column], Column] = tokens) -> Index:
    """Index all chunks."""
    return index_of(count_tokens(chunks.select(*KEY, "content"), tokenize).drop("content"), settings)


def query_terms(queries: DataFrame, tokenize=tokens) -> DataFrame:
    """query_id, tok, qf: how often each query has each token."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("qf"))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all the half-open ranges, one after the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _batch_scores(wanted: tuple, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Of each query the scores of all chunks of a batch."""
    vocabulary, idf, terms, k1, b, mean_dl = wanted
    toks, n = batch.column("toks"), batch.num_rows
    coded = toks.flatten().dictionary_encode()
    known = pc.index_in(coded.dictionary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    number = known[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(n), toks.value_lengths().to_numpy(zero_copy_only=False))
    inside = np.nonzero(number >= 0)[0]
    inside = inside[np.argsort(number[inside], kind="stable")]
    number, row = number[inside], row[inside]
    tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[inside].astype(float)
    norm = k1 * (1 - b + b * batch.column("dl").to_numpy(zero_copy_only=False) / mean_dl)
    impact = idf[number] * tf * (k1 + 1) / (tf + norm[row])
    starts = np.searchsorted(number, np.arange(len(vocabulary) + 1))
    for which, times in terms:
        first, stop = starts[which], starts[which + 1]
        entries = _ranges(first, stop)
        yield np.bincount(row[entries], weights=impact[entries] * np.repeat(times, stop - first), minlength=n)


def search(index: Index, queries: DataFrame, k: int, scope: DataFrame | None = None, settings: Settings = DEFAULTS, tokenize=tokens, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, key, bm25_score: the k best chunks of each query, chunks without a common token with score 0 too.

    ``scope`` (document_id) limits the hits; weights stay those of all chunks.
    """
    spark = queries.sparkSession
    n, mean_dl = index.stats.select("n", "mean_dl").first()
    rows = index.postings if scope is None else scoped(index.postings, scope)
    rows = rows.select(*KEY, "dl", "toks", "tfs")
    cut = queries.select("query_id", tokenize(F.col("text")).alias("toks"), F.octet_length("text").alias("size"))
    size, parts = cut.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], []
    for block in scan.blocks(cut, ["query_id", "toks"], size, query_bytes):
        words = sorted({t for r in block for t in r["toks"] or ()})
        asked = spark.createDataFrame([(w,) for w in words], "tok string")  # at most the block's tokens
        weight = dict(index.idf.join(asked, "tok").select("tok", "idf").collect())
        number = {t: i for i, t in enumerate(sorted(weight))}
        terms = []
        for r in block:
            counts = Counter(t for t in r["toks"] or () if t in number)
            terms.append((np.array([number[t] for t in counts], dtype=np.int64), np.array(list(counts.values()), dtype=float)))
        idf = np.array([weight[t] for t in number], dtype=float)
        wanted = (pa.array(list(number), type=pa.string()), idf, terms, settings.bm25_k1, settings.bm25_b, mean_dl or 1.0)
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in block], wanted))  # query_bytes of text, about
        parts.append(scan.best_rows(rows, KEY, queries.schema["query_id"], shared, _batch_scores, k, "bm25_score"))
    return scan.together(parts)


def scores(index: Index, queries: DataFrame, settings: Settings = DEFAULTS, tokenize=tokens) -> DataFrame:
    """query_id, key, bm25_score of all chunks that share a token with a query: every pair, where ``search`` gives the best only."""
    k1, b = settings.bm25_k1, settings.bm25_b
    terms = query_terms(queries, tokenize).join(index.idf, "tok")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean_dl")))
    return (
        index.tf.join(terms, "tok")
        .join(F.broadcast(index.stats))  # one row
        .groupBy("query_id", *KEY)
        .agg(F.sum(F.col("qf") * F.col("idf") * part).alias("bm25_score"))
    )


def with_zeros(index: Index, scored: DataFrame, query_id: Column) -> DataFrame:
    """For one query: all chunks, those without a common token with score 0."""
    return index.lengths.select(*KEY).join(scored.drop("query_id"), KEY, "left").select(query_id.alias("query_id"), *KEY, F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"))


def top(scored: DataFrame, score: str, k: int | Column, decimals: int = 6) -> DataFrame:
    """Add rank: per query by score, rounded, downwards, then by key; only ranks up to k."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), *KEY)
    return scored.withColumn(score, F.round(score, decimals)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scoped(scored: DataFrame, scope: DataFrame) -> DataFrame:
    """Only hits in the documents of ``scope`` (document_id); weights stay those of all chunks."""
    return scored.join(scope.select("document_id").distinct(), "document_id", "left_semi")


def save(index: Index, path: str, settings: Settings = DEFAULTS) -> Index:
    """Write the index tables; weights come from the postings as written, so texts are cut once."""
    keep = lambda df, name: written(df, f"{path}/{name}")
    return index_of(keep(index.postings, "postings"), settings, keep)


def load(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "idf", "stats")])
