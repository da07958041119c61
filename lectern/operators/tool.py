"""Hybrid search as a tool that a model may call, and as a SQL table function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Settings
from lectern.operators import answer, bm25, fusion, segments, vectors
from lectern.sources.shared import scratch, written

DIM = 64


def hits(spark: SparkSession, path: str, queries: DataFrame, top_k: int, threshold: float, scope: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, rank, key, scores, content, source, page_number of the best chunks of each query in a stored index.

    Its chunks (see ``segments``) have an embedding besides. ``scope`` (document_id) limits both legs; the
    keyword weights stay those of all chunks.
    """
    wide = settings.over_fetch * top_k
    keyword = segments.search(path, queries, wide, scope, settings)
    embedded = segments.chunks(spark, path)
    if scope is not None:
        embedded = bm25.scoped(embedded, scope)
    wanted = vectors.embed(queries, DIM, "text").select("query_id", "embedding")
    vector = vectors.nearest(embedded, wanted, bm25.KEY, wide, threshold, "vector_score")
    found = fusion.weighted(vector.drop("rank"), keyword.drop("rank"), settings.alpha, top_k)
    return segments.shown(spark, path, written(found, scratch(spark, "tool-hits")), "content", "source", "page_number")


def ingest(chunks: DataFrame, path: str) -> None:
    """Add chunks (document_id, chunk_index, content, source, page_number) to the index that searches read."""
    segments.add(vectors.embed(bm25.count_tokens(chunks), DIM), path)


def valid_arguments(query: str, top_k: int, document_ids: Sequence | None, settings: Settings = DEFAULTS) -> None:
    """Raise ValueError for an empty query, a top_k outside 1 to the settings' largest, or null document ids."""
    if not query or not query.strip():
        raise ValueError("the query is empty")
    if not 1 <= top_k <= settings.max_top_k:
        raise ValueError(f"top_k must be 1 to {settings.max_top_k}")
    if document_ids is not None and any(d is None for d in document_ids):
        raise ValueError("a document id is missing")


def search_knowledge_base(spark: SparkSession, path: str, query: str, top_k: int = DEFAULTS.top_k, document_ids: Sequence | None = None, threshold: float = DEFAULTS.threshold, settings: Settings = DEFAULTS) -> str:
    """The best chunks of a stored index as numbered text, or the fixed text for nothing found; nothing is indexed or embedded but the query.

    Arguments that are not valid raise ValueError.
    """
    valid_arguments(query, top_k, document_ids, settings)
    queries = spark.createDataFrame([(0, query)], "query_id long, text string")
    scope = None
    if document_ids:
        kind = segments.chunks(spark, path).schema["document_id"].dataType.simpleString()
        scope = spark.createDataFrame([(d,) for d in document_ids], f"document_id {kind}")
    found = hits(spark, path, queries, top_k, threshold, scope, settings)
    return answer.or_nothing(queries, answer.tool_text(found)).first()["text"]


def call(spark: SparkSession, path: str, query: str, top_k: int = DEFAULTS.top_k, document_ids: Sequence | None = None, **options) -> str:
    """As a model calls it: an error becomes a text that the model can read."""
    try:
        return search_knowledge_base(spark, path, query, top_k, document_ids, **options)
    except Exception as error:  # the model decides what to do about it
        return f"{answer.FAILED}{error}"


def register(spark: SparkSession, chunks: DataFrame, index: bm25.Index, settings: Settings = DEFAULTS, name: str = "kb_search") -> None:
    """Create the table function ``name(query STRING, top_k INT)``: rank, document_id, chunk_index, score, content, source.

    ``chunks`` has key, content, source, dl, toks, tfs and embedding, as the stored index has them. The
    function is SQL over temporary views, so Catalyst plans it like any query. A top_k outside 1
    to the settings' largest, or an empty query, raises an error.
    """
    chunks.createOrReplaceTempView(f"{name}_chunks")
    index.idf.createOrReplaceTempView(f"{name}_idf")
    index.stats.createOrReplaceTempView(f"{name}_stats")
    k1, b, most = settings.bm25_k1, settings.bm25_b, settings.over_fetch * settings.max_top_k
    tokens = r"regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+', 0)"
    bucket = f"CAST(conv(substring(md5(t), 1, 8), 16, 10) AS BIGINT) % {DIM}"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, top_k INT)
RETURNS TABLE (rank INT, document_id {chunks.schema['document_id'].dataType.simpleString()}, chunk_index INT, score DOUBLE, content STRING, source STRING)
RETURN
WITH asked AS (
  SELECT {tokens} AS toks, {settings.over_fetch} * top_k AS wide
  WHERE CASE WHEN top_k NOT BETWEEN 1 AND {settings.max_top_k} THEN raise_error('top_k must be 1 to {settings.max_top_k}')
             WHEN length(trim(query)) = 0 THEN raise_error('the query is empty') ELSE true END),
terms AS (SELECT tok, count(*) AS qf FROM (SELECT explode(toks) AS tok FROM asked) GROUP BY tok),
weighed AS (SELECT map_from_entries(collect_list(struct(tok, qf * idf))) AS weights FROM terms JOIN {name}_idf USING (tok)),
wanted AS (SELECT transform(sequence(0, {DIM - 1}), i -> CAST(coalesce(sum_at[CAST(i AS BIGINT)], 0) AS DOUBLE)) AS v FROM (
  SELECT map_from_entries(collect_list(struct(bucket, n))) AS sum_at FROM (SELECT {bucket} AS bucket, count(*) AS n FROM (SELECT explode(toks) AS t FROM asked) GROUP BY 1))),
scored AS (
  SELECT document_id, chunk_index,
         round(aggregate(zip_with(toks, tfs, (t, tf) -> coalesce(weights[t], 0) * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / mean_dl))), 0D, (s, x) -> s + x), 6) AS bm25_score,
         round(aggregate(zip_with(embedding, v, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(v, 0D, (s, x) -> s + x * x)), 0), 6) AS vector_score
  FROM {name}_chunks CROSS JOIN {name}_stats CROSS JOIN weighed CROSS JOIN wanted),
keyword AS (
  SELECT document_id, chunk_index, bm25_score, min(bm25_score) OVER () AS low, max(bm25_score) OVER () AS high FROM (
    SELECT *, row_number() OVER (ORDER BY bm25_score DESC, document_id, chunk_index) AS nth FROM (
      SELECT * FROM scored ORDER BY bm25_score DESC, document_id, chunk_index LIMIT {most})) JOIN asked ON nth <= wide),
vector AS (
  SELECT document_id, chunk_index, vector_score, min(vector_score) OVER () AS low, max(vector_score) OVER () AS high FROM (
    SELECT *, row_number() OVER (ORDER BY vector_score DESC, document_id, chunk_index) AS nth FROM (
      SELECT * FROM scored WHERE vector_score >= {settings.threshold} ORDER BY vector_score DESC, document_id, chunk_index LIMIT {most})) JOIN asked ON nth <= wide),
fused AS (
  SELECT document_id, chunk_index, round({settings.alpha} * coalesce(CASE WHEN v.high > v.low THEN (vector_score - v.low) / (v.high - v.low) END, 0)
         + {round(1 - settings.alpha, 6)} * coalesce(CASE WHEN k.high > k.low THEN (bm25_score - k.low) / (k.high - k.low) END, 0), 6) AS score
  FROM vector v FULL OUTER JOIN keyword k USING (document_id, chunk_index)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id, chunk_index) AS rank FROM fused)
SELECT rank, document_id, chunk_index, score, content, source FROM ranked JOIN {name}_chunks USING (document_id, chunk_index) WHERE rank <= top_k
""")
