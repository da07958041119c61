"""Registry of queries, and the tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.operators import bm25, chunking, segments, vectors
from lectern.sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SIZE, OVERLAP = DEFAULTS.chunk_size, DEFAULTS.chunk_overlap
STEP = SIZE - OVERLAP
QUESTION = "The and attion to thanedble the, anea. Eriner worthless license"
DIM = 64


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents' status in the catalog's terms, the same in both engines.
STATUS = "CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'completed' END"
FILENAME = "concat(source, CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' WHEN 2 THEN '.md' ELSE '.docx' END)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, chunk_index, content, source of the default windows over documents."""
    return chunking.fixed(table(spark, sf_dir, "documents"), SIZE, OVERLAP).select(
        F.col("doc_id").alias("document_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "content", "source", "start_char", "end_char"
    )


def question(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUESTION)], "query_id long, text string")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_built: dict[tuple, str] = {}


def knowledge(spark: SparkSession, sf_dir: str) -> str:
    """Where a folder's documents are indexed: chunks with content, tokens and embedding, and their keyword index.

    Built once per application and state of the documents, in the shared folder, as a service
    ingests once and then searches; every search reads the stored tables.
    """
    path = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, shared.state(spark, path))
    if key not in _built:
        folder = shared.scratch(spark, "knowledge")
        segments.add(chunks(spark, sf_dir), folder, prepare=lambda rows: vectors.embed(bm25.count_tokens(rows), DIM))
        _built[key] = folder
    return _built[key]


def keyword_top(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    return segments.search(knowledge(spark, sf_dir), queries, k, scope)


def vector_top(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    wanted = vectors.embed(queries, DIM, "text").select("query_id", "embedding")
    return vectors.nearest(segments.chunks(spark, knowledge(spark, sf_dir)), wanted, bm25.KEY, k, threshold, "vector_score")


CHUNKS = f"""chunks AS (
  SELECT doc_id AS document_id, i::INTEGER AS chunk_index, substr(text, i * {STEP} + 1, {SIZE}) AS content, source,
         (i * {STEP})::INTEGER AS start_char, least(i * {STEP} + {SIZE}, length(text))::INTEGER AS end_char
  FROM documents, unnest(range(0, 1 + greatest(0, ceil((length(text) - {SIZE}) / {STEP}.0))::BIGINT)) u(i) WHERE length(text) > 0)"""
TOKENS = """toks AS (SELECT document_id, chunk_index, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS tok FROM chunks)"""
INDEX = f"""{CHUNKS}, {TOKENS},
tf AS (SELECT document_id, chunk_index, tok, count(*) AS tf FROM toks GROUP BY ALL),
lengths AS (SELECT document_id, chunk_index, len(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS dl FROM chunks),
stats AS (SELECT count(*) AS n, avg(dl) AS mean_dl FROM lengths),
raw_idf AS (SELECT tok, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf, stats GROUP BY tok, n),
mean_raw AS (SELECT avg(raw) AS mean_raw FROM raw_idf),
idf AS (SELECT tok, CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END AS idf FROM raw_idf, mean_raw)"""
ONE = f"queries AS (SELECT 0::BIGINT AS query_id, '{QUESTION}' AS text)"
MANY = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
SCORES = """terms AS (SELECT query_id, tok, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tok FROM queries) GROUP BY ALL),
keyword AS (
  SELECT query_id, document_id, chunk_index, sum(qf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl)))) AS bm25_score
  FROM terms JOIN idf USING (tok) JOIN tf USING (tok) JOIN lengths USING (document_id, chunk_index), stats GROUP BY ALL)"""
KEYWORD_TOP = """keyword_top AS (
  SELECT query_id, document_id, chunk_index, bm25_score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, document_id, chunk_index) AS rank
    FROM (SELECT query_id, document_id, chunk_index, round(coalesce(bm25_score, 0), 6) AS bm25_score
          FROM (SELECT query_id, document_id, chunk_index FROM queries, lengths) LEFT JOIN keyword USING (query_id, document_id, chunk_index))) WHERE rank <= {k})"""
EMBEDDED = f"""counts AS (SELECT document_id, chunk_index, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIM}) AS bucket, count(*) AS n FROM toks GROUP BY ALL),
embedded AS (SELECT document_id, chunk_index, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY document_id, chunk_index)) AS weight FROM counts),
q_counts AS (SELECT query_id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIM}) AS bucket, sum(qf) AS n FROM terms GROUP BY ALL),
q_embedded AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS q_weight FROM q_counts),
vector AS (SELECT query_id, document_id, chunk_index, sum(weight * q_weight) AS vector_score FROM embedded JOIN q_embedded USING (bucket) GROUP BY ALL)"""
VECTOR_TOP = """vector_top AS (
  SELECT query_id, document_id, chunk_index, vector_score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, document_id, chunk_index) AS rank
    FROM (SELECT query_id, document_id, chunk_index, round(vector_score, 6) AS vector_score FROM vector)) WHERE rank <= {k} AND vector_score >= {threshold})"""
