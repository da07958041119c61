"""Queries over the keyword index, vectors and their fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.operators import answer, bm25, fusion, hnsw, rerank, segments, semantic, tool, vector_store, vectors
from lectern.plans.base import (
    CHUNKS,
    DIM,
    EMBEDDED,
    INDEX,
    KEYWORD_TOP,
    MANY,
    ONE,
    QUESTION,
    SCORES,
    TOKENS,
    VECTOR_TOP,
    benchmark_queries,
    chunks,
    keyword_top,
    knowledge,
    query,
    question,
    table,
    vector_top,
)
from lectern.sources import snapshots
from lectern.sources.shared import scratch, state, written

K = 10


@query(
    "token_stats",
    f"WITH {INDEX} SELECT (SELECT n FROM stats) AS n_chunks, round((SELECT mean_dl FROM stats), 6) AS mean_dl, count(*) AS n_tokens, (SELECT sum(tf) FROM tf)::BIGINT AS n_occurrences FROM idf",
)
def token_stats(spark, sf_dir):
    """The index knows its tokens and their number, so no table of occurrences is made."""
    path = knowledge(spark, sf_dir)
    kinds, total = segments.terms(spark, path).agg(F.count("*").alias("n_tokens")), snapshots.read(spark, path).facts["total"]
    return segments.index(spark, path).stats.crossJoin(kinds).select(
        F.col("n").alias("n_chunks"), F.round("mean_dl", 6).alias("mean_dl"), "n_tokens", F.when(F.col("n_tokens") > 0, F.lit(total).cast("long")).alias("n_occurrences")
    )  # two single rows


#: Each chunk's different tokens are counted at once: no table of occurrences is made for the weights alone.
WEIGHTS = f"""{CHUNKS},
kinds AS MATERIALIZED (SELECT list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS toks FROM chunks),
dfs AS MATERIALIZED (SELECT tok, count(*) AS df FROM (SELECT unnest(toks) AS tok FROM kinds) GROUP BY tok),
raws AS MATERIALIZED (SELECT tok, ln((SELECT count(*) FROM kinds) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs)"""


@query("bm25_idf", f"WITH {WEIGHTS} SELECT tok, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END, 6) AS idf FROM raws")
def bm25_idf(spark, sf_dir):
    return segments.index(spark, knowledge(spark, sf_dir)).idf.select("tok", F.round("idf", 6).alias("idf"))


@query(
    "bm25_topk",
    f"""WITH {INDEX}, {ONE}, {SCORES}
SELECT * FROM (SELECT row_number() OVER (ORDER BY bm25_score DESC, document_id, chunk_index)::INTEGER AS rank, * FROM (
  SELECT document_id, chunk_index, round(coalesce(bm25_score, 0), 6) AS bm25_score FROM lengths LEFT JOIN keyword USING (document_id, chunk_index))) WHERE rank <= {K}""",
)
def bm25_topk(spark, sf_dir):
    return keyword_top(spark, sf_dir, question(spark), K).select("rank", *bm25.KEY, "bm25_score")


@query(
    "bm25_scoped",
    f"""WITH {INDEX}, {MANY}, {SCORES}, scoped AS (
  SELECT query_id, document_id, chunk_index, round(coalesce(bm25_score, 0), 6) AS bm25_score
  FROM (SELECT query_id, document_id, chunk_index FROM queries, lengths WHERE document_id % 7 = 0) LEFT JOIN keyword USING (query_id, document_id, chunk_index))
SELECT query_id, rank::INTEGER AS rank, document_id, chunk_index, bm25_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, document_id, chunk_index) AS rank FROM scoped) WHERE rank <= {K}""",
)
def bm25_scoped(spark, sf_dir):
    scope = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("document_id"))
    return keyword_top(spark, sf_dir, benchmark_queries(spark, sf_dir), K, scope)


@query("bm25_batch", f"WITH {INDEX}, {MANY}, {SCORES}, {KEYWORD_TOP.format(k=K)} SELECT query_id, rank::INTEGER AS rank, document_id, chunk_index, bm25_score FROM keyword_top")
def bm25_batch(spark, sf_dir):
    return keyword_top(spark, sf_dir, benchmark_queries(spark, sf_dir), K)


CHANGED = INDEX.replace("FROM documents,", "FROM documents d,").replace("WHERE length(text) > 0)", "WHERE length(text) > 0 AND d.doc_id % 5 <> 3)")


@query("bm25_after_changes", f"WITH {CHANGED}, {MANY}, {SCORES}, {KEYWORD_TOP.format(k=K)} SELECT query_id, rank::INTEGER AS rank, document_id, chunk_index, bm25_score FROM keyword_top")
def bm25_after_changes(spark, sf_dir):
    """An index that grew by three segments, lost documents before and after a merge, and got some back: as if built from what is left."""
    rows, path = bm25.count_tokens(chunks(spark, sf_dir)), scratch(spark, "changing-index")
    gone = lambda *rests: rows.where((F.col("document_id") % 5).isin(*rests)).select("document_id")
    segments.add(rows.where("document_id % 2 = 0"), path)
    segments.add(rows.where("document_id % 2 = 1 and document_id % 3 > 0"), path)
    segments.delete(gone(3, 4), path)
    segments.merge(spark, path)
    segments.add(rows.where("document_id % 2 = 1 and document_id % 3 = 0"), path)
    segments.add(rows.where("document_id % 5 = 4 and not (document_id % 2 = 1 and document_id % 3 = 0)"), path)
    segments.delete(gone(3), path)
    return segments.search(path, benchmark_queries(spark, sf_dir), K)


# ---- vectors

QUERY_VECTOR = [round(((i * 7) % 13 - 6) / 10, 1) for i in range(DIM)]
_Q = f"{QUERY_VECTOR}::DOUBLE[]"
_COS = f"round(list_dot_product(embedding::DOUBLE[], {_Q}) / sqrt(list_dot_product({_Q}, {_Q})) / CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 1 ELSE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END, 6)"


@query(
    "vec_norm",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, len(embedding)::INTEGER AS dim FROM embeddings",
)
def vec_norm(spark, sf_dir):
    unit = vectors.normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.pow(vectors.norm(F.col("embedding")), 2), 6).alias("square"), F.round(F.element_at(unit, 1), 6).alias("first"), F.size("embedding").alias("dim")
    )


@query("vec_topk", f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {K}")
def vec_topk(spark, sf_dir):
    return vectors.top_k(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, K)


@query("vec_topk_threshold", f"SELECT * FROM (SELECT vec_id, {_COS} AS score FROM embeddings) WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT {K}")
def vec_topk_threshold(spark, sf_dir):
    return vectors.top_k(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, K, threshold=0.2)


@query("vec_scoped", f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT {K}")
def vec_scoped(spark, sf_dir):
    return vectors.top_k(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, K, scope=F.col("label").isin(1, 3, 5))


@query(
    "vec_batch_topk",
    """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.e, d.e), 6) AS score FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def vec_batch_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.batch_top_k(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query("vec_count", "SELECT count(*) AS n FROM embeddings")
def vec_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))


@query("hash_embed", f"WITH {CHUNKS}, {TOKENS}, {ONE}, terms AS (SELECT 0 AS query_id, 'x' AS tok, 1 AS qf), {EMBEDDED} SELECT document_id, chunk_index, bucket::INTEGER AS bucket, round(weight, 6) AS weight FROM embedded")
def hash_embed(spark, sf_dir):
    return vectors.hash_embed(chunks(spark, sf_dir), DIM, *bm25.KEY).select(*bm25.KEY, "bucket", F.round("weight", 6).alias("weight"))


EXACT = """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.e, d.e), 6) AS score FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
exact AS (SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10)"""
LISTS, PROBE = 16, 4
#: Folders of inverted files that are stored already, by application and state of the table.
_files: dict[tuple, str] = {}


def inverted_file(spark, sf_dir):
    """(hits, reads) of every embedding with vec_id % 100 = 0 in a stored inverted file of all of them."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "document_id")
    path = f"{sf_dir}/embeddings.parquet"
    key = (spark.sparkContext.applicationId, path, state(spark, path))
    if key not in _files:
        folder = scratch(spark, "inverted-file")
        vector_store.create(rows, folder, LISTS)
        _files[key] = folder
    return vector_store.search(_files[key], rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), K, PROBE)


@query("ivf_topk", f"{EXACT} SELECT * FROM exact")
def ivf_topk(spark, sf_dir):
    """Nearest neighbours from lists and 8-bit codes: the same as those of an exact search."""
    return inverted_file(spark, sf_dir)[0]


@query("ivf_recall", f"{EXACT} SELECT query_id, count(*) AS k, count(*) AS found FROM exact GROUP BY query_id")
def ivf_recall(spark, sf_dir):
    """Per query how many of the exact ten nearest the inverted file finds: the SQL states that none is lost."""
    rows = table(spark, sf_dir, "embeddings")
    found = inverted_file(spark, sf_dir)[0].select("query_id", "vec_id", F.lit(1).alias("hit"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vectors.batch_top_k(rows, queries, K).join(found, ["query_id", "vec_id"], "left")
    return exact.groupBy("query_id").agg(F.count("*").alias("k"), F.count("hit").alias("found"))


@query("ivf_reads")
def ivf_reads(spark, sf_dir):
    """Per query how many lists and codes, of a byte per dimension, the inverted file reads for it."""
    return inverted_file(spark, sf_dir)[1].withColumn("code_bytes", F.col("codes") * DIM)


@query("graph_recall", "SELECT count(*) AS n_queries, true AS nine_of_ten_found, true AS fewer_compared FROM embeddings WHERE vec_id % 100 = 0")
def graph_recall(spark, sf_dir):
    """Neighbour graphs against exact search: whether nine tenths of all neighbours are found, by comparing with fewer vectors than there are."""
    rows, path = table(spark, sf_dir, "embeddings"), scratch(spark, "graphs")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hnsw.build(rows, path)
    hits, looked = hnsw.search(spark, path, queries, K)
    exact = vectors.batch_top_k(rows, queries, K).join(hits.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    found = exact.agg((F.count("hit") >= 0.9 * F.count("*")).alias("nine_of_ten_found"))
    compared = looked.join(F.broadcast(rows.agg(F.count("*").alias("n")))).agg(F.count("*").alias("n_queries"), (F.sum("looked") < F.sum("n")).alias("fewer_compared"))  # one row
    return compared.join(F.broadcast(found)).select("n_queries", "nine_of_ten_found", "fewer_compared")  # single rows


@query(
    "vector_delete",
    """WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.e, d.e), 6) AS score FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 AND d.label NOT IN (3, 7))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def vector_delete(spark, sf_dir):
    """A stored table of vectors in lists, half of them inserted later, two documents deleted, then searched."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "document_id")
    folder = scratch(spark, "vector-store")
    vector_store.create(rows.where("vec_id % 2 = 0"), folder, 8)
    vector_store.insert(rows.where("vec_id % 2 = 1"), folder)
    vector_store.delete(rows.where("document_id in (3, 7)").select("document_id"), folder)
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_store.search(folder, queries, 5, 2)[0]


@query("semantic_values")
def semantic_values(spark, sf_dir):
    """The largest singular values of the chunks' token matrix, which the learnt embedder stands on."""
    rows = segments.chunks(spark, knowledge(spark, sf_dir))
    values = semantic.fit(rows, 8, rounds=3).singular
    return spark.createDataFrame([(i, round(float(v), 3)) for i, v in enumerate(values)], "nth long, value double")


# ---- fusion


def legs(spark, sf_dir, queries, top_k=K):
    """Both legs, each asked for more than ``top_k``; the vector leg's hits reach the settings' threshold."""
    wide = DEFAULTS.over_fetch * top_k
    return vector_top(spark, sf_dir, queries, wide, DEFAULTS.threshold), keyword_top(spark, sf_dir, queries, wide)


def legs_sql(queries: str, top_k: int = K) -> str:
    wide = DEFAULTS.over_fetch * top_k
    return f"{INDEX}, {queries}, {SCORES}, {EMBEDDED}, {KEYWORD_TOP.format(k=wide)}, {VECTOR_TOP.format(k=wide, threshold=DEFAULTS.threshold)}"


def fused_sql(score: str, k: int | None = K) -> str:
    return f"""
v AS (SELECT *, CASE WHEN max(vector_score) OVER q > min(vector_score) OVER q THEN (vector_score - min(vector_score) OVER q) / (max(vector_score) OVER q - min(vector_score) OVER q) ELSE 0 END AS nv
  FROM vector_top WINDOW q AS (PARTITION BY query_id)),
b AS (SELECT *, CASE WHEN max(bm25_score) OVER q > min(bm25_score) OVER q THEN (bm25_score - min(bm25_score) OVER q) / (max(bm25_score) OVER q - min(bm25_score) OVER q) ELSE 0 END AS nb
  FROM keyword_top WINDOW q AS (PARTITION BY query_id)),
fused AS (SELECT query_id, document_id, chunk_index, vector_score, bm25_score, round({score}, 6) AS score FROM v FULL JOIN b USING (query_id, document_id, chunk_index)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index)::INTEGER AS rank FROM fused)
SELECT query_id, rank, document_id, chunk_index, vector_score, bm25_score, score FROM ranked WHERE rank <= {k}"""


_MIXED = "{a}::DOUBLE * coalesce(nv, 0) + {b}::DOUBLE * coalesce(nb, 0)"


@query("minmax_norm", f"WITH {legs_sql(MANY)}, {fused_sql('0').split('fused AS')[0].rstrip().rstrip(',')} SELECT query_id, document_id, chunk_index, round(nb, 6) AS normal FROM b")
def minmax_norm(spark, sf_dir):
    _, keyword = legs(spark, sf_dir, benchmark_queries(spark, sf_dir))
    return fusion.min_max(keyword, "bm25_score", "normal").select("query_id", *bm25.KEY, F.round("normal", 6).alias("normal"))


@query("hybrid_minmax", f"WITH {legs_sql(MANY)}, {fused_sql(_MIXED.format(a=0.6, b=0.4))}")
def hybrid_minmax(spark, sf_dir):
    vector, keyword = legs(spark, sf_dir, benchmark_queries(spark, sf_dir))
    return fusion.weighted(vector.drop("rank"), keyword.drop("rank"), DEFAULTS.alpha, K)


@query("hybrid_rrf", f"WITH {legs_sql(MANY)}, {fused_sql('coalesce(0.5::DOUBLE / (60 + v.rank), 0) + coalesce(0.5::DOUBLE / (60 + b.rank), 0)')}")
def hybrid_rrf(spark, sf_dir):
    vector, keyword = legs(spark, sf_dir, benchmark_queries(spark, sf_dir))
    return fusion.reciprocal_rank(vector, keyword, 0.5, K)


@query("hybrid_raw", f"WITH {legs_sql(MANY)}, {fused_sql('coalesce(vector_score, bm25_score)')}")
def hybrid_raw(spark, sf_dir):
    vector, keyword = legs(spark, sf_dir, benchmark_queries(spark, sf_dir))
    return fusion.raw(vector, keyword, K)


ALPHAS = (0.3, 0.4, 0.6, 0.8)


@query(
    "hybrid_alpha_sweep",
    f"WITH {legs_sql(ONE)}, "
    + fused_sql("0").split("fused AS")[0]
    + " alphas AS (SELECT unnest([0.3, 0.4, 0.6, 0.8])::DOUBLE AS alpha), "
    + f"""fused AS (SELECT alpha, document_id, chunk_index, round(alpha * coalesce(nv, 0) + (1 - alpha) * coalesce(nb, 0), 6) AS score FROM v FULL JOIN b USING (query_id, document_id, chunk_index), alphas)
SELECT alpha, rank, document_id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY score DESC, document_id, chunk_index)::INTEGER AS rank FROM fused) WHERE rank <= {K}""",
)
def hybrid_alpha_sweep(spark, sf_dir):
    vector, keyword = legs(spark, sf_dir, question(spark))
    found = None
    for alpha in ALPHAS:
        one = fusion.weighted(vector.drop("rank"), keyword.drop("rank"), alpha, K).select(F.lit(alpha).alias("alpha"), "rank", *bm25.KEY, "score")
        found = one if found is None else found.unionByName(one)
    return found


def retrieved(spark, sf_dir, queries, k=DEFAULTS.top_k):
    """Hits with content and source: the content is joined to the few best only."""
    vector, keyword = legs(spark, sf_dir, queries, k)
    hits = fusion.weighted(vector.drop("rank"), keyword.drop("rank"), DEFAULTS.alpha, k)
    hits = written(hits, scratch(spark, "hits"))
    return segments.shown(spark, knowledge(spark, sf_dir), hits, "content", "source").withColumn("page_number", F.lit(None).cast("int"))


RETRIEVED = f"{legs_sql(MANY, DEFAULTS.top_k)}, hits AS (WITH {fused_sql(_MIXED.format(a=0.6, b=0.4), DEFAULTS.top_k)}), retrieved AS (SELECT * FROM hits JOIN chunks USING (document_id, chunk_index))"


@query("retrieve", f"WITH {RETRIEVED} SELECT query_id, rank, document_id, chunk_index, score, source, md5(content) AS content_md5 FROM retrieved")
def retrieve(spark, sf_dir):
    hits = retrieved(spark, sf_dir, benchmark_queries(spark, sf_dir))
    return hits.select("query_id", "rank", *bm25.KEY, "score", "source", F.md5("content").alias("content_md5"))


@query(
    "rerank_overlap",
    f"""WITH {legs_sql(MANY)}, hits AS (WITH {fused_sql(_MIXED.format(a=0.6, b=0.4), 2 * K)}),
shown AS (SELECT h.query_id, h.document_id, h.chunk_index, list_distinct(regexp_extract_all(lower(q.text), '[\\p{{L}}\\p{{N}}]+')) AS asked, regexp_extract_all(lower(c.content), '[\\p{{L}}\\p{{N}}]+') AS has
  FROM hits h JOIN queries q USING (query_id) JOIN chunks c USING (document_id, chunk_index)),
scored AS (SELECT query_id, document_id, chunk_index, round(len(list_intersect(asked, has)) / greatest(1, len(asked))::DOUBLE, 6) AS rerank_score FROM shown)
SELECT query_id, rank::INTEGER AS rank, document_id, chunk_index, rerank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, document_id, chunk_index) AS rank FROM scored) WHERE rank <= 5""",
)
def rerank_overlap(spark, sf_dir):
    """Twenty fused hits of each query, ordered anew by how many of its tokens they have; the five best."""
    queries = benchmark_queries(spark, sf_dir)
    vector, keyword = legs(spark, sf_dir, queries)
    hits = fusion.weighted(vector.drop("rank"), keyword.drop("rank"), DEFAULTS.alpha, 2 * K)
    hits = segments.shown(spark, knowledge(spark, sf_dir), written(hits, scratch(spark, "hits")), "content")
    return fusion.reranked(hits, queries, fusion.overlap, DEFAULTS.top_k).select("query_id", "rank", *bm25.KEY, "rerank_score")


def judged_hits(spark, sf_dir):
    """Twenty fused hits of each benchmark passage with features; those that hold the whole passage are relevant. Passages are dealt into two folds."""
    queries = benchmark_queries(spark, sf_dir)
    vector, keyword = legs(spark, sf_dir, queries)
    hits = fusion.weighted(vector.drop("rank"), keyword.drop("rank"), DEFAULTS.alpha, 2 * K)
    hits = segments.shown(spark, knowledge(spark, sf_dir), written(hits, scratch(spark, "hits")), "content")
    relevant = F.coalesce(F.contains(F.col("content"), F.col("text")), F.lit(False))
    rows = rerank.features(hits, queries).join(queries, "query_id").withColumn("relevant", relevant).withColumn("fold", F.crc32(F.col("query_id").cast("string")) % 2)
    return queries, written(rows.drop("text"), scratch(spark, "judged"))


def learnt_order(queries, rows, k):
    """Each fold's hits by a model that the other fold taught."""
    found = None
    for fold in (0, 1):
        model = rerank.fit(rows.where(F.col("fold") != fold))
        one = rerank.reranked(rows.where(F.col("fold") == fold).drop("features"), queries, model, k)
        found = one if found is None else found.unionByName(one)
    return found


@query("rerank_learnt")
def rerank_learnt(spark, sf_dir):
    """The five best of twenty fused hits of each passage, by a reranker that never saw the passage."""
    queries, rows = judged_hits(spark, sf_dir)
    return learnt_order(queries, rows, DEFAULTS.top_k).select("query_id", "rank", *bm25.KEY, "relevant", "rerank_score")


@query(
    "rerank_gain",
    f"""WITH {legs_sql(MANY)}, hits AS (WITH {fused_sql(_MIXED.format(a=0.6, b=0.4), 2 * K)}),
firsts AS (SELECT h.query_id, min(h.rank) AS first FROM hits h JOIN queries q USING (query_id) JOIN chunks c USING (document_id, chunk_index) WHERE contains(c.content, q.text) GROUP BY h.query_id)
SELECT count(*) AS n_queries, round(avg(1 / first::DOUBLE), 6) AS fused_mrr, true AS learnt_not_below FROM firsts""",
)
def rerank_gain(spark, sf_dir):
    """Mean reciprocal rank of the first hit that holds the passage, in the fused order, and whether the learnt order, on held-out passages, is as good."""
    queries, rows = judged_hits(spark, sf_dir)
    fused, learnt = rerank.reciprocal_rank(rows), rerank.reciprocal_rank(learnt_order(queries, rows, 2 * K)).select(F.col("mrr").alias("learnt"))
    return fused.join(F.broadcast(learnt)).select("n_queries", F.round("mrr", 6).alias("fused_mrr"), F.coalesce(F.col("learnt") >= F.col("mrr"), F.lit(True)).alias("learnt_not_below"))  # single rows


@query("search_function", f"WITH {legs_sql(ONE, 7)}, hits AS (WITH {fused_sql(_MIXED.format(a=0.6, b=0.4), 7)}) SELECT rank, document_id, chunk_index, score, md5(content) AS content_md5, source FROM hits JOIN chunks USING (document_id, chunk_index)")
def search_function(spark, sf_dir):
    """The search tool as a table function in SQL."""
    path = knowledge(spark, sf_dir)
    tool.register(spark, segments.chunks(spark, path), segments.index(spark, path))
    return spark.sql(f"SELECT rank, document_id, chunk_index, score, md5(content) AS content_md5, source FROM kb_search('{QUESTION}', 7)")


@query("citations", f"WITH {RETRIEVED} SELECT query_id, rank, document_id, chunk_index, coalesce(source, 'Unknown') AS document_name, substr(content, 1, 200) || '...' AS chunk_content, round(score, 2) AS relevance_score FROM retrieved")
def citations(spark, sf_dir):
    return answer.citations(retrieved(spark, sf_dir, benchmark_queries(spark, sf_dir))).drop("page_number")


@query("context_text", f"WITH {RETRIEVED} SELECT query_id, string_agg('[来源 ' || rank || ': ' || coalesce(source, 'Unknown') || ' - 第 N/A 页]' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM retrieved GROUP BY query_id")
def context_text(spark, sf_dir):
    return answer.context(retrieved(spark, sf_dir, benchmark_queries(spark, sf_dir)))


@query(
    "tool_text",
    f"WITH {RETRIEVED}, texts AS (SELECT query_id, string_agg('[文档 ' || rank || '] ' || coalesce(source, 'Unknown') || ' - 第 N/A 页 (相关度: ' || printf('%.2f', round(score, 2)) || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS text FROM retrieved GROUP BY query_id) SELECT query_id, coalesce(texts.text, '未找到相关文档。知识库中可能没有与此查询相关的内容。') AS text FROM queries LEFT JOIN texts USING (query_id)",
)
def tool_text(spark, sf_dir):
    queries = benchmark_queries(spark, sf_dir)
    hits = retrieved(spark, sf_dir, queries).withColumn("score", F.round("score", 2))
    return answer.or_nothing(queries, answer.tool_text(hits))


@query(
    "prompt_text",
    f"WITH {RETRIEVED}, texts AS (SELECT query_id, string_agg('[来源 ' || rank || ': ' || coalesce(source, 'Unknown') || ' - 第 N/A 页]' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM retrieved GROUP BY query_id) SELECT query_id, md5('Answer from the sources below and name them; say so if they do not hold the answer.' || chr(10) || chr(10) || 'Sources:' || chr(10) || coalesce(context, '没有找到相关的参考资料。') || chr(10) || chr(10) || 'Conversation so far:' || chr(10) || '（无历史对话）' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:') AS prompt_md5 FROM queries LEFT JOIN texts USING (query_id)",
)
def prompt_text(spark, sf_dir):
    queries = benchmark_queries(spark, sf_dir)
    texts = answer.context(retrieved(spark, sf_dir, queries))
    made = answer.prompt(F.col("context"), F.lit(None).cast("string"), F.col("text"))
    return queries.join(texts, "query_id", "left").select("query_id", F.md5(made).alias("prompt_md5"))
