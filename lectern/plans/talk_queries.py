"""Queries over conversations, the catalog and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import sql
from lectern.functions import text as T
from lectern.sources.shared import alone, scratch
from lectern.operators import answer, bm25, catalog, chunking, conversation, segments, trigrams
from lectern.plans.base import CHUNKS, DIM, FILENAME, INDEX, KEYWORD_TOP, MANY, ORACLE_SQL, OVERLAP, SCORES, SIZE, STATUS, benchmark_queries, chunks, query, table
from lectern.streaming import frames, ingest, threads

NOW = "TIMESTAMP '2024-01-15 00:00:00'"


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


# ---- history and state


@query(
    "history_text",
    """WITH last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) AS history FROM last WHERE n <= 5 GROUP BY conv_id""",
)
def history_text(spark, sf_dir):
    return answer.history(messages(spark, sf_dir), 5)


@query("client_history", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def client_history(spark, sf_dir):
    return answer.last_messages(messages(spark, sf_dir), 3).select("conv_id", "turn", "role", "text")


@query(
    "trim_messages",
    """WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
SELECT conv_id, turn, role, text FROM n WHERE n <= 4 OR nth > n - 3 OR (nth = 1 AND role = 'system')""",
)
def trim_messages(spark, sf_dir):
    return conversation.trim(messages(spark, sf_dir), 3).select("conv_id", "turn", "role", "text")


@query(
    "new_thread_system",
    """SELECT conv_id, turn, role, text FROM conversations UNION ALL
SELECT conv_id, min(turn) - 1, 'system', 'Answer from the knowledge base.' FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id""",
)
def new_thread_system(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return conversation.threads(rows, "Answer from the knowledge base.", rows.where("conv_id % 3 = 0"))


def snapshots(spark, sf_dir):
    """Each message as it grows by 100 characters."""
    rows = messages(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("conv_id"), "text")
    rows = rows.select("conv_id", "text", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 100).cast("int") + 1)).alias("seq"))
    return rows.select("conv_id", "seq", F.substr("text", F.lit(1), F.col("seq") * 100).alias("content"))


@query(
    "token_delta",
    """SELECT conv_id * 100 + turn AS conv_id, s::INTEGER AS seq, substr(text, (s - 1) * 100 + 1, 100) AS delta
FROM conversations, unnest(range(1, ceil(length(text) / 100.0)::BIGINT + 1)) u(s) WHERE length(text) > (s - 1) * 100""",
)
def token_delta(spark, sf_dir):
    return conversation.deltas(snapshots(spark, sf_dir))


@query("title", "SELECT conv_id, CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END AS title FROM (SELECT conv_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def title(spark, sf_dir):
    return conversation.titles(messages(spark, sf_dir))


@query("token_count", "SELECT conv_id, turn, length(text)::INTEGER AS token_count FROM conversations WHERE role = 'assistant'")
def token_count(spark, sf_dir):
    return messages(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", F.length("text").alias("token_count"))


# ---- events


TURN = ("conv_id", "turn")


def replies(spark, sf_dir):
    """Every reply of an assistant; each seventh conversation's stream ends in an error."""
    failed = F.when(F.col("conv_id") % 7 == 0, "timeout")
    return messages(spark, sf_dir).where("role = 'assistant'").select(*TURN, F.col("text").alias("content"), failed.alias("error"))


@query(
    "event_order",
    """WITH r AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, 0 AS seq, 'citations' AS type, '[{"source":"src","content":"' || replace(replace(replace(replace(substr(text, 1, 200) || '...', '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"}]' AS data FROM r UNION ALL
SELECT conv_id, turn, i::INTEGER, 'token', CASE WHEN i < len(w) THEN w[i] || ' ' ELSE w[i] END FROM r, unnest(range(1, len(w) + 1)) u(i) WHERE i < len(w) OR w[-1] <> '' OR len(w) = 1 UNION ALL
SELECT conv_id, turn, (len(w) + 1 - CASE WHEN w[-1] = '' AND len(w) > 1 THEN 1 ELSE 0 END)::INTEGER, CASE WHEN conv_id % 7 = 0 THEN 'error' ELSE 'done' END, CASE WHEN conv_id % 7 = 0 THEN '{"message":"timeout"}' ELSE '' END FROM r""",
)
def event_order(spark, sf_dir):
    rows = replies(spark, sf_dir)
    cites = rows.select(*TURN, F.struct(F.lit("src").alias("source"), T.snippet(F.col("content")).alias("content")).alias("citation"))
    return answer.events(rows, cites, keys=TURN)


@query("event_stream", ORACLE_SQL["event_order"])
def event_stream(spark, sf_dir):
    """The same events out of the frames that a stream of the replies wrote."""
    rows, source, target = replies(spark, sf_dir), scratch(spark, "replies"), scratch(spark, "frames")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    cite = lambda r: r.select(*TURN, F.struct(F.lit("src").alias("source"), T.snippet(F.col("content")).alias("content")).alias("citation"))
    frames.event_stream(stream, target, scratch(spark, "frames-checkpoint"), cite, TURN).awaitTermination()
    return frames.events(frames.written(spark, target), TURN)


@query(
    "sse_encode",
    """SELECT conv_id, turn, 'data: {"type":"' || role || '","data":"' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"}' || chr(10) || chr(10) AS frame FROM conversations""",
)
def sse_encode(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", "turn", answer.frame(F.col("role"), F.col("text")).alias("frame"))


@query("sse_decode", "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND conv_id % 7 <> 0")
def sse_decode(spark, sf_dir):
    """Replies framed word by word and decoded again; streams that end in an error give nothing."""
    rows = replies(spark, sf_dir)
    found = answer.events(rows, rows.limit(0).select(*TURN, F.struct("content").alias("citation")), keys=TURN)
    streams = answer.in_order(found.withColumn("frame", answer.frame(F.col("type"), F.col("data"))), list(TURN), "seq", "frame", "", "stream")
    return answer.decode(streams, TURN)


@query("agent_citations", "SELECT conv_id, turn, 'knowledge base' AS source, substr('[文档 1] ' || text, 1, 200) || '...' AS content FROM conversations WHERE role = 'system'")
def agent_citations(spark, sf_dir):
    hit = F.when(F.col("role") == "system", F.concat(F.lit(answer.HIT), F.lit("1] "), F.col("text"))).otherwise(F.col("text"))
    return answer.tool_citations(messages(spark, sf_dir).withColumn("text", hit))


@query("relevance_percent", "SELECT event_id, floor(value % 1 * 100 + 0.5)::BIGINT::VARCHAR || '%' AS shown FROM events")
def relevance_percent(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.percent(F.col("value") % 1).alias("shown"))


# ---- catalog


def documents(spark, sf_dir):
    """Catalog rows made from the documents table."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.expr(FILENAME).alias("filename"), F.expr(STATUS).alias("status"), F.col("n_chars").alias("total_characters"),
        ((F.col("doc_id") * 7919) % 100003).alias("created_at"),
    )


DOCUMENTS = f"docs AS (SELECT doc_id AS id, {FILENAME} AS filename, {STATUS} AS status, n_chars AS total_characters, (doc_id * 7919) % 100003 AS created_at FROM documents)"


@query("doc_list_page", f"WITH {DOCUMENTS}, c AS (SELECT * FROM docs WHERE status = 'completed') SELECT *, (SELECT count(*) FROM c) AS total FROM c ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def doc_list_page(spark, sf_dir):
    return catalog.list_documents(documents(spark, sf_dir), "completed", 40, 20)


@query("doc_status", f"WITH {DOCUMENTS} SELECT id, status, CASE status WHEN 'completed' THEN 100 WHEN 'processing' THEN 33 ELSE 0 END AS progress FROM docs")
def doc_status(spark, sf_dir):
    """The latest of three log entries of each document."""
    rows = documents(spark, sf_dir)
    log = rows.select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("at"), F.col("status").alias("final"))
    status = F.when(F.col("at") == 3, F.col("final")).otherwise(F.element_at(F.array(F.lit("pending"), F.lit("processing"), F.lit("x")), F.col("at")))
    log = log.select("id", "at", status.alias("status"), F.when((F.col("at") == 3) & (F.col("final") == "completed"), 100).when((F.col("at") == 2) | (F.col("final") == "processing"), 33).otherwise(0).alias("progress"))
    return catalog.latest(log, "id", "at").select("id", "status", "progress")


@query("doc_with_chunks", f"WITH {CHUNKS} SELECT doc_id AS id, count(document_id)::INTEGER AS n, md5(string_agg(content, '|' ORDER BY chunk_index)) AS contents_md5 FROM documents LEFT JOIN chunks ON document_id = doc_id GROUP BY doc_id")
def doc_with_chunks(spark, sf_dir):
    rows = catalog.with_chunks(documents(spark, sf_dir), chunks(spark, sf_dir))
    return rows.select("id", F.size(F.coalesce("chunks", F.array())).alias("n"), F.md5(F.array_join(F.transform("chunks", lambda c: c["content"]), "|")).alias("contents_md5"))


@query("vector_entities", f"WITH {CHUNKS} SELECT document_id || '_' || chunk_index AS id, document_id, chunk_index::BIGINT AS chunk_index, substr(content, 1, 65535) AS content, substr(source, 1, 500) AS source, 'txt' AS file_type FROM chunks")
def vector_entities(spark, sf_dir):
    return catalog.vector_entities(chunks(spark, sf_dir).withColumn("file_type", F.lit("txt")))


@query("new_documents", f"SELECT doc_id AS id, {FILENAME} AS filename, substr(lower(regexp_extract({FILENAME}, '\\.[^./]+$')), 2) AS file_type, n_chars AS file_size, 'pending' AS status, 0 AS chunk_count FROM documents")
def new_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("/in/"), F.expr(FILENAME)).alias("path"), F.col("n_chars").alias("size"))
    return catalog.new_documents(rows).select("id", "filename", "file_type", "file_size", "status", "chunk_count")


@query(
    "sql_functions",
    "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))::INTEGER AS n_tokens, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS short, (1 + greatest(0, ceil((length(text) - 1000) / 800.0)))::INTEGER AS n_windows FROM documents WHERE length(text) > 0",
)
def sql_functions(spark, sf_dir):
    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("kb_documents")
    return spark.sql("SELECT doc_id, size(kb_tokens(text)) AS n_tokens, kb_ellipsis(text, 20) AS short, size(kb_windows(text, 1000, 200)) AS n_windows FROM kb_documents WHERE length(text) > 0")


_CONV = """convs AS (SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn, max_by(text, turn) AS t FROM conversations GROUP BY conv_id),
shown AS (SELECT conv_id, message_count, last_turn, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS last_message FROM convs)"""


@query("conv_list_last_message", f"WITH {_CONV} SELECT *, (SELECT count(*) FROM shown) AS total FROM shown ORDER BY last_turn DESC, conv_id LIMIT 20 OFFSET 5")
def conv_list_last_message(spark, sf_dir):
    return catalog.page(catalog.conversations(messages(spark, sf_dir)), [F.col("last_turn").desc(), F.col("conv_id")], 5, 20)


@query("conv_messages", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def conv_messages(spark, sf_dir):
    return messages(spark, sf_dir).where("conv_id = 3").orderBy("turn").select("conv_id", "turn", "role", "text")


@query(
    "conv_search",
    f"WITH {_CONV}, titled AS (SELECT conv_id, CASE WHEN length(f) > 50 THEN substr(f, 1, 50) || '...' ELSE f END AS title FROM (SELECT conv_id, min_by(text, turn) AS f FROM conversations WHERE role = 'user' GROUP BY conv_id)) SELECT conv_id, title, last_message FROM shown LEFT JOIN titled USING (conv_id) WHERE contains(lower(title), 'tion') OR contains(lower(last_message), 'tion')",
)
def conv_search(spark, sf_dir):
    rows = messages(spark, sf_dir)
    found = catalog.conversations(rows).join(conversation.titles(rows), "conv_id", "left")
    return catalog.search_conversations(found, "TION").select("conv_id", "title", "last_message")


_TITLED = "titled AS (SELECT conv_id, CASE WHEN length(f) > 50 THEN substr(f, 1, 50) || '...' ELSE f END AS title FROM (SELECT conv_id, min_by(text, turn) AS f FROM conversations WHERE role = 'user' GROUP BY conv_id))"


@query(
    "conv_search_many",
    f"""WITH {_CONV}, {_TITLED}, seen AS (SELECT * FROM shown LEFT JOIN titled USING (conv_id)),
patterns AS (SELECT DISTINCT CASE WHEN conv_id % 3 = 0 THEN translate(substr(text, 4, 6), 'abcdefghijklm', 'ABCDEFGHIJKLM') WHEN conv_id % 3 = 1 THEN substr(text, 2, 4) ELSE substr(text, 1, 3) END AS pattern FROM conversations)
SELECT pattern, conv_id FROM patterns JOIN seen ON coalesce(contains(lower(title), lower(pattern)), false) OR coalesce(contains(lower(last_message), lower(pattern)), false)""",
)
def conv_search_many(spark, sf_dir):
    """Pieces of all messages as patterns, searched by trigrams in the titles and last messages of all conversations."""
    rows, folder = messages(spark, sf_dir), scratch(spark, "trigrams")
    trigrams.build(catalog.conversations(rows).join(conversation.titles(rows), "conv_id", "left"), folder, "conv_id", "title", "last_message")
    text = F.col("text")
    piece = F.when(F.col("conv_id") % 3 == 0, F.translate(F.substring(text, 4, 6), "abcdefghijklm", "ABCDEFGHIJKLM")).when(F.col("conv_id") % 3 == 1, F.substring(text, 2, 4)).otherwise(F.substring(text, 1, 3))
    patterns = table(spark, sf_dir, "conversations").select(piece.alias("pattern")).where("pattern is not null").distinct().select(F.col("pattern").alias("pattern_id"), "pattern")
    return trigrams.search(spark, folder, patterns, "conv_id", "title", "last_message").withColumnRenamed("pattern_id", "pattern")


_DAYS = f"floor((epoch_us({NOW}) - epoch_us(ts)) / 86400e6)"


@query(
    "recency_groups",
    f"SELECT CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN 'last7' WHEN d < 30 THEN 'last30' ELSE 'older' END AS recency, count(*) AS n FROM (SELECT {_DAYS} AS d FROM events) GROUP BY 1",
)
def recency_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(T.recency(F.col("ts").cast("timestamp"), F.expr(NOW)).alias("recency")).agg(F.count("*").alias("n"))


@query(
    "relative_time",
    f"""WITH s AS (SELECT event_id, ts, floor((epoch_us({NOW}) - epoch_us(ts)) / 1e6)::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || ' minutes ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || ' hours ago'
WHEN s < 691200 THEN floor(s / 86400)::BIGINT || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS shown FROM s""",
)
def relative_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.relative_time(F.col("ts").cast("timestamp"), F.expr(NOW)).alias("shown"))


@query(
    "relative_time_week",
    f"""WITH s AS (SELECT event_id, ts, floor((epoch_us({NOW}) - epoch_us(ts)) / 1e6)::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || ' minutes ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || ' hours ago'
WHEN s < 604800 THEN floor(s / 86400)::BIGINT || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS shown FROM s""",
)
def relative_time_week(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.relative_time(F.col("ts").cast("timestamp"), F.expr(NOW), days=6).alias("shown"))


_UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21)"


@query(
    "uuid_check",
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN {_UUID} WHEN 1 THEN m WHEN 2 THEN 'urn:uuid:' || {_UUID} WHEN 3 THEN substr({_UUID}, 2) ELSE source END AS id, doc_id % 5 < 3 AS valid
FROM (SELECT doc_id, source, md5(text) AS m FROM documents)""",
)
def uuid_check(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("m"))
    shown = f"CASE doc_id % 5 WHEN 0 THEN {_UUID} WHEN 1 THEN m WHEN 2 THEN 'urn:uuid:' || {_UUID} WHEN 3 THEN substr({_UUID}, 2) ELSE source END"
    return rows.select("doc_id", F.expr(shown).alias("id")).withColumn("valid", T.is_uuid(F.col("id")))


@query("delete_cascade", f"WITH {CHUNKS} SELECT document_id, chunk_index FROM chunks WHERE document_id % 10 <> 0")
def delete_cascade(spark, sf_dir):
    gone = documents(spark, sf_dir).where("status = 'failed'").select(F.col("id").alias("document_id"))
    return catalog.without(chunks(spark, sf_dir), gone, "document_id").select("document_id", "chunk_index")


@query("delete_conversation", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 <> 1")
def delete_conversation(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return catalog.without(rows, rows.where("conv_id % 4 = 1"), "conv_id").select("conv_id", "turn")


@query("message_count", "SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def message_count(spark, sf_dir):
    return catalog.conversations(messages(spark, sf_dir)).select("conv_id", "message_count", "last_turn")


@query("provider_groups", "SELECT c_mktsegment AS category, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_configured FROM customer GROUP BY 1")
def provider_groups(spark, sf_dir):
    return catalog.by_category(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), (F.col("c_acctbal") > 0).alias("is_configured")))


@query("first_models", "SELECT p_brand, list(p_partkey ORDER BY p_partkey)[1:3]::VARCHAR AS first FROM part GROUP BY p_brand")
def first_models(spark, sf_dir):
    rows = catalog.rank_in_pages(table(spark, sf_dir, "part"), "p_brand", [F.col("p_partkey")], 3)
    rows = rows.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("first"))
    return rows.select("p_brand", F.concat(F.lit("["), F.array_join("first", ", "), F.lit("]")).alias("first"))


@query("toggle_selection", "SELECT conv_id, list_sort(CASE WHEN list_contains(t, 2) THEN list_filter(t, lambda x: x <> 2) ELSE list_append(t, 2) END)::VARCHAR AS selected FROM (SELECT conv_id, list(turn) AS t FROM conversations GROUP BY conv_id)")
def toggle_selection(spark, sf_dir):
    rows = messages(spark, sf_dir).groupBy("conv_id").agg(F.collect_list("turn").alias("t"))
    return rows.select("conv_id", F.concat(F.lit("["), F.array_join(F.array_sort(catalog.toggled(F.col("t"), F.lit(2).cast("long"))), ", "), F.lit("]")).alias("selected"))


@query("patch_by_id", "SELECT doc_id, CASE WHEN doc_id = 5 THEN 'completed' ELSE lang END AS lang FROM documents WHERE doc_id <> 6")
def patch_by_id(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").where("doc_id <> 6")
    return catalog.patched(rows, "doc_id", 5, {"lang": F.lit("completed")})


@query("orders_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 100")
def orders_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return catalog.page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100, 20)


POSTED = """m AS (SELECT conv_id, turn, role, text, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn::BIGINT) AS created_at FROM conversations)"""


@query(
    "posted_conversations",
    f"""WITH {POSTED} SELECT conv_id, md5(arg_min(CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END, turn)) AS title_md5, count(*) AS message_count,
  min(created_at) AS created_at, coalesce(max(created_at) FILTER (role = 'assistant'), min(created_at)) AS updated_at FROM m GROUP BY conv_id""",
)
def posted_conversations(spark, sf_dir):
    """Conversations posted in three parts, one of them twice: titles from their first messages, counts, and when a reply last came."""
    folder, rows = scratch(spark, "posted"), table(spark, sf_dir, "conversations").withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, turn)"))
    for part, name in (("turn < 2", "a"), ("turn >= 2 and turn % 2 = 0", "b"), ("turn >= 2 and turn % 2 = 0", "b"), ("turn >= 2 and turn % 2 = 1", "c")):
        conversation.post(rows.where(part), folder, name)
    found = conversation.listed(spark, folder)
    return found.select("conv_id", F.md5("title").alias("title_md5"), "message_count", "created_at", "updated_at")


# ---- streams


@query(
    "stream_ingest",
    f"WITH {CHUNKS} SELECT document_id, chunk_index, md5(content) AS content_md5 FROM chunks",
)
def stream_ingest(spark, sf_dir):
    """Documents arriving as files, cut into windows by a stream; the sink's table."""
    folder = scratch(spark, "stream-ingest")
    schema = table(spark, sf_dir, "documents").schema
    ingest.chunk_stream(spark, alone(f"{sf_dir}/documents.parquet"), f"{folder}/chunks", f"{folder}/state", schema, split=lambda rows: chunking.fixed(rows, SIZE, OVERLAP)).awaitTermination()
    return spark.read.parquet(f"{folder}/chunks").select("document_id", "chunk_index", F.md5("content").alias("content_md5"))


def indexed(spark, sf_dir):
    """The documents as a stream of files, indexed to the end."""
    folder = scratch(spark, "index-stream")
    schema = table(spark, sf_dir, "documents").schema
    rows = spark.readStream.schema(schema).parquet(alone(f"{sf_dir}/documents.parquet"))
    rows = rows.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("/in/"), F.expr(FILENAME)).alias("path"), "text")
    windows = lambda docs: chunking.fixed(docs, SIZE, OVERLAP)
    ingest.index_stream(spark, rows, folder, f"{folder}/state", DIM, split=windows).awaitTermination()
    return folder


@query(
    "ingest_status",
    f"""WITH {CHUNKS}, sizes AS (SELECT document_id, count(*) AS n, sum(length(content))::BIGINT AS size FROM chunks GROUP BY 1),
d AS (SELECT doc_id, ends_with({FILENAME}, '.docx') AS bad FROM documents)
SELECT doc_id::VARCHAR AS document_id, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 0 ELSE 100 END AS progress, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS current_stage,
CASE WHEN bad THEN 'unsupported file type: .docx' END AS error_message, CASE WHEN bad THEN 0 ELSE coalesce(n, 0) END AS chunk_count, CASE WHEN bad THEN 0 ELSE coalesce(size, 0) END AS total_characters
FROM d LEFT JOIN sizes ON document_id = doc_id""",
)
def ingest_status(spark, sf_dir):
    """The latest status of every document that an index stream read."""
    return ingest.index(spark, indexed(spark, sf_dir))[2]


@query(
    "ingest_search",
    f"""WITH good AS (SELECT * REPLACE (doc_id::VARCHAR AS doc_id) FROM (SELECT * FROM documents WHERE NOT ends_with({FILENAME}, '.docx'))), {INDEX.replace('FROM documents,', 'FROM good,')}, {MANY}, {SCORES}, {KEYWORD_TOP.format(k=3)}
SELECT query_id, rank::INTEGER AS rank, document_id, chunk_index, bm25_score FROM keyword_top""",
)
def ingest_search(spark, sf_dir):
    """Keyword search over what the index stream wrote; documents that failed are not in it."""
    return segments.search(f"{indexed(spark, sf_dir)}/index", benchmark_queries(spark, sf_dir), 3)


@query("replayed_stream", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def replayed_stream(spark, sf_dir):
    """Documents that arrive twice, in two batches of a stream, are kept once each, and those with equal texts all."""
    folder, rows = scratch(spark, "replayed-stream"), table(spark, sf_dir, "documents").select("doc_id", "text")
    for hour in (0, 1):  # a batch for each arrival, of however many files
        rows.withColumn("arrived", F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("doc_id long, text string, arrived timestamp").parquet(f"{folder}/in")
        docs = stream.select(F.col("doc_id").alias("document_id"), "text", "arrived", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
        ingest.once(docs, "arrived", "2 hours").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("document_id").alias("doc_id"), F.md5("text").alias("text_md5"))


@query(
    "thread_state_stream",
    """SELECT conv_id, count(*) AS n_messages, md5(string_agg(CASE WHEN n <= 3 THEN text END, '|' ORDER BY turn)) AS last_md5
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) GROUP BY conv_id""",
)
def thread_state_stream(spark, sf_dir):
    """The last three messages of every thread, kept as state while messages arrive; the last update of each thread."""
    folder = scratch(spark, "thread-state")
    source = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(alone(f"{sf_dir}/conversations.parquet"))
    updates = threads.last_messages(source, 3)

    def append(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    writer = updates.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    rows = spark.read.schema("conv_id long, n_messages long, turns array<long>, texts array<string>, batch int").parquet(f"{folder}/updates")
    return catalog.latest(rows, "conv_id", "batch").select("conv_id", "n_messages", F.md5(F.array_join("texts", "|")).alias("last_md5"))


ARRIVALS = "CASE WHEN turn < 2 THEN 0 WHEN turn < 5 THEN 1 ELSE 2 END"
HISTORY_SQL = f"""WITH m AS (SELECT conv_id, turn, role, text, {ARRIVALS} AS batch FROM conversations),
c AS (SELECT conv_id, batch, row_number() OVER (PARTITION BY conv_id ORDER BY batch) AS checkpoint_id FROM (SELECT DISTINCT conv_id, batch FROM m)),
s AS (SELECT c.conv_id, checkpoint_id, turn, role, text, row_number() OVER (PARTITION BY c.conv_id, checkpoint_id ORDER BY turn DESC) AS n FROM c JOIN m ON m.conv_id = c.conv_id AND m.batch <= c.batch)"""


def arriving(spark, sf_dir):
    """(folder, rows) of the conversations as a stream with history: three arrivals, each read by a stream that starts anew."""
    folder, rows = scratch(spark, "thread-history"), table(spark, sf_dir, "conversations")
    for batch in range(3):
        rows.where(f"{ARRIVALS} = {batch}").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        out = threads.with_history(stream, 3).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    return folder, spark.read.schema(threads.HISTORY).parquet(f"{folder}/out")


@query(
    "thread_history_stream",
    f"{HISTORY_SQL} SELECT conv_id, checkpoint_id, (checkpoint_id > 1)::BIGINT AS has_parent, count(*) AS n_messages, md5(string_agg(CASE WHEN n <= 3 THEN text END, '|' ORDER BY turn)) AS last_md5 FROM s GROUP BY conv_id, checkpoint_id",
)
def thread_history_stream(spark, sf_dir):
    """Every checkpoint of every thread, with its parent and its newest messages."""
    rows = arriving(spark, sf_dir)[1]
    has_parent = (F.coalesce("parent_id", F.lit(0)) == F.col("checkpoint_id") - 1) & (F.col("checkpoint_id") > 1)
    return rows.select("conv_id", "checkpoint_id", has_parent.cast("long").alias("has_parent"), "n_messages", F.md5(F.concat_ws("|", "texts")).alias("last_md5"))


@query("thread_state_at", f"{HISTORY_SQL} SELECT conv_id, checkpoint_id, turn, role, md5(text) AS text_md5 FROM s")
def thread_state_at(spark, sf_dir):
    """All messages that each thread had at each of its checkpoints, read back from the stream's state."""
    state = f"{arriving(spark, sf_dir)[0]}/state"
    found = threads.state_at(spark, state, threads.checkpoints(spark, state))
    return found.select("conv_id", "checkpoint_id", "turn", "role", F.md5("text").alias("text_md5"))
