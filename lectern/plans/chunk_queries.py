"""Queries over documents: sources, chunkers, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import catalog, chunking
from lectern.plans.base import CHUNKS, FILENAME, OVERLAP, SIZE, STATUS, chunks, query, table
from lectern.sources import files, kb
from lectern.sources.shared import scratch


@query("chunk_fixed", f"WITH {CHUNKS} SELECT document_id, chunk_index, content FROM chunks")
def chunk_fixed(spark, sf_dir):
    return chunks(spark, sf_dir).select("document_id", "chunk_index", "content")


@query(
    "chunk_fixed_offsets",
    """SELECT doc_id, i::INTEGER AS chunk_index, (i * 450)::INTEGER AS start_char, least(i * 450 + 500, length(text))::INTEGER AS end_char, md5(substr(text, i * 450 + 1, 500)) AS content_md5
FROM documents, unnest(range(0, 1 + greatest(0, ceil((length(text) - 500) / 450.0))::BIGINT)) u(i) WHERE length(text) > 0""",
)
def chunk_fixed_offsets(spark, sf_dir):
    rows = chunking.fixed(table(spark, sf_dir, "documents"), 500, 50)
    return rows.select("doc_id", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_md5"))


@query(
    "chunk_delimiter",
    """WITH parts AS (SELECT doc_id, string_split(text, '. ') AS p FROM documents),
each AS (SELECT doc_id, i, regexp_replace(p[i], '^\\s+|\\s+$', '', 'g') AS part FROM parts, unnest(range(1, len(p) + 1)) u(i))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, CASE WHEN i > 1 THEN '. ' || part ELSE part END AS content
FROM each WHERE length(part) > 0""",
)
def chunk_delimiter(spark, sf_dir):
    return chunking.delimited(table(spark, sf_dir, "documents"), ". ").select("doc_id", "chunk_index", "content")


@query(
    "chunk_paragraph",
    """WITH parts AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), repeat(chr(10), 3)), '\\n\\n+') AS p FROM documents)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, p[i] AS content FROM parts, unnest(range(1, len(p) + 1)) u(i) WHERE p[i] <> ''""",
)
def chunk_paragraph(spark, sf_dir):
    """The texts have single line ends, which become blank lines first."""
    rows = table(spark, sf_dir, "documents").withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n")))
    return chunking.paragraphs(rows).select("doc_id", "chunk_index", "content")


def segments(spark, sf_dir):
    """Paragraphs as pages."""
    rows = chunking.paragraphs(table(spark, sf_dir, "documents"), "\n+")
    return rows.select(F.col("doc_id").alias("document_id"), F.col("chunk_index").alias("index"), "content", (F.col("chunk_index") + 1).alias("page_number"))


SEGMENTS = """parts AS (SELECT doc_id, regexp_split_to_array(text, '\\n+') AS p FROM documents),
segments AS (SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS index, p[i] AS content FROM parts, unnest(range(1, len(p) + 1)) u(i) WHERE p[i] <> '')"""


@query("chunk_page", f"WITH {SEGMENTS} SELECT document_id, index AS chunk_index, content, index + 1 AS page_number, 0 AS start_char, length(content)::INTEGER AS end_char FROM segments")
def chunk_page(spark, sf_dir):
    return chunking.pages(segments(spark, sf_dir))


@query("segment_concat", f"WITH {SEGMENTS} SELECT document_id, string_agg(content, chr(10) ORDER BY index) AS text FROM segments GROUP BY document_id")
def segment_concat(spark, sf_dir):
    return chunking.joined(segments(spark, sf_dir))


@query(
    "chunk_stats",
    f"""WITH {CHUNKS} SELECT source, count(*) AS n_chunks, sum(length(content))::BIGINT AS total_chars, floor(avg(length(content)) + 0.5)::BIGINT AS mean_chars,
min(length(content))::BIGINT AS min_chars, max(length(content))::BIGINT AS max_chars FROM chunks GROUP BY source""",
)
def chunk_stats(spark, sf_dir):
    return chunking.statistics(chunks(spark, sf_dir), "source")


@query(
    "manual_chunks",
    f"WITH {CHUNKS} SELECT document_id, count(*) AS chunk_count, sum(length(content))::BIGINT AS total_characters, max(chunk_index)::VARCHAR AS last_index FROM chunks GROUP BY document_id",
)
def manual_chunks(spark, sf_dir):
    rows = chunking.for_submission(chunks(spark, sf_dir))
    return rows.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.sum("end_char").cast("long").alias("total_characters"), F.max(F.element_at("metadata", "chunk_index").cast("int")).cast("string").alias("last_index")
    )


def manual(spark, sf_dir):
    """Manual uploads of the documents' windows: each fifth document brings none, each chunk's metadata names its language."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr(FILENAME).alias("filename"), F.col("n_chars").alias("file_size"), "lang")
    requests = docs.withColumn("file_type", F.substring(T.suffix(F.col("filename")), 2, 10)).drop("lang")
    cut = chunks(spark, sf_dir).where("document_id % 5 <> 0").join(docs.select("document_id", "lang"), "document_id")
    page = F.when(F.col("chunk_index") % 2 == 0, F.col("chunk_index") + 1)
    own = F.when(F.col("chunk_index") % 3 == 0, F.create_map(F.lit("source"), F.col("lang"), F.lit("lang"), F.col("lang")))
    return catalog.manual_documents(requests, cut.select("document_id", "chunk_index", "content", page.alias("page_number"), "start_char", "end_char", own.alias("metadata")))


_MANUAL = f"""requests AS (SELECT doc_id AS document_id, {FILENAME} AS filename, substr(lower(regexp_extract({FILENAME}, '\\.[^./]+$')), 2) AS file_type, n_chars AS file_size, lang FROM documents),
cut AS (SELECT * FROM chunks WHERE document_id % 5 <> 0),
sizes AS (SELECT document_id, count(*) AS chunk_count, sum(length(content))::BIGINT AS total_characters FROM cut GROUP BY 1),
judged AS (SELECT *, CASE WHEN chunk_count IS NULL THEN 'Chunks cannot be empty' WHEN file_type NOT IN ('pdf', 'txt', 'md') THEN 'Unsupported file type: ' || file_type END AS reason FROM requests LEFT JOIN sizes USING (document_id))"""


@query("manual_documents", f"WITH {CHUNKS}, {_MANUAL} SELECT document_id AS id, filename, file_type, file_size, 'manual://' || document_id AS file_path, 'completed' AS status, 100 AS processing_progress, 'completed' AS current_stage, chunk_count, total_characters FROM judged WHERE reason IS NULL")
def manual_documents(spark, sf_dir):
    return manual(spark, sf_dir)[0]


@query("manual_rejected", f"WITH {CHUNKS}, {_MANUAL} SELECT document_id, filename, reason FROM judged WHERE reason IS NOT NULL")
def manual_rejected(spark, sf_dir):
    return manual(spark, sf_dir)[2]


@query(
    "manual_metadata",
    f"""WITH {CHUNKS}, {_MANUAL} SELECT document_id, chunk_index, document_id || '_' || chunk_index AS vector_id, CASE WHEN chunk_index % 3 = 0 THEN lang ELSE filename END AS source, file_type,
CASE WHEN chunk_index % 2 = 0 THEN (chunk_index + 1)::VARCHAR END AS page, CASE WHEN chunk_index % 3 = 0 THEN lang END AS lang, md5(content) AS content_md5 FROM cut JOIN judged USING (document_id) WHERE reason IS NULL""",
)
def manual_metadata(spark, sf_dir):
    """What a chunk's own metadata say goes over the defaults."""
    rows = manual(spark, sf_dir)[1]
    names = [F.element_at("metadata", name).alias(name) for name in ("source", "file_type", "page", "lang")]
    return rows.select("document_id", "chunk_index", "vector_id", *names, F.md5("content").alias("content_md5"))


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return chunking.recursive(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "content")


@query(
    "chunk_recursive_checked",
    """SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) > 0 AS has_chunks, true AS gapless, true AS none_too_long, true AS all_from_text, true AS in_order, true AS nothing_lost
FROM documents""",
)
def chunk_recursive_checked(spark, sf_dir):
    """What holds for every text's chunks: numbers without gaps, none longer than the size, all found in the text in this order, no character but white space lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = chunking.recursive_spans(docs).select("doc_id", "chunk_index", "start_char", "content").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "start_char", "content"))).alias("chunks"))
    rows = docs.join(rows, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.expr("array()")))
    # Each chunk is compared with the text where it is said to start, from the overlap before the end so far: in a text that repeats itself it
    # stands in other places too. What lies between an end and the next start is no text.
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(True).alias("found"), F.lit(True).alias("whole"))

    def step(state, chunk):
        at = chunk["start_char"] + 1
        here = (at > F.greatest(state["at"], state["end"] - OVERLAP)) & (F.substr("text", at, F.length(chunk["content"])) == chunk["content"])
        between = F.when(at - 1 > state["end"], F.substr("text", state["end"] + 1, at - 1 - state["end"])).otherwise("")
        end = F.greatest(state["end"], at - 1 + F.length(chunk["content"]))
        return F.struct((at - 1).alias("at"), end.alias("end"), (state["found"] & here).alias("found"), (state["whole"] & ~between.rlike(r"\S")).alias("whole"))

    walked = F.aggregate("chunks", start, step)
    rows = rows.withColumn("walked", walked)
    rest = F.substr("text", F.col("walked.end") + 1, F.length("text"))
    return rows.select(
        "doc_id", (F.size("chunks") > 0).alias("has_chunks"), F.forall(F.transform("chunks", lambda c, i: c["chunk_index"] == i), lambda x: x).alias("gapless"),
        F.forall("chunks", lambda c: F.length(c["content"]) <= SIZE).alias("none_too_long"), F.forall("chunks", lambda c: F.contains(F.col("text"), c["content"])).alias("all_from_text"),
        F.col("walked.found").alias("in_order"), (F.col("walked.whole") & ~rest.rlike(r"\S")).alias("nothing_lost"),
    )


@query(
    "validate_upload",
    f"""WITH f AS (SELECT doc_id, {FILENAME} AS filename, n_chars * 3000 AS size FROM documents)
SELECT doc_id, filename, size, CASE WHEN lower(regexp_extract(filename, '\\.[^./]+$')) NOT IN ('.pdf', '.txt', '.md') THEN 'unsupported' WHEN size > 50000000 THEN 'too_large' END AS reject_reason FROM f""",
)
def validate_upload(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(FILENAME).alias("filename"), (F.col("n_chars") * 3000).alias("size"))
    return rows.withColumn("reject_reason", files.reject_reason(F.col("filename"), F.col("size")))


@query(
    "parse_preview",
    f"""WITH f AS (SELECT doc_id, text, {FILENAME} AS filename FROM documents)
SELECT doc_id::VARCHAR AS document_id, 0 AS index, length(text)::INTEGER AS n_chars, filename AS source, substr(lower(regexp_extract(filename, '\\.[^./]+$')), 2) AS file_type
FROM f WHERE lower(regexp_extract(filename, '\\.[^./]+$')) IN ('.pdf', '.txt', '.md')""",
)
def parse_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr(FILENAME).alias("path"), "text")
    return files.parse(rows)[0].select("document_id", "index", F.length("content").alias("n_chars"), "source", "file_type")


@query("parse_failed", f"SELECT doc_id::VARCHAR AS document_id, 'unsupported file type: .docx' AS error FROM documents WHERE ends_with({FILENAME}, '.docx')")
def parse_failed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr(FILENAME).alias("path"), "text")
    return files.parse(rows)[1].select("document_id", "error")


@query("dump_segments", "SELECT md5(text) AS content_md5, count(*) AS n FROM documents WHERE regexp_matches(text, '\\S') GROUP BY ALL")
def dump_segments(spark, sf_dir):
    """Documents that are written as lines of JSON and read back through the data source, large files in parts."""
    path = scratch(spark, "dump")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.json(path)
    kb.register(spark, {".json": kb.json_lines("text")}, "kb_dump")
    rows = spark.read.format("kb_dump").option("splitBytes", 1 << 20).load(path)
    return rows.where("error is null").groupBy(F.md5("content").alias("content_md5")).agg(F.count("*").alias("n"))


@query(
    "file_size_format",
    """WITH s AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_extendedprice)::BIGINT AS size FROM lineitem),
r AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 ELSE 3 END AS p FROM s),
v AS (SELECT *, floor(size * 100.0::DOUBLE / (1::BIGINT << (10 * p)) + 0.5) / 100 AS v FROM r)
SELECT l_orderkey, l_linenumber, size, CASE WHEN size = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', v), '\\.?0+$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB'])[p + 1] END AS shown FROM v""",
)
def file_size_format(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * F.col("l_extendedprice")).cast("long").alias("size"))
    return rows.withColumn("shown", T.file_size(F.col("size")))


@query(
    "file_icon",
    f"""WITH f AS (SELECT doc_id, substr(lower(regexp_extract({FILENAME}, '\\.[^./]+$')), 2) AS file_type FROM documents)
SELECT doc_id, file_type, CASE file_type WHEN 'pdf' THEN '📄' WHEN 'md' THEN '📝' WHEN 'txt' THEN '📃' ELSE '📎' END AS icon FROM f""",
)
def file_icon(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(T.suffix(F.expr(FILENAME)), 2, 100).alias("file_type"))
    return rows.withColumn("icon", T.file_icon(F.col("file_type")))


@query("ellipsis", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short, substr(text, 1, 200) || '...' AS snippet FROM documents")
def ellipsis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ellipsis(F.col("text"), 100).alias("short"), T.snippet(F.col("text")).alias("snippet"))


@query("character_bigrams", "SELECT item_id, greatest(1, length(regexp_replace(text, '\\s+', '', 'g')) - 1)::INTEGER AS n, substr(regexp_replace(text, '\\s+', '', 'g'), 1, 2) AS first FROM benchmark")
def character_bigrams(spark, sf_dir):
    grams = T.bigrams(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(grams).alias("n"), F.element_at(grams, 1).alias("first"))


@query("completed_chunks", f"WITH {CHUNKS} SELECT document_id, chunk_index FROM chunks JOIN documents ON doc_id = document_id WHERE {STATUS} = 'completed'")
def completed_chunks(spark, sf_dir):
    done = table(spark, sf_dir, "documents").where(F.expr(STATUS) == "completed").select(F.col("doc_id").alias("document_id"))
    return chunks(spark, sf_dir).select("document_id", "chunk_index").join(done, "document_id", "left_semi")


@query("document_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def document_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == 42).select("doc_id", "lang", "source", "n_chars").limit(1)


@query(
    "page_text",
    "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5, url FROM pages",
)
def page_text(spark, sf_dir):
    """Pages without tags, scripts and styles, white space put together."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(bare, r"\s+", " "))).alias("text_md5"), "url")
