"""Golden examples of search, fusion, answers and conversations."""

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import sql
from lectern.functions import text as T
from lectern.operators import answer, bm25, catalog, conversation, fusion, hnsw, segments, tool, trigrams, vector_store, vectors
from lectern.sources import files, snapshots
from lectern.sources.shared import written
from lectern.streaming import ingest, threads

TEXTS = ["spark runs sql", "spark streams events fast", "vector search engine", "spark vector index"]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "document_id long, chunk_index int, content string")
    return bm25.build(rows)


def ask(spark, index, text):
    scored = bm25.scores(index, spark.createDataFrame([(0, text)], "query_id long, text string"))
    rows = bm25.with_zeros(index, scored, F.lit(0)).orderBy("document_id").collect()
    return [round(r.bm25_score, 6) for r in rows]


def test_bm25_goldens(spark, index):
    idf = {r.tok: round(r.idf, 6) for r in index.idf.collect()}
    assert (idf["spark"], idf["vector"], idf["sql"]) == (0.148277, 0.0, 0.847298)
    assert ask(spark, index, "spark vector") == [0.153594, 0.134328, 0.0, 0.153594]
    assert ask(spark, index, "vector vector") == [0.0] * 4


def test_index_round_trip(spark, index, tmp_path):
    bm25.save(index, f"file://{tmp_path}/index")
    assert ask(spark, bm25.load(spark, f"file://{tmp_path}/index"), "spark vector") == [0.153594, 0.134328, 0.0, 0.153594]


def test_fusion_goldens(spark):
    leg = lambda rows, score: spark.createDataFrame([(0, d, 0, s) for d, s in rows], f"query_id long, document_id long, chunk_index int, {score} double")
    vector, keyword = leg([(1, 0.9), (2, 0.8), (3, 0.7)], "vector_score"), leg([(2, 6.0), (4, 4.0), (1, 0.0)], "bm25_score")
    rows = fusion.weighted(vector, keyword, 0.6).orderBy("rank").collect()
    assert [(r.document_id, r.score) for r in rows] == [(2, 0.7), (1, 0.6), (4, 0.266667), (3, 0.0)]
    rows = fusion.raw(vector, keyword).orderBy("rank").collect()
    assert [(r.document_id, r.score) for r in rows] == [(4, 4.0), (1, 0.9), (2, 0.8), (3, 0.7)]
    assert fusion.weighted(leg([(1, 0.9)], "vector_score"), keyword.limit(0), 0.6).first().score == 0.0


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [4.0, 3.0])], "vec_id long, embedding array<float>")
    unit = {r.vec_id: list(r.u) for r in rows.select("vec_id", vectors.normalize(F.col("embedding")).alias("u")).collect()}
    assert unit[0] == [0.0, 0.0] and unit[1] == pytest.approx([0.6, 0.8])
    assert [r.vec_id for r in vectors.top_k(rows, [3.0, 4.0], 2).collect()] == [1, 2]
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    small = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vectors.batch_top_k(rows, queries, 1, query_bytes=16).collect()}
    assert small[1, 1] == (2, 0.96) and small[2, 1] == (1, 0.96) and small[0, 1] == (1, 0.0)


def test_inverted_file_recall(spark):
    """Every query of the batch search, with the mean recall that is asked for."""
    from lectern.plans.search_queries import K, ivf_reads, ivf_recall

    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        rows, reads = ivf_recall(spark, folder).collect(), ivf_reads(spark, folder).collect()
        asked = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
        assert {r.query_id for r in rows} == asked == {r.query_id for r in reads} and len(rows) == len(reads) == len(asked)
        assert all(r.k == K and 4 <= c.lists <= 16 for r, c in zip(rows, reads))
        assert sum(r.found for r in rows) / sum(r.k for r in rows) >= 0.9


def planted(n, lists, dim, spread, seed=3):
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(lists)]
    return [(i, i % 5, [x + draw.gauss(0, spread) for x in centers[i % lists]]) for i in range(n)]


def test_inverted_file_skips_lists(spark, tmp_path):
    """Where vectors do cluster, lists are left unread and nothing is lost; the plan reads the asked lists' folders only."""
    rows = spark.createDataFrame(planted(600, 12, 8, 0.05), "vec_id long, document_id int, embedding array<double>")
    path = f"file://{tmp_path}/ivf"
    vector_store.create(rows, path, 12)
    queries = rows.where("vec_id < 36").select(F.col("vec_id").alias("query_id"), "embedding")
    found, reads = vector_store.search(path, queries, 10, 1, query_bytes=1024)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vectors.batch_top_k(rows, queries, 10).collect()))
    counts = reads.collect()
    assert len(counts) == 36 and sum(r.lists for r in counts) < 36 * 6 and sum(r.codes for r in counts) < 36 * 300
    narrow = vector_store.search(path, queries, 10, 1, widen=False)[1].collect()
    assert {r.lists for r in narrow} == {1}


def test_inverted_file_plan(spark, tmp_path):
    """Codes and vectors are read by folders, and codes take a byte where the vectors' floats take four."""
    rows = spark.createDataFrame(planted(400, 8, 16, 0.1), "vec_id long, document_id int, embedding array<float>")
    path = f"file://{tmp_path}/ivf"
    vector_store.create(rows, path, 8)
    codes, lists, quantizer = vector_store.live_codes(spark, path), vector_store.lists_of(spark, path), vector_store.quantizer_of(spark, path)
    ids, wanted = np.array([3]), vectors._unit(np.array([rows.where("vec_id = 3").first().embedding]))
    reads = np.arange(8)[None, :] < 2
    kept = vector_store._survivors(codes, (ids, wanted, reads, np.full(1, -np.inf), quantizer, lists.slack), 5, 6)
    scored = vector_store._scored(vector_store.live(spark, path), kept, ids, wanted, [0, 1], 6)
    for frame in (kept, scored):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
        assert filters and all("cid" in line.split("PartitionFilters: [")[1].split("]")[0] for line in filters)
    assert codes.agg(F.sum(F.octet_length("code"))).first()[0] * 4 == 400 * 16 * 4
    wrong = vectors._unit(np.array([r.embedding for r in rows.collect()]))
    assert np.abs(quantizer.decode(quantizer.encode(wrong)) - wrong).max() <= quantizer.step.max() / 2 + 1e-12


def test_vector_batches(spark, tmp_path):
    """A batch whose last table is missing is not read; vectors beyond the codes' range are found; an id may come again after its delete."""
    rows = spark.createDataFrame(planted(200, 4, 6, 0.3), "vec_id long, document_id int, embedding array<double>")
    path = f"file://{tmp_path}/vectors"
    vector_store.create(rows.where("vec_id < 100"), path, 4)
    vector_store.insert(rows.where("vec_id >= 100"), path)
    far = spark.createDataFrame([(1000, 9, [0.0, 0.0, 0.0, 0.0, 0.0, -5.0]), (1001, 9, [0.0, 0.0, 0.0, 0.0, 0.1, -5.0])], rows.schema)
    vector_store.insert(far, path)
    queries = rows.unionByName(far).where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = lambda table: sorted(map(tuple, vectors.batch_top_k(table, queries, 3).collect()))
    assert sorted(map(tuple, vector_store.search(path, queries, 3, 1)[0].collect())) == exact(rows.unionByName(far))
    spark.read.parquet(f"{path}/vectors/batch=2").write.partitionBy("cid").parquet(f"{path}/vectors/batch=3")  # a writer that died
    assert vector_store.live(spark, path).count() == 202
    vector_store.delete(far.select("document_id"), path)
    assert sorted(map(tuple, vector_store.search(path, queries, 3, 1)[0].collect())) == exact(rows)
    vector_store.insert(far.where("vec_id = 1000"), path)
    assert sorted(map(tuple, vector_store.search(path, queries, 3, 1)[0].collect())) == exact(rows.unionByName(far.where("vec_id = 1000")))


@pytest.mark.parametrize("shard", [300, 4096])
def test_graph_search(spark, tmp_path, shard):
    """Recall over all queries of the small table, in one shard or several, and fewer vectors looked at than a scan needs."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = f"file://{tmp_path}/graphs"
    hnsw.build(rows.coalesce(1), path, shard)
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits, looked = hnsw.search(spark, path, queries, 10)
    found, exact = {(r.query_id, r.vec_id): r.score for r in hits.collect()}, vectors.batch_top_k(rows, queries, 10).collect()
    assert len(found) == 200 and sum((r.query_id, r.vec_id) in found for r in exact) >= 180
    assert all(found[r.query_id, r.vec_id] == pytest.approx(r.score, abs=2e-6) for r in exact if (r.query_id, r.vec_id) in found)
    looks = [r.looked for r in looked.collect()]
    # Small shards are looked through nearly whole, and their entries in every layer.
    assert len(looks) == 20 and (max(looks) < 2100 if shard == 300 else sum(looks) < 0.7 * 20 * 2000)


def test_graph_structure():
    """Layers thin out, links stay within bounds and reach every node of a layer from its first."""
    draw = np.random.default_rng(1)
    units = vectors._unit(draw.normal(size=(500, 8))).astype(np.float32)
    layers = hnsw.graph(np.arange(500), units, 6)
    sizes = [len(layer["nodes"]) for layer in layers]
    assert sizes[0] == 500 and all(a > b for a, b in zip(sizes, sizes[1:])) and len(sizes) >= 2
    for height, layer in enumerate(layers):
        degrees = np.diff(layer["starts"])
        assert degrees.max() <= (24 if height == 0 else 12) and set(layer["links"]) <= set(layer["nodes"])
        place, reached, waiting = {n: i for i, n in enumerate(layer["nodes"])}, set(), [layer["nodes"][0]]
        while waiting:
            node = waiting.pop()
            if node not in reached:
                reached.add(node)
                waiting += layer["links"][layer["starts"][place[node]] : layer["starts"][place[node] + 1]]
        assert len(reached) >= 0.98 * sizes[height]


def test_graph_odd(spark, tmp_path):
    rows = [(0, None), (1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [3.0, 4.0])]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = f"file://{tmp_path}/graphs"
    hnsw.build(rows, path, 2)
    found = hnsw.search(spark, path, rows.where("vec_id in (2, 5)").select(F.col("vec_id").alias("query_id"), "embedding"), 5)[0].collect()
    assert {(r.query_id, r.vec_id, r.score) for r in found} == {(2, 1, 0.96), (2, 5, 0.0), (5, 1, 0.0), (5, 2, 0.0)}
    hnsw.build(rows.limit(0), f"{path}-none")
    assert hnsw.search(spark, f"{path}-none", rows.select(F.col("vec_id").alias("query_id"), "embedding"), 5)[0].count() == 0


def test_trim(spark):
    talk = [(c, t, "system" if t == 0 and c != 3 else "user", str(t)) for c, n in ((1, 11), (2, 12), (3, 12)) for t in range(n)]
    rows = conversation.trim(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    kept = {r.conv_id: r.t for r in rows.collect()}
    assert kept == {1: list(range(11)), 2: [0, *range(2, 12)], 3: list(range(2, 12))}


def test_recency_edges(spark):
    now = datetime.datetime(2024, 2, 1)
    rows = spark.createDataFrame([(d, now - datetime.timedelta(days=d)) for d in (0, 1, 2, 6, 7, 29, 30, -1)], "d int, ts timestamp")
    found = {r.d: r.g for r in rows.select("d", T.recency(F.col("ts"), F.lit(now)).alias("g")).collect()}
    assert found == {0: "today", 1: "yesterday", 2: "last7", 6: "last7", 7: "last30", 29: "last30", 30: "older", -1: "last7"}


def test_text_functions(spark):
    row = spark.range(1).select(
        T.strip(F.lit(" \n a b　")).alias("strip"), T.ellipsis(F.lit("x" * 50), 50).alias("short"), T.ellipsis(F.lit("x" * 51), 50).alias("long"), T.snippet(F.lit("a")).alias("snippet"),
        T.file_size(F.lit(1536).cast("long")).alias("size"), T.file_size(F.lit(0).cast("long")).alias("none"), T.file_size(F.lit(100 << 20).cast("long")).alias("big"), T.suffix(F.lit("a/b.c/D.PDF")).alias("suffix"),
    ).first()
    assert tuple(row) == ("a b", "x" * 50, "x" * 50 + "...", "a...", "1.5 KB", "0 Bytes", "100 MB", ".pdf")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "b.MD").write_text("# head", encoding="utf-8")
    (tmp_path / "c.bin").write_text("x", encoding="utf-8")
    rows = {r.source: (r.content, r.file_type) for r in files.read_text(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("one\ntwo", "txt"), "b.MD": ("# head", "md")}
    checks = spark.createDataFrame([("a.pdf", 50_000_000), ("a.pdf", 50_000_001), ("a.docx", 1)], "path string, size long")
    assert [r.r for r in checks.select(files.reject_reason(F.col("path"), F.col("size")).alias("r")).collect()] == [None, "too_large", "unsupported"]


def test_events_round_trip(spark):
    rows = spark.createDataFrame([("1", 'says "hi" \\ and\nmore 中文')], "conversation_id string, content string")
    found = answer.events(rows, rows.limit(0).select("conversation_id", F.struct("content").alias("citation"))).withColumn("frame", answer.frame(F.col("type"), F.col("data")))
    streams = answer.in_order(found, ["conversation_id"], "seq", "frame", "", "stream").select(F.lit(1).alias("conv_id"), "stream")
    assert answer.decode(streams).first().text == 'says "hi" \\ and\nmore 中文'


def test_catalog(spark):
    log = spark.createDataFrame([(1, 1, "pending"), (1, 2, "failed"), (2, 1, "pending")], "id long, at int, status string")
    assert {r.id: r.status for r in catalog.latest(log, "id", "at").collect()} == {1: "failed", 2: "pending"}
    titled = spark.createDataFrame([(1, "50% off", None), (2, None, "500 off")], "conv_id long, title string, last_message string")
    assert [r.conv_id for r in catalog.search_conversations(titled, "0% O").collect()] == [1]


def test_search_tool(spark, tmp_path):
    chunks = spark.createDataFrame([(i, 0, t, f"file{i}.txt", i + 1) for i, t in enumerate(TEXTS)], "document_id long, chunk_index int, content string, source string, page_number int")
    path = f"file://{tmp_path}/knowledge"
    tool.ingest(chunks.where("document_id < 2"), path)
    tool.ingest(chunks.where("document_id >= 2"), path)
    text = tool.search_knowledge_base(spark, path, "events fast", top_k=2, threshold=0.1)
    # The vector leg's only hit is also its lowest, so its normalised score is 0; the keyword leg has chunks of score 0 besides.
    assert text == "[文档 1] file1.txt - 第 2 页 (相关度: 0.40)\nspark streams events fast\n\n[文档 2] file0.txt - 第 1 页 (相关度: 0.00)\nspark runs sql"
    assert tool.search_knowledge_base(spark, path, "events fast", document_ids=[9], threshold=0.9) == answer.NOTHING_FOUND
    for query, k in (("", 5), ("x", 0), ("x", 21)):
        with pytest.raises(ValueError):
            tool.search_knowledge_base(spark, path, query, k)


def test_search_agrees_with_all_pairs(spark, index):
    """The scan keeps what scoring every pair gives, zero rows too, in blocks of queries as in one."""
    queries = spark.createDataFrame([(q, t) for q, t in enumerate(["spark vector", "vector vector", "", "sql fast engine", "nothing here"])] + [(9, None)], "query_id long, text string")
    for size in (1 << 20, 8):
        found = {(r.query_id, r.rank): (r.document_id, r.bm25_score) for r in bm25.search(index, queries, 3, query_bytes=size).collect()}
        assert len(found) == 18 and found[0, 1] == (0, 0.153594) and found[0, 2] == (3, 0.153594) and found[0, 3] == (1, 0.134328)
        assert [found[9, k] for k in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    pairs = {(r.query_id, r.document_id): round(r.bm25_score, 6) for r in bm25.scores(index, queries).collect()}
    assert all(pairs.get((q, d), 0.0) == s for (q, _), (d, s) in found.items())
    scope = spark.createDataFrame([(1,), (2,), (2,)], "document_id long")
    assert {(r.query_id, r.document_id) for r in bm25.search(index, queries, 3, scope).collect()} == {(q, d) for q in (0, 1, 2, 3, 4, 9) for d in (1, 2)}


def test_vectors_that_do_not_fit(spark):
    """Null, ragged and not-a-number embeddings are no hits and crash nothing."""
    rows = [(0, None), (1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0])]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    found = {(r.query_id, r.vec_id) for r in vectors.batch_top_k(rows, queries, 5).collect()}
    assert found == {(1, 2), (2, 1)}
    assert vectors.batch_top_k(rows.limit(0), queries, 5).count() == 0 and vectors.batch_top_k(rows, queries.limit(0), 5).count() == 0


def test_embedders(spark):
    with pytest.raises(ValueError, match="unknown embedding provider"):
        vectors.embedder("nobody")
    assert vectors.dimension(spark, "hashing", 16) == 16
    rows = vectors.embed(spark.createDataFrame([("a b a",), ("",), (None,)], "content string"), 8).collect()
    assert sorted(x for x in rows[0].embedding if x) == pytest.approx([5**-0.5, 2 * 5**-0.5]) and rows[1].embedding == rows[2].embedding == [0.0] * 8


def test_vector_store(spark, tmp_path):
    draw = random.Random(8)
    rows = [(i, i % 5, [draw.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, document_id int, embedding array<double>")
    path = f"file://{tmp_path}/vectors"
    vector_store.create(table.where("vec_id < 120"), path, 4)
    vector_store.insert(table.where("vec_id >= 120 and vec_id < 180"), path)
    vector_store.delete(table.where("document_id = 2").select("document_id"), path)
    vector_store.insert(table.where("vec_id >= 180"), path)  # what comes after a delete lives
    left = {i for i, d, _ in rows if d != 2 or i >= 180}
    assert {r.vec_id for r in vector_store.live(spark, path).collect()} == left
    queries = table.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_store.search(path, queries, 4, 1)[0]
    expected = vectors.batch_top_k(table.where(F.col("vec_id").isin(*left)), queries, 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    vector_store.compact(spark, path, f"file://{tmp_path}/compacted")
    assert {r.vec_id for r in vector_store.live(spark, f"file://{tmp_path}/compacted").collect()} == left


def test_hits_without_source(spark):
    """A hit whose source is null is shown as of an unknown source in all texts."""
    rows = spark.createDataFrame([(0, 1, 5, 0, 0.5, "one", None, None), (0, 2, 6, 0, 0.25, "two", "b.txt", 3)], "query_id long, rank int, document_id long, chunk_index int, score double, content string, source string, page_number int")
    assert answer.context(rows).first().context == "[来源 1: Unknown - 第 N/A 页]\none\n\n[来源 2: b.txt - 第 3 页]\ntwo"
    assert answer.tool_text(rows).first().text == "[文档 1] Unknown - 第 N/A 页 (相关度: 0.50)\none\n\n[文档 2] b.txt - 第 3 页 (相关度: 0.25)\ntwo"
    assert [r.document_name for r in answer.citations(rows).orderBy("rank").collect()] == ["Unknown", "b.txt"]


def test_rerank(spark):
    rows = spark.createDataFrame([(0, d, 0, t) for d, t in enumerate(TEXTS)], "query_id long, document_id long, chunk_index int, content string")
    queries = spark.createDataFrame([(0, "vector spark events")], "query_id long, text string")
    found = fusion.reranked(rows, queries, fusion.overlap, 3).orderBy("rank").collect()
    assert [(r.document_id, r.rerank_score) for r in found] == [(1, 0.666667), (3, 0.666667), (0, 0.333333)]


def test_tool_call(spark, tmp_path):
    """As a model calls it, errors are texts."""
    chunks = spark.createDataFrame([(i, 0, t, "f", 1) for i, t in enumerate(TEXTS)], "document_id long, chunk_index int, content string, source string, page_number int")
    path = f"file://{tmp_path}/knowledge"
    tool.ingest(chunks, path)
    assert tool.call(spark, path, "", 5) == answer.FAILED + "the query is empty"
    assert tool.call(spark, path, "x", 21) == answer.FAILED + "top_k must be 1 to 20"
    assert tool.call(spark, path, "events fast", 2, threshold=0.1).startswith("[文档 1] f")
    rows = vectors.embed(bm25.count_tokens(chunks), tool.DIM)
    tool.register(spark, rows, bm25.index_of(rows), name="kb_few")
    found = spark.sql("SELECT * FROM kb_few('spark vector', 2)").collect()
    assert [(r.rank, r.document_id) for r in found] == [(1, 0), (2, 3)] or len(found) == 2
    for query, k in (("x", 21), (" ", 5)):
        with pytest.raises(Exception, match="top_k must be|the query is empty"):
            spark.sql(f"SELECT * FROM kb_few('{query}', {k})").collect()


def test_uuid(spark):
    values = ["123e4567-e89b-12d3-a456-426614174000", "123E4567E89B12D3A456426614174000", "{123e4567-e89b-12d3-a456-426614174000}", "urn:uuid:123e4567-e89b-12d3-a456-426614174000", "123e4567", "", None, "g23e4567-e89b-12d3-a456-426614174000"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", T.is_uuid(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [True] * 4 + [False] * 4


def test_pdf_pages(spark, tmp_path):
    """Pages with text become segments with their numbers; a stand-in for the optional reader splits at form feeds."""
    stub = tmp_path / "pypdf.py"
    stub.write_text(
        "class Page:\n    def __init__(self, t): self.t = t\n    def extract_text(self): return self.t or None\n"
        "class PdfReader:\n    def __init__(self, f): self.pages = [Page(t) for t in f.read().decode().split(chr(12))]\n", encoding="utf-8"
    )
    spark.sparkContext.addPyFile(str(stub))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_text("first\x0c \n\x0cthird", encoding="utf-8")
    (folder / "b.txt").write_text("no pdf", encoding="utf-8")
    rows = files.read_pdf(spark, str(folder)).orderBy("page_number").collect()
    assert [(r.source, r["index"], r.page_number, r.content, r.total_pages, r.file_type) for r in rows] == [("a.pdf", 0, 1, "first", 3, "pdf"), ("a.pdf", 2, 3, "third", 3, "pdf")]


def test_index_stream(spark, tmp_path):
    """Documents that come in two runs are each indexed once; a failed one has its reason; a batch that runs again repeats nothing."""
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    schema = "document_id string, path string, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    put([("a", "a.txt", "spark runs sql"), ("b", "b.docx", "no"), ("c", "c.md", "")])
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    ingest.index_stream(spark, stream(), target, f"file://{tmp_path}/state", 8).awaitTermination()
    put([("d", "d.txt", "vector search engine")])
    for _ in range(2):
        ingest.index_stream(spark, stream(), target, f"file://{tmp_path}/state", 8).awaitTermination()
    ingest.index_batch(spark.createDataFrame([("d", "d.txt", "vector search engine")], schema), target, 1, 8, ingest.default_split())
    chunks, index, status = ingest.index(spark, target)
    assert sorted((r.document_id, r.content) for r in chunks.collect()) == [("a", "spark runs sql"), ("d", "vector search engine")]
    assert {r.document_id: (r.status, r.progress, r.chunk_count, r.error_message) for r in status.collect()} == {
        "a": ("completed", 100, 1, None), "b": ("failed", 0, 0, "unsupported file type: .docx"), "c": ("completed", 100, 0, None), "d": ("completed", 100, 1, None),
    }
    found = bm25.search(index, spark.createDataFrame([(0, "engine")], "query_id long, text string"), 5).collect()
    assert {(r.document_id, r.bm25_score) for r in found} == {("a", 0.0), ("d", 0.0)}  # a token of half the chunks weighs nothing


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT kb_windows('abcdefgh', 5, 2) AS w, kb_cosine(array(3D, 4D), array(4D, 3D)) AS c, kb_cosine(array(0D), array(1D)) AS z, kb_strip(' a ') AS s, kb_suffix('x/y.MD') AS f, kb_tokens('A b!') AS t").first()
    assert (row.w, round(row.c, 6), row.z, row.s, row.f, row.t) == (["abcde", "defgh"], 0.96, None, "a", ".md", ["a", "b"])


def test_repeated_ingest_counts_once(spark):
    rows = spark.createDataFrame([("d1", "h1"), ("d1", "h1"), ("d2", "h1"), ("d3", "h2")], "document_id string, content_hash string")
    assert sorted(map(tuple, ingest.first_of_each(rows).collect())) == [("d1", "h1"), ("d2", "h1"), ("d3", "h2")]


def test_replayed_documents(spark, tmp_path):
    """Batches that come again, late or after a restart, add nothing; equal texts of two documents both stay; after the delay a text may come again."""
    schema = "document_id string, content_hash string, arrived timestamp"
    at = lambda hour: datetime.datetime(2024, 1, 1, hour)

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "arrived", "3 hours")
        out = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("document_id", "content_hash").collect()))

    first = [("d1", "h", at(1)), ("d2", "h", at(1))]
    assert run(*first) == [("d1", "h"), ("d2", "h")]
    assert run(*first, ("d3", "g", at(3))) == [("d1", "h"), ("d2", "h"), ("d3", "g")]
    assert run(("d1", "h", at(2)), ("d4", "k", at(12))) == [("d1", "h"), ("d2", "h"), ("d3", "g"), ("d4", "k")]
    assert run(("d1", "h", at(12))) == [("d1", "h"), ("d1", "h"), ("d2", "h"), ("d3", "g"), ("d4", "k")]


def as_built(rows, queries, k, scope=None):
    return sorted(map(tuple, bm25.search(bm25.build(rows), queries, k, scope).collect()))


def test_segments(spark, tmp_path):
    """Inserts, deletes, merges and documents that come back: every search is as of an index of the living chunks."""
    draw = random.Random(6)
    text = lambda: " ".join(draw.choice(["spark", "vector", "index", *[f"w{i}" for i in range(60)]]) for _ in range(draw.randrange(0, 30)))
    rows = [(d, c, text() or None) for d in range(60) for c in range(draw.randrange(1, 4))]
    table = spark.createDataFrame(rows, "document_id long, chunk_index int, content string")
    queries = spark.createDataFrame([(0, "spark vector"), (1, "w1 w2 w3 w3"), (2, ""), (3, None), (4, "absent"), (5, "w9")], "query_id long, text string")
    path, some = f"file://{tmp_path}/index", lambda *ids: table.where(F.col("document_id").isin(*ids))
    found = lambda k=7, scope=None: sorted(map(tuple, segments.search(path, queries, k, scope).collect()))
    counted = bm25.count_tokens(table)
    segments.add(counted.where("document_id < 20"), path)
    assert found() == as_built(table.where("document_id < 20"), queries, 7)
    segments.add(counted.where("document_id >= 20"), path)
    assert found() == as_built(table, queries, 7)
    for size in (10, 1 << 20):
        assert sorted(map(tuple, segments.search(path, queries, 3, query_bytes=size).collect())) == as_built(table, queries, 3)
    scope = spark.createDataFrame([(3,), (31,), (31,)], "document_id long")
    assert found(4, scope) == as_built(table, queries, 4, scope)
    gone = spark.createDataFrame([(3,), (40,), (41,), (777,)], "document_id long")
    segments.delete(gone, path)
    left = table.where("document_id not in (3, 40, 41)")
    assert found() == as_built(left, queries, 7) and found(4, scope) == as_built(left, queries, 4, scope)
    segments.add(bm25.count_tokens(some(40)), path)
    left = table.where("document_id not in (3, 41)")
    assert found() == as_built(left, queries, 7)
    before = snapshots.read(spark, path)
    segments.merge(spark, path)
    after = snapshots.read(spark, path)
    assert found() == as_built(left, queries, 7) and len(after.folders("postings")) == 1 < len(before.folders("postings"))
    idf = lambda index: {r.tok: round(r.idf, 9) for r in index.idf.collect()}
    assert idf(segments.index(spark, path)) == idf(bm25.build(left)) == idf(segments.index(spark, path, version=before.version))
    assert sorted(map(tuple, segments.search(path, queries, 7, version=1).collect())) == as_built(table, queries, 7)  # an older version stays


def test_segments_touch_their_batch_only(spark, tmp_path):
    """What is stored stays as it is when a batch is added; a batch that comes again is not added; a writer that dies leaves no trace."""
    path = f"file://{tmp_path}/index"
    rows = bm25.count_tokens(spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "document_id long, chunk_index int, content string"))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*") if p.is_file()}
    segments.add(rows.where("document_id < 2"), path, 0)
    old = files()
    segments.add(rows.where("document_id >= 2"), path, 1)
    assert old.items() <= files().items()
    now = segments.add(rows, path, 1)
    assert now.version == 1 and segments.chunks(spark, path).count() == 4 and segments.of_batch(spark, path, 1).count() == 2
    segments._write_segment(rows, path, 9)  # not committed
    assert segments.chunks(spark, path).count() == 4
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, now)
    with pytest.raises(ValueError, match="no version"):
        snapshots.read(spark, path, 7)


def test_segments_read_asked_buckets(spark, tmp_path, monkeypatch):
    """A search for two words reads the folders of these words' buckets, and pushes the words to the scan."""
    path = f"file://{tmp_path}/index"
    texts = [(i, 0, f"word{i % 50} other{i % 7} common{i % 3}") for i in range(400)]
    segments.add(bm25.count_tokens(spark.createDataFrame(texts, "document_id long, chunk_index int, content string")), path)
    plans = []
    monkeypatch.setattr(segments, "written", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, path))
    found = segments.search(path, spark.createDataFrame([(0, "word7 other3")], "query_id long, text string"), 5).collect()
    assert len(found) == 5 and found[0].bm25_score > 0
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan" in line and "docs#" in line]
    assert scans and all("bucket" in line.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "word7" in line.split("PushedFilters: [")[1] for line in scans)


def test_thread_history(spark, tmp_path):
    """Four starts of a stream: what comes again makes no checkpoint, an edited turn is a new version, older states stay readable."""
    schema = "conv_id long, turn long, role string, text string"
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        out = threads.with_history(spark.readStream.schema(schema).parquet(source), 2).writeStream.format("parquet")
        out.option("path", f"{tmp_path}/out").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run((1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x"))
    run((1, 2, "user", "c"), (2, 0, "user", "x"))
    run((1, 0, "user", "a"), (1, 1, "assistant", "B"))
    run((2, 1, "assistant", None), (1, 2, "user", "c"))
    rows = {(r.conv_id, r.checkpoint_id): (r.parent_id, r.n_messages, r.turns, r.texts) for r in spark.read.schema(threads.HISTORY).parquet(f"{tmp_path}/out").collect()}
    assert rows == {
        (1, 1): (None, 2, [0, 1], ["a", "b"]), (2, 1): (None, 1, [0], ["x"]), (1, 2): (1, 3, [1, 2], ["b", "c"]),
        (1, 3): (2, 3, [1, 2], ["B", "c"]), (2, 2): (1, 2, [0, 1], ["x", None]),
    }
    known = threads.checkpoints(spark, state)
    assert {tuple(r) for r in known.collect()} == {(k[0], k[1], v[0], v[1]) for k, v in rows.items()}
    found = {}
    for r in threads.state_at(spark, state, known).collect():
        found.setdefault((r.conv_id, r.checkpoint_id), {})[r.turn] = r.text
    assert found == {(1, 1): {0: "a", 1: "b"}, (1, 2): {0: "a", 1: "b", 2: "c"}, (1, 3): {0: "a", 1: "B", 2: "c"}, (2, 1): {0: "x"}, (2, 2): {0: "x", 1: None}}


def test_thread_state_over_batches(spark, tmp_path):
    """The newest messages after each of three starts: the state of the earlier ones is read back."""
    schema, newest = "conv_id long, turn long, text string", {}
    for batch in range(3):
        spark.createDataFrame([(c, 2 * batch + t, f"{c}-{2 * batch + t}") for c in range(batch, 4) for t in range(2)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = threads.last_messages(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3)
        put = lambda rows, _: newest.update({r.conv_id: (r.n_messages, r.texts) for r in rows.collect()})
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert newest == {0: (2, ["0-0", "0-1"]), 1: (4, ["1-1", "1-2", "1-3"]), 2: (6, ["2-3", "2-4", "2-5"]), 3: (6, ["3-3", "3-4", "3-5"])}


def test_trigram_search(spark, tmp_path):
    """Any pattern finds what a scan finds; long ones compare few rows."""
    draw = random.Random(9)
    texts = ["50% off", "500 off", "a_b", "axb", "ÄÖÜ ß end", None, "", "aaa", "aaaa", *["".join(draw.choice("ab _%c") for _ in range(draw.randrange(0, 15))) for _ in range(300)]]
    rows = spark.createDataFrame([(i, t, texts[-i - 1]) for i, t in enumerate(texts)], "conv_id long, title string, last_message string")
    path = f"file://{tmp_path}/trigrams"
    trigrams.build(rows, path, "conv_id", "title", "last_message")
    patterns = ["0% O", "a_b", "aaa", "äöü", "b", "", "_%", "none such", "ab a", None, "C%", *[t[2:8] for t in texts[9:40]]]
    table = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    found = sorted(map(tuple, trigrams.search(spark, path, table, "conv_id", "title", "last_message").collect()))
    expected = [(i, r.conv_id) for i, p in enumerate(patterns) if p is not None for r in rows.collect() if any(t is not None and p.lower() in t.lower() for t in (r.title, r.last_message))]
    assert found == sorted(expected)
    assert trigrams.candidates(spark, path, table.where("pattern = '0% O'")).count() < 5


def test_posted_conversations(spark, tmp_path):
    path, at = f"file://{tmp_path}/talk", lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    make = lambda *rows: spark.createDataFrame(list(rows), "conv_id long, turn long, role string, text string, created_at timestamp")
    conversation.post(make((1, 0, "user", "x" * 60, at(0)), (2, 0, "user", None, at(1))), path, "a")
    conversation.post(make((1, 1, "assistant", "hi", at(5))), path, "b")
    conversation.post(make((1, 1, "assistant", "hi", at(5))), path, "b")  # again
    rows = {r.conv_id: tuple(r)[1:] for r in conversation.listed(spark, path).collect()}
    assert rows == {1: ("x" * 50 + "...", 2, at(0), at(5)), 2: (None, 1, at(1), at(1))}
    conversation.remove(spark.createDataFrame([(1,)], "conv_id long"), path)
    assert [r.conv_id for r in conversation.listed(spark, path).collect()] == [2]
    assert conversation.messages(spark, path, version=1).count() == 3  # older versions stay


def test_shards_are_never_larger_than_stated(spark, tmp_path):
    """Tasks of many Arrow batches cut shards of the stated size, and every chunk in them is found."""
    rows = bm25.count_tokens(spark.range(25_000).selectExpr("id AS document_id", "0 AS chunk_index", "concat_ws(' ', 'all', 'w' || id % 5000) AS content"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        segments.add(rows, path := f"file://{tmp_path}/index")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    postings = snapshots.table(spark, path, snapshots.read(spark, path), "postings")
    assert sorted(r[0] for r in postings.where("bucket = -1").select(F.size("ids")).collect()) == [25_000 - 3 * segments.SHARD, *[segments.SHARD] * 3]
    queries = spark.createDataFrame([(i, f"w{i}") for i in (17, 4321)], "query_id long, text string")
    found = segments.search(path, queries, 5).collect()
    assert {(r.query_id, r.document_id) for r in found} == {(i, i + 5000 * n) for i in (17, 4321) for n in range(5)} and all(r.bm25_score > 0 for r in found)


@pytest.mark.parametrize("name", ["ingest_status", "stream_ingest", "thread_state_stream"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    """A table that is a folder of files gives the rows of the same table as one file."""
    from lectern.plans.registry import QUERIES

    for table in ("documents", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{table}.parquet")
    one, many = (sorted(map(repr, QUERIES[name](spark, folder).collect())) for folder in ("/root/testdata/sf0.001", f"file://{tmp_path}"))
    assert one == many and one


def test_short_patterns_make_no_candidates(spark, tmp_path, monkeypatch):
    """Patterns of up to eight characters are met by runs of their own length; the rows are those of comparing all, at any length."""
    draw = random.Random(5)
    some = lambda n: "".join(draw.choice("abAB é%") for _ in range(n))
    texts = [(i, None if i % 11 == 0 else some(draw.randrange(40)), some(draw.randrange(60))) for i in range(200)] + [(900, None, None)]
    rows = spark.createDataFrame(texts, "conv_id long, title string, last_message string")
    trigrams.build(rows, path := f"file://{tmp_path}/trigrams", "conv_id", "title", "last_message")
    patterns = ["", None, *{some(n) for n in range(1, 12) for _ in range(6)}]
    table = spark.createDataFrame([(f"{i}", p) for i, p in enumerate(patterns)], "pattern_id string, pattern string")
    found = sorted((r.pattern_id, r.conv_id) for r in trigrams.search(spark, path, table, "conv_id", "title", "last_message").collect())
    assert found == sorted((f"{i}", k) for i, p in enumerate(patterns) if p is not None for k, *own in texts if any(t is not None and p.lower() in t.lower() for t in own))
    asked, before = [], trigrams.candidates
    monkeypatch.setattr(trigrams, "candidates", lambda spark, path, patterns: asked.extend(patterns.collect()) or before(spark, path, patterns))
    trigrams.search(spark, path, table, "conv_id", "title", "last_message")
    assert asked and all(len(r.pattern) > trigrams.PIECES for r in asked)


def test_token_stats_make_no_occurrences(spark):
    from lectern.plans.registry import QUERIES

    assert "Generate explode" not in QUERIES["token_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_chunks_are_counted_once(spark, tmp_path):
    """Sorting chunks into a segment reads them twice; what ``prepare`` adds is made once for each."""
    counted = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def one(x):
        counted.add(1)
        return x

    rows = spark.range(100).selectExpr("id AS document_id", "0 AS chunk_index", "'w' || id AS content")
    segments.add(rows, f"file://{tmp_path}/index", prepare=lambda rows: bm25.count_tokens(rows.withColumn("x", one("chunk_index"))))
    assert counted.value == 100


def test_replay_makes_two_batches(spark, tmp_path):
    """However many files an arrival has, it is one batch."""
    from lectern.plans import talk_queries

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(9).write.parquet(f"file://{tmp_path}/documents.parquet")
    made, before = [], talk_queries.scratch
    talk_queries.scratch = lambda *given: made.append(before(*given)) or made[-1]
    try:
        rows = talk_queries.replayed_stream(spark, f"file://{tmp_path}")
    finally:
        talk_queries.scratch = before
    logs = spark.read.text(f"{made[0]}/state/sources/0").where("value like '{%'")  # a line for each file, with the batch that read it
    assert logs.selectExpr("get_json_object(value, '$.batchId') AS batch").distinct().count() == 2
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_history_asks_the_state_for_earlier_turns_only():
    """Turns above the newest cost no lookup; earlier ones, and those that come twice in a batch, are told apart as before."""
    import pandas as pd

    class State(dict):
        asked = 0

        def get(self):
            return self.value if hasattr(self, "value") else None

        def update(self, value):
            self.value = value

        def exists(self):
            return hasattr(self, "value")

        def containsKey(self, key):
            self.asked += 1
            return key in self

        def getValue(self, key):
            self.asked += 1
            return dict.get(self, key)

        def updateValue(self, key, value):
            self[key] = value

    history = threads._History(2, None)
    history.messages, history.checkpoints, history.known, history.newest = State(), State(), State(), State()
    give = lambda *rows: [f.iloc[0].to_dict() for f in history.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["turn", "role", "text"])]), None)]
    assert give((1, "u", "a"), (2, "a", "b"), (2, "a", "b"))[0]["n_messages"] == 2 and history.known.asked == 0
    assert give((3, "u", "c"))[0]["turns"] == [2, 3] and history.known.asked == 0
    assert give((1, "u", "a"), (3, "u", "c")) == [] and history.known.asked == 2
    assert give((3, "u", "new"), (1, "u", "a"))[0]["texts"] == ["b", "new"] and history.newest.value[1] == 3


def test_normalizing_takes_time_in_proportion_to_the_elements(spark, tmp_path):
    """As many elements in long vectors take about as long as in short ones."""
    took = []
    for n, dim in ((4096, 64), (4096, 64), (64, 4096)):  # the first run compiles
        rows = spark.range(n).select(F.expr(f"transform(sequence(1, {dim}), x -> cast((x * 7 + id) % 13 - 6 as float))").alias("embedding"))
        rows = written(rows, f"file://{tmp_path}/{len(took)}")
        began = time.monotonic()
        unit = rows.select(vectors.normalize(F.col("embedding")).alias("unit"))
        assert unit.agg(F.max(F.abs(vectors.norm(F.col("unit")) - 1)) < 1e-9).first()[0]
        took.append(time.monotonic() - began)
    assert took[2] < 4 * took[1] + 2
    odd = spark.createDataFrame([(0, None), (1, []), (2, [0.0, 0.0]), (3, [3.0, -4.0]), (4, [1.0, None])], "id long, v array<float>")
    assert [r[0] for r in odd.orderBy("id").select(vectors.normalize(F.col("v"))).collect()] == [None, [], [0.0, 0.0], [0.6, -0.8], [None, None]]


def test_runs_of_texts_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Patterns whose estimated size is above that of the texts are the side that is broadcast, or no side is; the rows are the same."""
    rows = spark.range(300).selectExpr("id AS conv_id", "concat('t', id % 7, 'x') AS title", "concat('last ', id) AS last_message")
    trigrams.build(rows, path := f"file://{tmp_path}/trigrams", "conv_id", "title", "last_message")
    patterns = spark.range(2_000_000).selectExpr("concat('T', id % 9) AS pattern").distinct().selectExpr("pattern AS pattern_id", "pattern")

    def sent(df):
        """The lines of the plan below each broadcast."""
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        return [" ".join(lines[i : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]) for i, line in enumerate(lines) if "BroadcastExchange" in line]

    expected = sorted((f"T{i % 7}", i) for i in range(300))
    for few in (None, 5):
        if few:
            monkeypatch.setattr(trigrams, "FEW", few)
        found = trigrams.search(spark, path, patterns, "conv_id", "title", "last_message")
        assert not any("Generate" in below for below in sent(found))
        assert sorted(map(tuple, found.collect())) == expected
