"""Block-max search, resampling and nearest neighbours against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lectern.llm import block_search, kmeans_tree, resampling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, k):
    texts = [(r.doc_id, Counter(TERM.findall(lower(r.text)))) for r in docs]
    texts = [(d, c, sum(c.values())) for d, c in texts if c]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df, asked, found = Counter(t for _, c, _ in texts for t in c), {}, []
    for r in items:
        asked.setdefault(r.item_id, Counter()).update(TERM.findall(lower(r.text)))
    for item, wanted in asked.items():
        scores = []
        for d, c, n in texts:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in wanted.items() if t in c)
            scores += [(-score, d is None, d or 0)] * (score > 0)
        found += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(found)


def test_op13(spark, small_docs):
    """All of the small tables, in one shard and in many, with queries in one block and in many."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute_search(small_docs.collect(), items.collect(), 20)
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    assert Counter(map(tuple, block_search.search(small_docs, items, counts=counts).collect())) == expected
    assert 0 < counts[0].value <= counts[1].value
    assert Counter(map(tuple, block_search.search(small_docs, items, shard_bytes=20_000, query_bytes=2_000).collect())) == expected
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    rows = connection.execute(block_search.OP13_SQL).df()[["item_id", "rank", "doc_id", "score"]]
    assert Counter(map(tuple, rows.values.tolist())) == expected


def test_op13_odd(spark, odd_docs, no_docs):
    items = [(1, "one two THREE"), (1, "four"), (2, None), (3, ""), (4, "!? ,"), (5, "same same row"), (None, "no id"), (6, "天气 ünïcode"), (7, "absent"), (8, "the quick brown fox " * 300)]
    items = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    for k in (2, 20):
        found = block_search.search(odd_docs, items, k).collect()
        assert Counter(map(tuple, found)) == brute_search(odd_docs.collect(), items.collect(), k)
    assert {r.item_id for r in found} == {1, 5, None, 6, 8}
    assert block_search.search(no_docs, items).count() == 0 and block_search.search(odd_docs, items.limit(0)).count() == 0


def test_op13_hot(spark):
    """Copies that hold most rows tie, and the smallest ids come first; a null id is last of its score."""
    rows = [(i if i != 3 else None, "alpha beta gamma") for i in range(3000)] + [(9000 + i, f"alpha word{i} " * (i % 7 + 1)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(0, "alpha beta"), (1, "word5 alpha")], "item_id long, text string")
    assert Counter(map(tuple, block_search.search(docs, items, 5, shard_bytes=10_000).collect())) == brute_search(docs.collect(), items.collect(), 5)


def test_op13_prunes(spark):
    """Blocks of other topics than the query's are left unread."""
    draw = np.random.default_rng(4)
    rows = [(i, " ".join([f"t{i % 40}" if x % 3 == 0 else f"t{i % 40}x{x}" for x in draw.integers(0, 30, 40)] + [f"c{x}" for x in draw.integers(0, 50, 20)])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    items = docs.where("doc_id < 20").selectExpr("doc_id AS item_id", "text")
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = block_search.search(docs, items, 10, counts=counts).collect()
    assert Counter(map(tuple, found)) == brute_search(docs.collect(), items.collect(), 10)
    assert counts[0].value < 0.3 * counts[1].value


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = WORD.findall(lower(text))
    return Counter(zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]), len(words)


def brute_resample(docs, target, share=25, least=20):
    source, wanted = Counter(), Counter()
    texts = [(r.doc_id, *brute_features(r.text)) for r in docs]
    for _, c, _ in texts:
        source.update(c)
    for r in target:
        wanted.update(brute_features(r.text)[0])
    n_source, n_wanted = sum(source.values()), sum(wanted.values())
    rows = []
    for d, c, words in texts:
        n = sum(c.values())
        gain = sum(k * math.floor(1000 * math.log((wanted[b] + 1) * (n_source + 10_000) / ((source[b] + 1) * (n_wanted + 10_000)))) for b, k in c.items())
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = gain // n if n else 0
        rows.append([d, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def test_op12(spark, small_docs):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute_resample(small_docs.collect(), target.collect())
    assert Counter(map(tuple, resampling.resample(small_docs, target).collect())) == expected
    assert Counter(map(tuple, resampling.resample(small_docs, target, limit=700).collect())) == expected  # texts in pieces
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    assert Counter(connection.execute(resampling.OP12_SQL).fetchall()) == expected


def test_op12_odd(spark, odd_docs, no_docs):
    target = odd_docs.where("doc_id in (1, 5, 8)")
    for limit in (30, 1 << 20):
        found = resampling.resample(odd_docs, target, 50, 2, limit=limit).collect()
        assert Counter(map(tuple, found)) == brute_resample(odd_docs.collect(), target.collect(), 50, 2)
    assert resampling.resample(no_docs, target).count() == 0
    assert Counter(map(tuple, resampling.resample(odd_docs, no_docs, 100, 1).collect())) == brute_resample(odd_docs.collect(), [], 100, 1)


def test_op12_hot(spark):
    """One text and one missing id hold most rows: ranks stay without gaps."""
    rows = [(None if i % 3 else i, "one text of a few words") for i in range(900)] + [(1000 + i, f"other words {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = resampling.resample(docs, docs.limit(3).selectExpr("text"), 80, 2).collect()
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 761)) and len(found) == 950
    assert Counter(map(tuple, found)) == Counter(map(tuple, resampling.resample(docs, docs.limit(3).selectExpr("text"), 80, 2).collect()))
    least = min(r.score for r in found if r.rank)
    assert all(r.score <= least for r in found if not r.rank)
    in_order = sorted((r for r in found if r.rank), key=lambda r: r.rank)
    assert all((-a.score, a.doc_id is None, a.doc_id or 0) <= (-b.score, b.doc_id is None, b.doc_id or 0) for a, b in zip(in_order, in_order[1:]))


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_op12_pieces(limit):
    """Cuts never part a word or lose a pair, and other scripts' letters are words."""
    texts = ["alpha beta", None, "", "  x  ", "ABC1déf,天气 gamma;" * 9, "no" * 30]
    import duckdb as engine

    connection = engine.connect(config={"threads": 1})
    connection.create_function("crc", resampling.crc, ["VARCHAR"], "BIGINT", type="arrow")
    starts, which, n = resampling.bucket_counts(texts, connection, limit=limit)
    for i, text in enumerate(texts):
        assert dict(zip(which[starts[i] : starts[i + 1]].tolist(), n[starts[i] : starts[i + 1]].tolist())) == brute_features(text)[0]


def brute_neighbours(rows, step=50, k=5):
    """(query_id, vec_id, score) of every usable query row, by exact ties."""
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and None not in v and len(v) == 4 and np.isfinite(v).all() and np.any(v)]
    found = []
    for at, (i, v) in enumerate(usable):
        if i is not None and i % step == 0:
            scores = [(-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 9), j is None, j or 0) for n, (j, w) in enumerate(usable) if n != at]
            found += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scores)[:k], 1)]
    return Counter(found)


def rounded(found):
    return Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_op11_recall(spark, folder):
    """Every query of the table, against brute force."""
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = kmeans_tree.neighbours(rows, counts=counts).collect()
    table = rows.orderBy("vec_id").toPandas()
    matrix = np.array(table["embedding"].tolist(), dtype=float)
    units, ids = matrix / np.linalg.norm(matrix, axis=1, keepdims=True), table["vec_id"].to_numpy()
    hits = 0
    for q in np.nonzero(ids % 50 == 0)[0]:
        near = units @ units[q]
        near[q] = -2
        mine = sorted((r for r in found if r.query_id == ids[q]), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and len({r.vec_id for r in mine}) == 5
        assert [r.score for r in mine] == pytest.approx([near[np.searchsorted(ids, r.vec_id)] for r in mine], abs=1e-12)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(mine, mine[1:]))
        hits += len({r.vec_id for r in mine} & set(ids[np.argsort(-near, kind="stable")[:5]].tolist()))
    assert len(found) == 5 * (ids % 50 == 0).sum() and hits / len(found) >= 0.9
    assert 0 < counts[0].value < counts[1].value


def test_op11_odd(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=4).round(1).tolist()) for i in range(1, 300)]
    rows += [(0, [1.0, 2.0, 0.0, 0.5]), (50, None), (100, [0.0] * 4), (150, [1.0, None, 2.0, 3.0]), (200, [1.0, float("nan"), 0.0, 0.0]), (250, [float("inf"), 1.0, 1.0, 1.0]), (300, [1.0, 2.0])]
    rows += [(None, [1.0, 2.0, 0.0, 0.5]), (350, [1.0, 2.0, -0.0, 0.5]), (350, [1.0, 2.0, 0.0, 0.5]), (350, [2.0, 4.0, 0.0, 1.0]), (400, [1e300, 2e300, 0.0, 5e299]), (450, [1e-300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1.0, 3) for r in rows], "vec_id long, embedding array<double>, score double, leaf int")
    expected = brute_neighbours([(i, None if v is None else [x * 1e-300 if i == 400 else x * 1e300 if i == 450 else x for x in v if x is not None] if v is not None and None not in v else None) for i, v in rows])
    for sizes in ({}, {"leaf": 4, "folder_bytes": 1000, "query_bytes": 100}):
        assert rounded(kmeans_tree.neighbours(frame.repartition(3), recall=1.0, **sizes)) == expected
    assert kmeans_tree.neighbours(frame.limit(0)).count() == 0 and kmeans_tree.neighbours(frame.where("vec_id = 300 or embedding is null")).count() == 0
    assert kmeans_tree.neighbours(frame.where("vec_id % 50 <> 0")).count() == 0
    few = frame.where("vec_id in (0, 7, 8)")
    assert rounded(kmeans_tree.neighbours(few)) == brute_neighbours([(r.vec_id, r.embedding) for r in few.collect()])  # all candidates, if fewer


def test_op11_hot(spark):
    """A vector that most rows share is one row of the index; each of its queries leaves out itself alone."""
    draw = np.random.default_rng(3)
    rows = [(i, [0.5, -0.25, 1.0, 0.125]) for i in range(0, 4000, 2)] + [(i, draw.normal(size=4).round(3).tolist()) for i in range(1, 1000, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    search = kmeans_tree.Search(frame, 5)
    assert search.index.count() == len({tuple(v) for _, v in rows})
    found = kmeans_tree.neighbours(frame).collect()
    for q in range(0, 4000, 50):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(0, 14, 2) if i != q][:5]


def test_op11_reads_few_folders(spark):
    """Where vectors cluster, blocks of queries leave most folders unread and most vectors unscored."""
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(40, 16))
    rows = spark.createDataFrame([(i, (centers[i % 40] + draw.normal(size=16) * 0.02).tolist()) for i in range(8000)], "vec_id long, embedding array<double>").repartition(4)
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = kmeans_tree.neighbours(rows, counts=counts, query_bytes=4000)
    assert found.count() == 800 and counts[0].value < 0.15 * 160 * 8000 and counts[1].value < 0.5 * 160 * 8000
