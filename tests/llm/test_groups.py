"""SimHash, ring sharding and mixing against brute force."""

import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import common, cuts, mixing, ring, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, ids, distance=2):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if bin(values[i] ^ values[j]).count("1") <= distance:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(values)):
        groups.setdefault(find(i), []).append(i)
    least = {k: min((ids[i] for i in g if ids[i] is not None), default=None) for k, g in groups.items()}
    return [least[find(i)] for i in range(len(values))]


def test_op4_odd(odd_docs, no_docs):
    short = odd_docs.withColumn("text", F.when(F.length("text") > 1000, F.substring("text", 1, 1000)).otherwise(F.col("text")))
    docs = short.collect()
    values = [brute_fingerprint(r.text) for r in docs]
    expected = Counter(zip([r.doc_id for r in docs], [f"{v:016x}" for v in values], brute_components(values, [r.doc_id for r in docs])))
    assert Counter(map(tuple, simhash.near_duplicates(short).collect())) == expected
    assert simhash.near_duplicates(no_docs).count() == 0


def test_op4_chain_and_ball(spark):
    """Chains link through steps of two bits; all fingerprints around one value meet."""
    chain = [0b11 << (2 * k) for k in range(6)]
    values = [sum(chain[:k]) for k in range(7)] + [1 << 40 | 1 << b for b in range(41, 60)] + [(1 << 63) | 7]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = {r.node: r.root for r in simhash.components(simhash.links(prints)).collect()}
    expected = brute_components(values, signed)
    assert [found.get(v, v) for v in signed] == expected


@pytest.mark.parametrize("distance", [2, 4])
def test_op4_random(spark, distance):
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 62, 40)
    values = sorted({int(v) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for v in base for a, b, c in random.integers(0, 63, (4, 3))} | {int(v) for v in base})
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {r.node: r.root for r in simhash.components(simhash.links(prints, distance)).collect()}
    assert [found.get(v, v) for v in values] == brute_components(values, values, distance)


def test_op4_whole_table(small_docs):
    docs = small_docs.collect()
    values = [brute_fingerprint(r.text) for r in docs]
    expected = dict(zip([r.doc_id for r in docs], brute_components(values, [r.doc_id for r in docs])))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(small_docs).collect()} == expected


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-3, 1, 4, 5, 6, 8, 9, 11, 12] and None in ids
    assert simhash.keep_one(no_docs).count() == 0


def test_budget_ends(spark):
    items = spark.createDataFrame([("a", h, 10) for h in (5, 5, 9, 1 << 59)] + [("b", 3, 7)], "grp string, h long, size long")
    budgets = spark.createDataFrame([("a", 25.0), ("b", 0.0), ("c", 4.0)], "grp string, budget double")
    assert {tuple(r) for r in cuts.budget_ends(items, budgets).collect()} == {("a", 9, 20, 10, 1), ("b", 3, 0, 7, 1)}


def brute_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), itertools.cycle((5, 2, 1))))
    left, open_, target = float(sum(sizes.values())), set(sizes), {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > 3 * sizes[s]}
        if not full:
            return target | {s: share * weights[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def test_op10_targets(spark):
    for sizes in ({"a": 10, "b": 10, "c": 1}, {"a": 1, "b": 2, "c": 3, "d": 400, None: 5}, {"x": 0, "y": 7}, {"only": 3}, {"z": 0}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert found == pytest.approx(brute_targets(sizes))


def check_mix(docs):
    rows, texts = mixing.mix(docs).collect(), docs.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in texts)
    sizes = Counter()
    for r in texts:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    goals, source = brute_targets(sizes), {(r.doc_id, len(WORD.findall(r.text or ""))): r.source for r in texts}
    taken, largest = Counter(), Counter()
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goals[s]) and r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - goals[s]) <= 2 * largest[s] for s in goals)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(docs).collect()))


def test_op10(odd_docs, no_docs, small_docs):
    check_mix(small_docs)
    check_mix(odd_docs)
    assert mixing.mix(no_docs).count() == 0


def test_op10_sql(small_docs):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    expected = connection.execute(mixing.OP10_SQL).df()[columns].values.tolist()
    assert sorted(map(list, mixing.mix(small_docs).select(columns).collect())) == sorted(expected)


def test_mixed_documents(small_docs, no_docs):
    rows = mixing.mixed_documents(small_docs)
    assert rows.columns == small_docs.columns
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(small_docs).where("size > 0").collect()}
    assert Counter(r.doc_id for r in rows.collect()) == Counter({d: n for d, n in times.items() if n})
    assert mixing.mixed_documents(no_docs).count() == 0


def test_op10_rows_that_share_a_doc_id(spark, monkeypatch):
    """Rows of one doc_id, or equal in all, are taken each on its own, so the source meets its target."""
    for make in (lambda i: (7, f"w{i} " * 100), lambda i: (i, "same words " * 50), lambda i: (7, "same words " * 50), lambda i: (None, "same words " * 50)):
        rows = [(*make(i), "a") for i in range(1000)] + [(5000 + i, f"x{i} y" * 50, "b") for i in range(2000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        found = mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
        assert len(found) == 2 and all(abs(r.taken - r.target) <= 200 and r.most <= 3 for r in found)
        counts = mixing.mixed_documents(docs).groupBy("source").count().collect()
        sizes = {100_000: "a"}
        taken = {sizes.get(r.source_size, "b"): r.taken for r in found}
        assert {r.source: r["count"] for r in counts} == {s: t // (100 if s == "a" else 51) for s, t in taken.items()}


def test_op10_many_sources(spark, monkeypatch):
    """A hot source among more than are broadcast: its rows stay where they are, and the mix is the same."""
    rows = [(i, "w " * (i % 9 + 1), "hot" if i % 3 == 0 else f"s{i % 40}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = Counter(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(common, "FEW_KEYS", 5)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == expected
    check_mix(docs)


def check_ring(docs):
    rows = ring.number(ring.place(docs)).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect())
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    total, largest = sum(loads.values()), max(r.size for r in rows)
    assert max(loads.values()) <= total / 8 * 1.001 + largest + 1
    for shard in loads:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    return rows


def test_op7(spark, odd_docs, no_docs, small_docs):
    check_ring(odd_docs)
    first = {r.doc_id: (r.shard, r.slot) for r in check_ring(small_docs)}
    assert first == {r.doc_id: (r.shard, r.slot) for r in check_ring(small_docs.repartition(7))}
    assert ring.place(no_docs).count() == 0


def test_op7_hot_text(spark):
    """A third of all rows are one text, yet shards stay even."""
    docs = spark.createDataFrame([(i, "copy of one text" if i % 3 == 0 else f"text number {i}") for i in range(3000)], "doc_id long, text string")
    rows = check_ring(docs)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) <= 1.02 * min(loads.values())


def test_op7_ring_moves_little():
    before, after = ring.ring_orders(8), ring.ring_orders(9)
    moved = [(a[0], b[0]) for a, b in zip(before, after) if a[0] != b[0]]
    assert moved and all(b == 8 for _, b in moved) and len(moved) < len(before) / 4


def brute_ring(items, shards, slack, orders):
    """(key, position, turn, row_turn, size) rows to their shards, one lap after the other."""
    total, largest = sum(i[4] for i in items), max(i[4] for i in items)
    room, placed, waiting = [int((1 + slack) * total / shards)] * shards, {}, list(items)
    order = {i[0]: orders[i[1] >> 60 - ring.SLOT_BITS] for i in items}
    for step in range(2 * shards):
        if step == shards:
            room = [r + largest for r in room]
        taken = set()
        for shard in range(shards):
            groups = {}
            for i in waiting:
                if order[i[0]][step % shards] == shard:
                    groups.setdefault(i[2], []).append(i)
            for turn in sorted(groups):
                group = sorted(groups[turn], key=lambda i: i[3])
                if sum(i[4] for i in group) <= room[shard]:
                    fits = group
                else:
                    fits, left = [], room[shard]
                    for i in group if len(group) > 1 else []:
                        if i[4] > left:
                            break
                        fits.append(i)
                        left -= i[4]
                room[shard] -= sum(i[4] for i in fits)
                taken |= {i[0] for i in fits}
                placed |= {i[0]: shard for i in fits}
                if len(fits) < len(group):
                    break
        waiting = [i for i in waiting if i[0] not in taken]
    return placed | {i[0]: order[i[0]][0] for i in waiting}


def test_op7_brute_force(spark, small_docs):
    """Every row's shard, against the ring walked row by row."""
    hot = spark.createDataFrame([(1000 + i, "one hot text of some length " * 20, "en", "a", 1) for i in range(120)], small_docs.schema)
    docs = small_docs.union(hot)
    keys = docs.select(
        "doc_id", ring.xx_60(F.col("text")).alias("position"), ring.xx_60(F.lit("turn"), F.col("text")).alias("turn"),
        ring.xx_60(F.lit("row"), F.col("doc_id"), F.col("text")).alias("row_turn"), (F.octet_length("text") + 1).alias("size"),
    )
    for shards in (8, 3):
        expected = brute_ring([tuple(r) for r in keys.collect()], shards, ring.SLACK, ring.ring_orders(shards))
        assert {r.doc_id: r.shard for r in ring.place(docs, shards).collect()} == expected


def test_op7_repeated_rows(spark):
    """Rows that are equal in all are placed each on its own, so shards stay even; digests are those of the texts."""
    import zlib

    docs = spark.createDataFrame([(7, "a row that comes again and again")] * 2000 + [(i + 10, f"other text {i}") for i in range(2000)] + [(None, "no id")] * 50, "doc_id long, text string").repartition(6)
    rows = check_ring(docs)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert len(loads) == 8 and max(loads.values()) <= 1.02 * min(loads.values())
    assert Counter((r.doc_id, r.text_crc32) for r in rows) == Counter((r.doc_id, zlib.crc32(r.text.encode())) for r in docs.collect())


def test_op7_query(spark):
    rows = ring.op7_ring(spark, "/root/testdata/sf0.001").collect()
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)


def test_op7_grows_by_one_shard(spark):
    """With a ninth shard not much more than its part of the bytes moves, though loads are bounded."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = ({r.doc_id: (r.shard, r.size) for r in ring.place(docs, n).collect()} for n in (8, 9))
    moved = sum(size for d, (shard, size) in before.items() if after[d][0] != shard) / sum(size for _, size in before.values())
    print("moved", moved)
    assert 0.05 < moved < 0.5


def test_hot_keys_meet_in_place(spark, monkeypatch):
    """Rows of hot keys and of others join alike."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 1), (3, 1)], "k long, v int")
    table = spark.createDataFrame([(1, 20, "a"), (2, 1, "b"), (9, 0, "c")], "k long, n long, name string")
    found = common.join_counted(rows, table, "k", 22)
    assert found.columns == ["k", "v", "name"] and Counter(map(tuple, found.collect())) == Counter([(1, i, "a") for i in range(20)] + [(2, 1, "b")])


def test_shared_folder(spark):
    from lectern.llm.common import new_path, spent, stored

    assert "/x-" in new_path(spark, "x")
    with spent(spark) as keep:
        gone = stored(spark.range(3), "gone")
        kept = keep(stored(gone, "kept"))
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_op10_many_sources(spark):
    """Sources are numbered by code point over any number of tasks, and targets follow."""
    draw = np.random.default_rng(4)
    sizes = {f"s{i}": int(n) for i, n in enumerate(draw.integers(0, 10_000, 400) ** 2)} | {None: 5}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(brute_targets(sizes))
