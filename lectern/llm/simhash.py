"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common neighbour within r bits of both.
So every distinct fingerprint emits all its variants within r bits, the variants meet in a
shuffle, and the fingerprints that meet are candidates, verified by their distance. With r = 1
the fingerprints that meet in a variant are at most 65 and all link to each other, so the
smallest of them stands for the rest: a star has the same components as all pairs.

Defined results: a text without words, null included, has fingerprint zero and links like any
other; a row with a null doc_id stays, and takes the smallest doc_id that its component has, if
any; repeated rows stay; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import join_counted, map_rows, one_per_worker, stored, table

SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at the contract's white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[-n:] - 1).tolist()
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint, a signed 64-bit integer."""

    def make():
        one_per_worker("simhash")  # nothing to keep, but room to make

        def rows(batch):
            for doc_id, text in batch:
                f = fingerprint(text, shingle)
                yield doc_id, f - (1 << 64) if f >> 63 else f

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fingerprint long", make)


def variants(fingerprint, radius: int):
    """All values within ``radius`` (0 to 2) bits of a fingerprint column."""
    flips = [0] + [1 << i for i in range(64)] * (radius > 0)
    flips += [1 << i | 1 << j for i in range(64) for j in range(i)] * (radius > 1)
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in signed]), lambda x: fingerprint.bitwiseXOR(x))


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints whose components are those of all pairs within ``distance``.

    ``prints`` has distinct fingerprints; ``distance`` is 2 or 4. All that meet in a variant are
    within ``distance`` of each other, so each links to the smallest of them only.
    """
    if distance not in (2, 4):
        raise ValueError("distance must be 2 or 4")
    # A narrow table has few splits, but each fingerprint becomes many rows: deal them out first.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("fingerprint").repartition(tasks, "fingerprint")
    return (
        dealt.select("fingerprint", F.explode(variants(F.col("fingerprint"), distance // 2)).alias("variant"))
        .groupBy("variant")
        .agg(F.collect_list("fingerprint").alias("met"))
        .where(F.size("met") > 1)
        .select(F.array_min("met").alias("a"), F.explode("met").alias("b"))
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .distinct()
    )


def components(pairs: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for every node of the pairs (a, b).

    Large-star and small-star steps alternate until nothing changes; each is one aggregation and
    one join, and each round is written to the shared folder.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark, n_edges = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.count("*").alias("n"), F.least(F.min("v"), F.col("u")).alias("m")), "least-neighbours")
        large = join_counted(both, least, "u", 2 * n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # after large steps a node has few smaller neighbours
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark, n_edges = now, now[0]
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    prints = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = stored(components(links(prints.select("fingerprint"), distance)), "roots")
    # Per distinct fingerprint the component; only linked fingerprints, a small part, meet again.
    linked = prints.join(roots, prints.fingerprint == roots.node).select("fingerprint", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    moved = stored(linked.join(smallest, "root").select("fingerprint", "smallest"), "moved")
    ids = prints.join(moved, "fingerprint", "left").select("fingerprint", "n", F.coalesce("smallest", "first").alias("component_id"))
    ids = stored(ids, "component-ids")
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_counted(rows, ids, "fingerprint", total).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, distance: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the smallest by doc_id, nulls last, then by hash of the text.

    Rows are told apart by doc_id and text, whatever doc_ids they share; of rows equal in both one stays.
    """

    def make():
        one_per_worker("simhash")

        def rows(batch):
            for doc_id, text in batch:
                f = fingerprint(text, shingle)
                text_hash = hashlib.md5(text.encode()).hexdigest() if text is not None else ""  # as Spark's md5 below
                yield doc_id, text_hash, f - (1 << 64) if f >> 63 else f

        return rows

    rows = stored(map_rows(docs.select("doc_id", "text"), "doc_id long, text_hash string, fingerprint long", make), "hashed-rows")
    key = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id")]
    keys = rows.select(*key, F.col("text_hash").alias("_hash"), "fingerprint")
    first = keys.groupBy("fingerprint").agg(F.min(F.struct("_none", "_id", "_hash")).alias("first"))
    first = stored(first, "distinct-fingerprints")
    roots = stored(components(links(first.select("fingerprint"), distance)), "roots")
    first = first.join(roots, first.fingerprint == roots.node, "left").select(F.coalesce("root", "fingerprint").alias("root"), "first")
    chosen = stored(first.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "chosen-rows")
    same = ["_none", "_id", "_hash"]
    counted = stored(keys.groupBy(*same).agg(F.count("*").alias("n")), "counted-rows")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key, F.coalesce(F.md5("text"), F.lit("")).alias("_hash"))
    kept = found.join(counted.join(chosen, same, "left_anti").select(same), same, "left_anti")
    again = stored(counted.where("n > 1").join(chosen, same, "left_semi").select(same), "equal-rows")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(same))
    return kept.select("row.*")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
