"""A stored table of vectors for inverted-file search: lists by nearest centroid, 8-bit codes, deletions as tombstones.

Every insert is a batch of three tables, written in this order:

* ``vectors/batch=/cid=``: the rows themselves;
* ``codes/batch=/cid=``: a byte per dimension of the unit vector, scaled between the least and the largest value that ``create`` saw;
* ``lists/batch=``: per list its rows, how far its farthest vector is from the centroid, and how far a code may be
  from its vector. A batch counts once this is written, so a writer that dies before leaves nothing that is read.

A search reads codes only, and only the folders of the lists that a query asks for; vectors are
fetched for the rows whose codes let them be among the best, and scored exactly. A delete writes
ids with the last batch that it holds for and rewrites nothing; ``compact`` writes the live rows to a new folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.operators import scan
from lectern.operators import vectors as V
from lectern.sources.shared import exists, scratch, written

LISTS = "cid int, n long, near double, slack double"
#: Rows of the tables of codes that are scored at a time; hits that a task holds before it cuts them down.
SLICE, HELD = 8192, 200_000


@dataclass
class Quantizer:
    """Codes of unit vectors: ``low + code * step`` by dimension."""

    low: np.ndarray
    step: np.ndarray

    def encode(self, units: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((units - self.low) / self.step), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.step


@dataclass
class Lists:
    """What a search needs to know of all lists; one row each."""

    centers: np.ndarray
    n: np.ndarray
    #: The angle from the centroid to the farthest vector, and by how much a code's cosine may be off.
    reach: np.ndarray
    slack: np.ndarray


def _fit(rows: DataFrame, dim: int) -> DataFrame:
    return rows.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def create(rows: DataFrame, path: str, n_lists: int, seed: int = 7) -> None:
    """Cluster rows (vec_id, document_id, embedding, any others) and write them as the first batch."""
    spark = rows.sparkSession
    dim = rows.agg(F.max(F.size("embedding"))).first()[0]
    _, centroids = V.cluster(_fit(rows, dim), n_lists, seed)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = V._unit(V._matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(units.min(axis=0)), pa.array(units.max(axis=0))], names=["d", "low", "high"])

    found = _fit(rows, dim).select("embedding").mapInArrow(ends, "d int, low double, high double").groupBy("d").agg(F.min("low"), F.max("high")).orderBy("d").collect()
    low = [r[1] for r in found]
    step = [max((r[2] - r[1]) / 255, 1e-12) for r in found]
    spark.createDataFrame([(low, step)], "low array<double>, step array<double>").coalesce(1).write.parquet(f"{path}/quantizer")
    table = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "cid int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _append(rows, path, 0)


def insert(rows: DataFrame, path: str) -> None:
    """Append rows to the lists of their nearest centroids, as a batch of their own."""
    _append(rows, path, max(batches(rows.sparkSession, path), default=-1) + 1)


def batches(spark: SparkSession, path: str) -> list[int]:
    """The batches that are whole."""
    if not exists(spark, f"{path}/lists"):
        return []
    return sorted(r[0] for r in spark.read.schema(f"{LISTS}, batch int").parquet(f"{path}/lists").select("batch").distinct().collect())


def _append(rows: DataFrame, path: str, batch: int) -> None:
    spark = rows.sparkSession
    centers, quantizer = V._unit(np.array(centroids(spark, path))), quantizer_of(spark, path)
    shared = spark.sparkContext.broadcast((centers, quantizer))  # a row per list

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value[0]
        for part in batches:
            own = V._unit(V._matrix(part.column("embedding"))) if part.num_rows else np.zeros((0, centers.shape[1]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.argmax(own @ centers.T, axis=1).astype(np.int32))], names=[*part.schema.names, "cid"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                codes = shared.value[1].encode(V._unit(V._matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], type=pa.binary()), part.column(2)], names=["vec_id", "code", "cid"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, quantizer = shared.value
        for part in batches:
            if part.num_rows:
                own, cids = V._unit(V._matrix(part.column(0))), part.column(1).to_numpy(zero_copy_only=False)
                off = np.linalg.norm(own - quantizer.decode(quantizer.encode(own)), axis=1)
                near = np.einsum("ij,ij->i", own, centers[cids])
                yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(near), pa.array(off)], names=["cid", "near", "off"])

    # Dealt by list and id, so a large list is written by several tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = _fit(rows, centers.shape[1]).mapInArrow(nearest, StructType([*rows.schema.fields, StructField("cid", IntegerType())]))
    fit.repartitionByRange(tasks, "cid", "vec_id").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/vectors/batch={batch}")
    stored = spark.read.schema(StructType([*rows.schema.fields, StructField("cid", IntegerType())])).parquet(f"{path}/vectors/batch={batch}")
    codes = stored.select("vec_id", "embedding", "cid").mapInArrow(coded, "vec_id long, code binary, cid int")
    codes.write.mode("overwrite").partitionBy("cid").parquet(f"{path}/codes/batch={batch}")
    lists = stored.select("embedding", "cid").mapInArrow(measured, "cid int, near double, off double")
    lists.groupBy("cid").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("off").alias("slack")).coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/batch={batch}")


def centroids(spark: SparkSession, path: str) -> list[list[float]]:
    return [r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()]


def quantizer_of(spark: SparkSession, path: str) -> Quantizer:
    low, step = spark.read.parquet(f"{path}/quantizer").select("low", "step").first()
    return Quantizer(np.array(low), np.array(step))


def lists_of(spark: SparkSession, path: str) -> Lists:
    centers = V._unit(np.array(centroids(spark, path), dtype=np.float64))
    n, near, slack = np.zeros(len(centers), dtype=np.int64), np.ones(len(centers)), np.zeros(len(centers))
    rows = spark.read.schema(LISTS).parquet(f"{path}/lists").groupBy("cid").agg(F.sum("n"), F.min("near"), F.max("slack")).collect()  # a row per list
    for cid, *values in rows:
        n[cid], near[cid], slack[cid] = values
    return Lists(centers, n, np.arccos(np.clip(near, -1, 1)), slack)


def delete(documents: DataFrame, path: str) -> None:
    """Delete all vectors that the documents (document_id) have now; what is inserted later lives."""
    spark = documents.sparkSession
    last = max(batches(spark, path), default=-1)
    gone = live(spark, path).join(documents.select("document_id").distinct(), "document_id", "left_semi")
    gone.select("vec_id", F.lit(last).alias("upto")).write.mode("append").parquet(f"{path}/deleted")


def _living(rows: DataFrame, path: str) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.where(F.col("batch").isin(batches(spark, path)))
    if exists(spark, f"{path}/deleted"):
        gone = spark.read.schema("vec_id long, upto int").parquet(f"{path}/deleted").groupBy("vec_id").agg(F.max("upto").alias("upto"))
        rows = rows.alias("r").join(gone.alias("g"), (F.col("r.vec_id") == F.col("g.vec_id")) & (F.col("batch") <= F.col("upto")), "left_anti")
    return rows.drop("batch")


def live(spark: SparkSession, path: str) -> DataFrame:
    """The rows that are not deleted, with their list ``cid``."""
    return _living(spark.read.parquet(f"{path}/vectors"), path)


def live_codes(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, code, cid of the rows that are not deleted."""
    return _living(spark.read.schema("vec_id long, code binary, batch int, cid int").parquet(f"{path}/codes"), path)


def _survivors(codes: DataFrame, block: tuple, k: int, decimals: int) -> DataFrame:
    """nth, vec_id, cid: the rows of the lists that each query reads whose codes let them be among its k best.

    ``block``: ids, unit vectors, reads (queries x lists), least (scores to reach), quantizer, slack by list.
    """
    spread = 2 * 10.0**-decimals
    reads = block[2]
    asked = np.nonzero(reads.any(axis=0))[0].tolist()
    shared = codes.sparkSession.sparkContext.broadcast(block)  # a block of queries, of bounded bytes

    def cut_down(held: list[np.ndarray], n: int) -> list[np.ndarray]:
        """Only rows whose upper bound reaches the k-th best lower bound of their query."""
        query, _, _, low, high = held
        order = np.lexsort((-low, query))
        first = np.searchsorted(query[order], np.arange(n))
        nth = np.arange(len(order)) - first[query[order]]
        kth = np.full(n, -np.inf)
        kth[query[order][nth == k - 1]] = low[order][nth == k - 1]
        return [c[high >= kth[query] - spread] for c in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, reads, least, quantizer, slack = shared.value
        base, scaled = wanted @ quantizer.low, wanted * quantizer.step
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)]
        for batch in batches:
            cids = batch.column(2).to_numpy(zero_copy_only=False)
            for cid in np.unique(cids):
                inside, who = np.nonzero(cids == cid)[0], np.nonzero(reads[:, cid])[0]
                own = batch.column(0).to_numpy(zero_copy_only=False)[inside]
                codes = np.frombuffer(b"".join(batch.column(1).take(pa.array(inside)).to_pylist()), dtype=np.uint8).reshape(len(inside), -1)
                for at in range(0, len(who), 256):
                    some = who[at : at + 256]
                    for start in range(0, len(own), SLICE):
                        near = base[some, None] + scaled[some] @ codes[start : start + SLICE].astype(float).T
                        limit = least[some] - slack[cid] - spread
                        if near.shape[1] > k:  # below the k-th best here by twice the slack, a row is none of the k best
                            limit = np.maximum(limit, np.partition(near, near.shape[1] - k, axis=1)[:, -k] - 2 * slack[cid] - spread)
                        q, r = np.nonzero(near >= limit[:, None])
                        other = ids[some][q] != own[start + r]
                        q, r, scores = q[other], r[other], near[q[other], r[other]]
                        held = [np.concatenate(p) for p in zip(held, (some[q], own[start + r], np.full(len(q), cid, np.int32), scores - slack[cid], scores + slack[cid]))]
                        if len(held[0]) > HELD:
                            held = cut_down(held, len(ids))
        held = cut_down(held, len(ids))
        for at in range(0, len(held[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65536]) for c in held], names=["nth", "vec_id", "cid", "low", "high"])

    rows = codes.where(F.col("cid").isin(asked)).select("vec_id", "code", "cid").mapInArrow(run, "nth long, vec_id long, cid int, low double, high double")
    place = F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("low")))
    kth = F.max(F.when(F.col("place") == k, F.col("low"))).over(Window.partitionBy("nth"))
    kept = rows.withColumn("place", place).withColumn("kth", F.coalesce(kth, F.lit(float("-inf"))))
    return kept.where(F.col("high") >= F.col("kth") - spread).select("nth", "vec_id", "cid")


def _scored(rows: DataFrame, survivors: DataFrame, ids: np.ndarray, wanted: np.ndarray, asked: list[int], decimals: int) -> DataFrame:
    """query_id, vec_id, score of the survivors by their vectors; only the folders of their lists are read."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, wanted))  # a block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = shared.value
        for batch in batches:
            if batch.num_rows:
                nth = batch.column(0).to_numpy(zero_copy_only=False)
                scores = np.round(np.einsum("ij,ij->i", wanted[nth], V._unit(V._matrix(batch.column(2)))), decimals)
                yield pa.RecordBatch.from_arrays([pa.array(ids[nth]), batch.column(1), pa.array(scores)], names=["query_id", "vec_id", "score"])

    few = F.broadcast(survivors)  # k and a few more for each query of a block
    found = rows.where(F.col("cid").isin(asked)).select("vec_id", "cid", "embedding").join(few, ["cid", "vec_id"])
    return found.select("nth", "vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def search(path: str, queries: DataFrame, k: int, n_probe: int = 10, widen: bool = True, decimals: int = 6, query_bytes: int = V.QUERY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, vec_id, score of the k nearest live rows but the query's own; query_id, lists, codes: how many lists and codes it read).

    The ``n_probe`` lists whose centroids are nearest come first. With ``widen`` any other list is read too if
    the angle to its farthest vector lets it hold one as near as the k-th found in those, so no
    neighbour is lost: by how much fewer lists are read depends on how well the vectors cluster.
    """
    spark = queries.sparkSession
    lists, quantizer = lists_of(spark, path), quantizer_of(spark, path)
    rows, codes = live(spark, path), live_codes(spark, path)
    dim = lists.centers.shape[1]
    fit = _fit(queries, dim)
    folder, hits, reads_of = scratch(spark, "ivf-hits"), None, None
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    for number, block in enumerate(scan.blocks(fit, ["query_id", "embedding"], fit.count() * dim * 8, query_bytes)):
        ids = np.array([r[0] for r in block], dtype=np.int64)
        wanted = V._unit(np.array([r[1] for r in block], dtype=np.float64).reshape(len(block), dim))
        near = np.clip(wanted @ lists.centers.T, -1, 1)
        first = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, :n_probe], True, axis=1)

        def read(reads: np.ndarray, least: np.ndarray, name: str) -> DataFrame:
            kept = written(_survivors(codes, (ids, wanted, reads, least, quantizer, lists.slack), k, decimals), f"{folder}/{name}-{number}")  # noqa: B023
            return written(best(_scored(rows, kept, ids, wanted, np.nonzero(reads.any(axis=0))[0].tolist(), decimals)), f"{folder}/{name}-scored-{number}")  # noqa: B023

        found, reads = read(first, np.full(len(ids), -np.inf), "first"), first
        if widen:
            kth = dict(found.where(F.col("rank") == k).select("query_id", "score").collect())  # a row per query of the block
            least = np.array([kth.get(i, -np.inf) for i in ids.tolist()])
            more = ~first & (lists.n > 0) & (np.cos(np.maximum(np.arccos(near) - lists.reach, 0)) >= least[:, None] - 2 * 10.0**-decimals)
            if more.any():
                found, reads = best(found.drop("rank").unionByName(read(more, least, "more").drop("rank"))), first | more
        counts = spark.createDataFrame(list(zip(ids.tolist(), reads.sum(axis=1).tolist(), (reads @ lists.n).tolist())), "query_id long, lists int, codes long")
        hits, reads_of = (found, counts) if hits is None else (hits.unionByName(found), reads_of.unionByName(counts))
    return hits, reads_of


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the live rows to a new folder as one batch."""
    for name in ("centroids", "quantizer"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{target}/{name}")
    _append(live(spark, path).drop("cid"), target, 0)
