"""A keyword index that grows: segments of postings by token, merged when they are many.

Every batch of chunks becomes a segment, and touches nothing that is stored already:

* ``chunks``: the rows in the order of their keys, with token counts, to be shown or to be indexed anew;
* ``postings``, in folders by hash of the token: for each token and shard of at most ``SHARD`` chunks the chunks that
  have it, how often, and how long they are; for each shard the keys of its chunks;
* ``terms``: by how much each token's document frequency changes.

A delete writes the places of the dead chunks and terms with negative changes, so weights are always those of the living chunks.
Each change is one snapshot of all tables. A search reads the folders and tokens that its queries ask for, deals postings by shard,
and scores a shard's chunks at once: blocks whose bounds fall short of the k-th best score so far are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, _parse_datatype_string

from lectern.config import DEFAULTS, Settings
from lectern.functions.text import tokens
from lectern.operators import bm25, scan
from lectern.operators.bm25 import KEY, _ranges
from lectern.sources import snapshots
from lectern.sources.shared import scratch, written
from lectern.sources.snapshots import Snapshot, new_folder

#: Folders of postings; chunks in a shard; chunks in a block with maxima of its own.
BUCKETS, SHARD, BLOCK = 16, 8192, 128
#: Batches that a stream may come back to, the last ones.
REPEATED = 100
#: Kinds of rows that a search puts together by shard.
KEYS, DEAD, SCOPE, POSTINGS = range(4)


def _shape(document_id) -> StructType:
    """Of the rows of ``postings``: keys in those of kind KEYS, places and counts in the others."""
    start = _parse_datatype_string("shard string, kind int, tok string, docs binary, tfs binary, dls binary")
    return StructType([*start.fields, StructField("ids", ArrayType(document_id)), *_parse_datatype_string("places array<int>").fields])


def _cut(segment: str, target: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, dl, toks, tfs) to the rows of their shards."""

    def shard(name: str, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(key, "ascending") for key in KEY]))
        column = lambda c: rows.column(c).combine_chunks()
        toks, tfs, dls = column("toks").fill_null([]), column("tfs").fill_null([]), column("dl").to_numpy(zero_copy_only=False)
        coded = toks.flatten().dictionary_encode()
        kind = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(dls)), toks.value_lengths().to_numpy(zero_copy_only=False))
        order = np.argsort(kind, kind="stable")
        kind, row, tf = kind[order], row[order].astype("<i4"), tfs.flatten().to_numpy(zero_copy_only=False)[order].astype("<i4")
        n = len(coded.dictionary)
        ends = pa.py_buffer((4 * np.searchsorted(kind, np.arange(n + 1))).astype(np.int32))
        packed = lambda values: pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(values))])
        whole = lambda values: pa.array([values.to_pylist()])
        postings = pa.RecordBatch.from_arrays(
            [
                pa.array([name] * n, type=pa.string()), pa.array(np.full(n, POSTINGS, np.int32)), coded.dictionary, packed(row), packed(tf), packed(dls[row].astype("<i4")),
                pa.nulls(n, target.field("ids").type), pa.nulls(n, target.field("places").type),
            ], schema=target,
        )
        keys = [name, KEYS, None, None, None, None, whole(column(KEY[0])), whole(column(KEY[1]))]
        keys = [v.cast(f.type) if isinstance(v, pa.Array) else pa.array([v], type=f.type) for v, f in zip(keys, target)]
        return pa.Table.from_batches([postings, pa.RecordBatch.from_arrays(keys, schema=target)]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a batch fills up the shard that the one before began
                parts.append(batch.slice(at, SHARD - size))
                at, size = at + parts[-1].num_rows, size + parts[-1].num_rows
                if size == SHARD:
                    yield from shard(f"{segment}-{partition}-{n}", parts).to_batches()
                    n, parts, size = n + 1, [], 0
        if size:
            yield from shard(f"{segment}-{partition}-{n}", parts).to_batches()

    return run


def _bucket(tok: Column) -> Column:
    return F.when(tok.isNull(), -1).otherwise(F.pmod(F.xxhash64(tok), F.lit(BUCKETS))).cast("int")


def _write_segment(rows: DataFrame, path: str, segment: int, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[dict[str, str], int, int]:
    """(the folders of the segment's tables, its chunks, their tokens)."""
    spark = rows.sparkSession
    folders = {table: new_folder(path, table) for table in ("chunks", "postings", "terms")}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, *KEY).sortWithinPartitions(*KEY)
    chunks = written(prepare(placed).withColumn("segment", F.lit(segment)), folders["chunks"])
    shape = _shape(chunks.schema[KEY[0]].dataType)
    name = folders["postings"].rsplit("/", 1)[-1]
    postings = chunks.select(*KEY, "dl", "toks", "tfs").mapInArrow(_cut(name, to_arrow_schema(shape)), shape).withColumn("bucket", _bucket(F.col("tok")))
    # Files of a good size whatever the tasks; sorted, so that a token's rows stand in few row groups.
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "tok", "shard").write.partitionBy("bucket").parquet(folders["postings"])
    stored = spark.read.parquet(folders["postings"]).where(F.col("bucket") >= 0)
    stored.groupBy("tok").agg(F.sum((F.octet_length("docs") / 4).cast("long")).alias("df")).sortWithinPartitions("tok").write.parquet(folders["terms"])
    n, total = chunks.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return folders, n, total


def add(rows: DataFrame, path: str, batch: int | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Snapshot:
    """Index counted chunks (key, content and others, dl, toks, tfs) as a new segment.

    A ``batch`` that is in the index already is not added again, so a stream may repeat it. ``prepare`` may count
    the chunks where they have been sorted: rows are read twice to be sorted, once of them for the borders alone.
    """
    spark = rows.sparkSession
    now = snapshots.read(spark, path)
    if batch is not None and str(batch) in now.facts.get("batches", {}):
        return now
    folders, n, total = _write_segment(rows, path, now.version + 1, prepare)
    facts = {"n": now.facts.get("n", 0) + n, "total": now.facts.get("total", 0) + total}
    if batch is not None:
        facts["batches"] = dict(list((now.facts.get("batches", {}) | {str(batch): now.version + 1}).items())[-REPEATED:])
    return snapshots.commit(spark, path, now.added(facts, **folders))


def delete(documents: DataFrame, path: str) -> Snapshot:
    """Delete the chunks that the documents (document_id) have now; what is added later lives."""
    spark = documents.sparkSession
    now = snapshots.read(spark, path)
    gone = documents.select("document_id").distinct()
    rows = chunks(spark, path).join(gone, "document_id", "left_semi").select(*KEY, "dl", "toks")
    folders = {table: new_folder(path, table) for table in ("dead", "terms", "deleted")}
    written(gone.select("document_id", F.lit(now.version).alias("upto")), folders["deleted"])
    rows.select(F.explode("toks").alias("tok")).groupBy("tok").agg((-F.count("*")).alias("df")).sortWithinPartitions("tok").write.parquet(folders["terms"])
    _places(spark, path, now, gone, DEAD).write.parquet(folders["dead"])
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return snapshots.commit(spark, path, now.added({"n": now.facts["n"] - n, "total": now.facts["total"] - total}, **folders))


def of_batch(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The chunks that a batch added."""
    now = snapshots.read(spark, path)
    return snapshots.table(spark, path, now, "chunks").where(F.col("segment") == now.facts["batches"][str(batch)])


def _places(spark: SparkSession, path: str, now: Snapshot, documents: DataFrame, kind: int) -> DataFrame:
    """shard, kind, places: where the documents' chunks are, by shard."""
    keys = snapshots.table(spark, path, now, "postings").where(F.col("bucket") == -1).select("shard", F.posexplode("ids").alias("place", "document_id"))
    found = keys.join(documents, "document_id", "left_semi").groupBy("shard").agg(F.collect_list("place").alias("places"))  # a shard has SHARD places
    return found.select("shard", F.lit(kind).alias("kind"), "places")


def merge(spark: SparkSession, path: str) -> Snapshot:
    """Write the living chunks as one segment; older versions stay readable."""
    now = snapshots.read(spark, path)
    folders, n, total = _write_segment(chunks(spark, path).drop("segment"), path, now.version + 1)
    return snapshots.commit(spark, path, Snapshot(now.version + 1, {t: [f] for t, f in folders.items()}, now.facts | {"n": n, "total": total}))


def chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The living chunks, with all their columns and their ``segment``."""
    now = snapshots.read(spark, path, version)
    rows, gone = snapshots.table(spark, path, now, "chunks"), snapshots.table(spark, path, now, "deleted")
    if gone is not None:
        gone = gone.groupBy("document_id").agg(F.max("upto").alias("upto"))
        rows = rows.alias("r").join(gone.alias("g"), (F.col("r.document_id") == F.col("g.document_id")) & (F.col("segment") <= F.col("upto")), "left_anti")
    return rows


def shown(spark: SparkSession, path: str, hits: DataFrame, *columns: str, version: int | None = None, most: int = 10_000) -> DataFrame:
    """``hits``, stored already, with columns of their chunks: few documents are pushed to the scan, which reads the row groups that may have them."""
    rows = chunks(spark, path, version)
    wanted = hits.select(KEY[0]).distinct().limit(most + 1).collect()
    if len(wanted) <= most:
        rows = rows.where(F.col(KEY[0]).isin([r[0] for r in wanted]))
    return hits.join(rows.select(*KEY, *columns), KEY)


def terms(spark: SparkSession, path: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """tok, df of all tokens of living chunks, or of those of ``only`` (tok), a small table."""
    rows = snapshots.table(spark, path, snapshots.read(spark, path, version), "terms", "tok string, df long")
    if only is not None:
        rows = rows.join(F.broadcast(only), "tok")  # the tokens of a block of queries
    return rows.groupBy("tok").agg(F.sum("df").alias("df")).where("df > 0")


def _raw(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def index(spark: SparkSession, path: str, settings: Settings = DEFAULTS, version: int | None = None) -> bm25.Index:
    """The same as an index of the living chunks that is built at once; nothing is read before it is asked for."""
    facts = snapshots.read(spark, path, version).facts
    n = facts["n"]
    raw = terms(spark, path, version).select("tok", _raw(n).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_raw"))
    idf = raw.join(F.broadcast(mean)).select("tok", F.when(F.col("raw") < 0, settings.bm25_epsilon * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))  # one row
    stats = spark.createDataFrame([(n, facts["total"] / n if n else None)], "n long, mean_dl double")
    return bm25.Index(chunks(spark, path, version).select(*KEY, "dl", "toks", "tfs"), idf, stats)


class _Shard:
    """A shard's postings of the asked tokens: impacts by token, and their maxima by block."""

    def __init__(self, rows: pa.Table, vocabulary: dict[str, int], idf: np.ndarray, k1: float, b: float, mean_dl: float):
        kinds = rows.column("kind").to_numpy()
        of = lambda kind: rows.filter(pa.array(kinds == kind)).column("places").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        asked = rows.filter(pa.array(kinds == POSTINGS))
        number = np.array([vocabulary[t] for t in asked.column("tok").to_pylist()], dtype=np.int64)
        values = lambda c: np.frombuffer(b"".join(asked.column(c).to_pylist()), dtype="<i4").astype(np.int64)
        docs, tf, dl = values("docs"), values("tfs").astype(float), values("dls")
        self.n = SHARD
        self.alive = np.full(self.n, not (kinds == SCOPE).any())
        self.alive[of(SCOPE)] = True
        self.alive[of(DEAD)] = False
        number = np.repeat(number, pc.binary_length(asked.column("docs")).to_numpy() // 4)
        order = np.argsort(number, kind="stable")
        self.docs, number, tf, dl = docs[order], number[order], tf[order], dl[order]
        self.impact = idf[number] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean_dl))
        self.starts = np.searchsorted(number, np.arange(len(vocabulary) + 1))
        self.n_blocks = -(-self.n // BLOCK)
        block = number * self.n_blocks + self.docs // BLOCK
        first = np.nonzero(np.diff(block, prepend=-1))[0]
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.block = block[first] % self.n_blocks
        self.block_starts = np.searchsorted(number[first], np.arange(len(vocabulary) + 1))

    def best(self, which: np.ndarray, times: np.ndarray, k: int, least: float, decimals: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best living chunks with scores above 0, none below ``least``."""
        first, stop = self.block_starts[which], self.block_starts[which + 1]
        entries = _ranges(first, stop)
        bounds = np.bincount(self.block[entries], weights=self.most[entries] * np.repeat(times, stop - first), minlength=self.n_blocks)
        passed = bounds >= least - 10.0**-decimals
        if not passed.any():
            return np.zeros(0, np.int64), np.zeros(0)
        first, stop = self.starts[which], self.starts[which + 1]
        entries, weight = _ranges(first, stop), np.repeat(times, stop - first)
        if not passed.all():
            inside = passed[self.docs[entries] // BLOCK]
            entries, weight = entries[inside], weight[inside]
        scores = np.round(np.bincount(self.docs[entries], weights=self.impact[entries] * weight, minlength=self.n), decimals)
        chosen = scan.kth_best(np.where(self.alive & (scores > 0), scores, np.nan), k, max(least, 0.0))
        return chosen, scores[chosen]


def search(path: str, queries: DataFrame, k: int, scope: DataFrame | None = None, settings: Settings = DEFAULTS, tokenize=tokens, query_bytes: int = bm25.QUERY_BYTES, version: int | None = None, decimals: int = 6) -> DataFrame:
    """query_id, rank, key, bm25_score: as ``bm25.search`` over the living chunks, chunks without a common token with score 0 too."""
    spark = queries.sparkSession
    now = snapshots.read(spark, path, version)
    cut = queries.select("query_id", tokenize(F.col("text")).alias("toks"), F.octet_length("text").alias("size"))
    size, parts = cut.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], []
    folder = scratch(spark, "keyword-hits")
    for number, block in enumerate(scan.blocks(cut, ["query_id", "toks"], size, query_bytes)):
        parts.append(written(_search_block(spark, path, now, block, queries.schema["query_id"], k, scope, settings, decimals, f"{folder}/{number}"), f"{folder}/{number}"))
    found = scan.together(parts)
    # A query with fewer hits is filled with the first chunks that are none of its hits, at score 0.
    counts = queries.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    short = counts.where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    keys = chunks(spark, path, version).select(*KEY)
    keys = (keys if scope is None else bm25.scoped(keys, scope)).orderBy(*KEY).limit(2 * k).collect()
    zeros = F.array(*[F.struct(*[F.lit(v).cast(found.schema[c].dataType).alias(c) for c, v in zip(KEY, r)]) for r in keys]) if keys else None
    if zeros is not None:
        rest = short.select("query_id", F.explode(zeros).alias("key")).select("query_id", "key.*").join(found.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
        found = found.unionByName(rest.withColumn("bm25_score", F.lit(0.0)))
    return bm25.top(found, "bm25_score", k, decimals).select("query_id", "rank", *KEY, "bm25_score")


def _search_block(spark: SparkSession, path: str, now: Snapshot, block: list, query_field: StructField, k: int, scope: DataFrame | None, settings: Settings, decimals: int, folder: str) -> DataFrame:
    """query_id, key, bm25_score: of each query of a block the k best with scores above 0, and more of equal score."""
    n, mean_dl = now.facts["n"], now.facts["total"] / max(1, now.facts["n"])
    numbers = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(block)], StructType([StructField("nth", LongType()), StructField("query_id", query_field.dataType)]))
    words = sorted({t for r in block for t in r["toks"] or ()})
    asked = spark.createDataFrame([(w,) for w in words], "tok string")  # at most the block's tokens
    raw = dict(terms(spark, path, now.version, asked).select("tok", _raw(n)).collect())
    if any(v < 0 for v in raw.values()):  # a token of more than half of the chunks weighs by the mean of all
        mean = terms(spark, path, now.version).agg(F.avg(_raw(n))).first()[0]
        raw = {t: v if v >= 0 else settings.bm25_epsilon * mean for t, v in raw.items()}
    if any(v < 0 for v in raw.values()):  # so few chunks that most tokens are in most: chunks without them come before
        queries = spark.createDataFrame([(i, r["toks"]) for i, r in enumerate(block)], "query_id long, text array<string>")
        found = bm25.search(index(spark, path, settings, now.version), queries, k, scope, settings, lambda text: text)
        return found.withColumnRenamed("query_id", "nth").join(F.broadcast(numbers), "nth").select("query_id", *KEY, "bm25_score")  # a row per query
    vocabulary = {t: i for i, t in enumerate(sorted(raw))}
    idf = np.array([raw[t] for t in vocabulary], dtype=float)
    wanted = []
    for r in block:
        counts = Counter(t for t in r["toks"] or () if t in vocabulary)
        wanted.append((np.array([vocabulary[t] for t in counts], dtype=np.int64), np.array(list(counts.values()), dtype=float)))
    shared = spark.sparkContext.broadcast(([r["query_id"] for r in block], vocabulary, idf, wanted))  # query_bytes of text, about

    postings = snapshots.table(spark, path, now, "postings")
    known = spark.createDataFrame([(t,) for t in vocabulary], "tok string")
    buckets = [r[0] for r in known.select(_bucket(F.col("tok"))).distinct().collect()]  # at most BUCKETS
    rows = postings.where(F.col("bucket").isin(buckets)).join(F.broadcast(known), "tok", "left_semi").drop("bucket")
    if len(vocabulary) <= 1000:
        rows = rows.where(F.col("tok").isin(list(vocabulary)))  # pushed to the scan
    rows = rows.select("shard", "kind", "tok", "docs", "tfs", "dls", "places")
    dead = snapshots.table(spark, path, now, "dead", "shard string, kind int, places array<int>")
    extra = [] if dead is None else [dead]
    if scope is not None:
        extra.append(_places(spark, path, now, scope.select("document_id").distinct(), SCOPE))
    for more in extra:
        rows = rows.unionByName(more, allowMissingColumns=True)
    scoped, k1, b = scope is not None, settings.bm25_k1, settings.bm25_b
    target = StructType([StructField("nth", LongType()), *_parse_datatype_string("shard string, place int, bm25_score double").fields])

    def score(name: str, parts: list[pa.RecordBatch], least: np.ndarray, tops: list) -> pa.RecordBatch | None:
        _, vocabulary, idf, wanted = shared.value
        rows = pa.Table.from_batches(parts)
        if scoped and not pc.any(pc.equal(rows.column("kind"), SCOPE)).as_py():
            return None
        shard, out = _Shard(rows, vocabulary, idf, k1, b, mean_dl), ([], [], [])
        for i, (which, times) in enumerate(wanted):
            places, scores = shard.best(which, times, k, least[i], decimals)
            if len(places):
                tops[i] = np.sort(np.r_[tops[i], scores])[::-1][:k]
                least[i] = tops[i][-1] if len(tops[i]) == k else least[i]
                for list_, values in zip(out, (np.full(len(places), i), places, scores)):
                    list_.append(values)
        if not out[0]:
            return None
        who, places, scores = map(np.concatenate, out)
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array([name] * len(who)), pa.array(places.astype(np.int32)), pa.array(scores)], names=["nth", "shard", "place", "bm25_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value[0])
        least, tops, name, parts = np.full(n, -np.inf), [np.zeros(0)] * n, None, []
        for batch in batches:
            shards = batch.column("shard").dictionary_encode()
            edges = np.nonzero(np.diff(shards.indices.to_numpy(zero_copy_only=False), prepend=-1))[0]
            for start, stop in zip(edges, np.r_[edges[1:], batch.num_rows]):
                own = batch.column("shard")[int(start)].as_py()
                if own != name and parts:
                    if (found := score(name, parts, least, tops)) is not None:
                        yield found
                    parts = []
                name = own
                parts.append(batch.slice(start, stop - start))
        if parts and (found := score(name, parts, least, tops)) is not None:
            yield found

    hits = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, target)
    # Which of equal scores come first is a matter of keys, which only the shards of what is left are read for.
    place = F.rank().over(Window.partitionBy("nth").orderBy(F.desc("bm25_score")))
    hits = written(hits.withColumn("rank", place).where(F.col("rank") <= k).drop("rank"), f"{folder}-hits")
    keys = postings.where(F.col("bucket") == -1).select("shard", "ids", "places")
    shards = hits.select("shard").distinct().limit(1001).collect()
    if len(shards) <= 1000:
        keys = keys.where(F.col("shard").isin([r[0] for r in shards]))  # pushed to the scan
    at = lambda column: F.element_at(column, F.col("place") + 1)
    found = keys.join(F.broadcast(hits), "shard").select("nth", at("ids").alias(KEY[0]), at("places").alias(KEY[1]), "bm25_score")  # some k for each query of the block
    return found.join(F.broadcast(numbers), "nth").select("query_id", *KEY, "bm25_score")  # a row per query
