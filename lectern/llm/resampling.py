"""Target-distribution importance resampling by hashed n-gram features, with DuckDB in every task.

Each task hands its texts to an in-memory DuckDB in slices of bounded bytes: SQL takes the words,
unnests them, makes the runs of two by a window, and a registered function gives each feature's
zlib CRC. A document's counts by bucket are spilled to Parquet; Spark merges them over all
documents, does the same for the target texts, and scores every document by the mean gain of its
features plus Gumbel noise from its id. The highest scores among the documents that are long
enough are drawn, so the draw is one without replacement by importance weight.

Ranks need no global sort by one task: counts by score (a few thousand different integers) give
the score at which the draw ends, and only rows above it are dealt by ranges and numbered.

Defined results: a null text has no words; a null doc_id draws its noise from ``<seed>:`` and comes last of
equal scores; rows equal in doc_id and score are numbered in any order, the same on every run; a
word is never cut, however long; other columns are ignored; empty tables give an empty table, an empty target gains like one
without features.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import ship, stored, table

BUCKETS, SEED, MIN_WORDS, SHARE = 10_000, 7, 20, 25
#: Bytes of text that DuckDB works on at a time, and the memory that it may take.
SLICE_BYTES, MEMORY = 1 << 20, "400MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Between words of a text that is not lower-cased yet.
BORDER = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
AFTER = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FEATURES = f"""
WITH cut AS (SELECT nth, piece, after, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM slice),
words AS (SELECT nth, piece, after, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM cut),
runs AS (SELECT nth, w, lead(w, 1, translate(after, '{UPPER}', '{LOWER}')) OVER (PARTITION BY piece ORDER BY pos) AS next FROM words),
features AS (SELECT nth, unnest([w, w || ' ' || next]) AS feature FROM runs)
SELECT nth, (crc(feature) % {{buckets}})::INTEGER AS bucket, count(*) AS n FROM features WHERE feature IS NOT NULL GROUP BY nth, bucket"""


def crc(features: pa.Array) -> pa.Array:
    """The unsigned crc32 of each string's bytes, taken from the array's own buffer."""
    features = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    offsets = features.cast(pa.large_binary()).buffers()[1]
    offsets = np.frombuffer(offsets, dtype="<i8")[features.offset : features.offset + len(features) + 1].tolist()
    data, checksum = features.buffers()[2].to_pybytes() if features.buffers()[2] else b"", zlib.crc32
    return pa.array(np.array([checksum(data[a:b]) for a, b in zip(offsets, offsets[1:])], dtype=np.int64))


def pieces(texts: Iterable[str | None], limit: int) -> Iterator[tuple[int, str, str | None]]:
    """(which text, piece, the word that follows the piece) of each text, cut at word borders to about ``limit`` characters."""
    for nth, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            border = BORDER.search(text, at + limit)
            stop = border.start() if border else len(text)
            after = AFTER.search(text, stop)
            yield nth, text[at:stop], after.group() if after else None
            at = stop


def slices(texts: list[str | None], limit: int) -> Iterator[pa.Table]:
    rows, size = [], 0
    for n, row in enumerate(pieces(texts, limit)):
        rows.append((*row, n))
        size += len(row[1])
        if size >= limit:
            yield pa.table(dict(zip(("nth", "text", "after", "piece"), map(pa.array, zip(*rows)))))
            rows, size = [], 0
    if rows:
        yield pa.table({name: pa.array(values, type=kind) for name, values, kind in zip(("nth", "text", "after", "piece"), zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))})


def bucket_counts(texts: list[str | None], connection: duckdb.DuckDBPyConnection, buckets: int = BUCKETS, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's entries start, buckets, counts), in the order of the texts, by ascending buckets."""
    found = []
    for part in slices(texts, limit):
        connection.register("slice", part)
        found.append(connection.execute(FEATURES.format(buckets=buckets)).fetchnumpy())
        connection.unregister("slice")
    if not found:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate([f["nth"].astype(np.int64) * buckets + f["bucket"] for f in found])
    n = np.concatenate([f["n"] for f in found]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    key, n = key[first], np.add.reduceat(n, first)
    return np.searchsorted(key, np.arange(len(texts) + 1) * buckets), key % buckets, n


COUNTED = "doc_id long, n_features long, buckets array<int>, counts array<int>"


def counted(docs: DataFrame, buckets: int = BUCKETS, limit: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_features, and the buckets of its features with their counts, of every row; written once."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        connection.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
        try:
            for batch in batches:
                # Parts of about one slice: rows of few bytes share it, a long text has slices of its own.
                sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
                for size in np.unique(sizes):
                    first, stop = np.searchsorted(sizes, [size, size + 1])
                    part = batch.slice(first, stop - first)
                    starts, which, n = bucket_counts(part.column(1).to_pylist(), connection, buckets, limit)
                    total = np.diff(np.r_[0, np.cumsum(n)][starts])
                    lists = lambda values: pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), lists(which.astype(np.int32)), lists(n.astype(np.int32))], names=["doc_id", "n_features", "buckets", "counts"])
        finally:
            connection.close()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED), "bucket-counts")


def merged(rows: DataFrame, name: str) -> DataFrame:
    """bucket and ``name``, the sum of the counts; at most as many rows as buckets."""
    each = rows.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e"))
    return each.groupBy(F.col("e.buckets").alias("bucket")).agg(F.sum("e.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket 1000 times the logarithm of its smoothed share in the target over that in the source, rounded down."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(merged(source, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left")
    found = np.zeros((2, buckets), dtype=np.int64)
    for bucket, s, t in both.select("bucket", F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))).collect():  # a row per bucket
        found[:, bucket] = s, t
    s, t = found.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight: the mean gain of a document's features, rounded down; without features 0."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # in parts, as the sums take some times the room of the counts
                doc_id, total, which, n = batch.slice(at, 512).columns
                ends = np.cumsum(which.value_lengths().to_numpy(zero_copy_only=False))
                sums = np.r_[0, np.cumsum(shared.value[which.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False))]
                sums = sums[ends] - sums[np.r_[0, ends[:-1]]]
                weight = sums // np.maximum(total.to_numpy(zero_copy_only=False), 1)
                yield pa.RecordBatch.from_arrays([doc_id, total, pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_features long, weight long")


def ranked(scored: DataFrame, n_drawn: int, eligible) -> DataFrame:
    """Add ``rank``, from 1, to the ``n_drawn`` rows with the highest scores among the ``eligible``; the others' is null.

    ``scored`` is stored already and has doc_id, score and row, a number of its own for each row.
    """
    spark = scored.sparkSession
    none = F.lit(None).cast("long").alias("rank")
    rows = scored.where(eligible)
    by_score = rows.groupBy("score").agg(F.count("*").alias("n"))  # scores are integers of a few ten thousands at most
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = by_score.withColumn("above", above).where(F.col("above") < n_drawn).agg(F.min("score")).first()[0] if n_drawn else None
    if end is None:
        return scored.select("*", none)
    inside = eligible & (F.col("score") >= end)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.where(F.col("score") >= end).repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), "drawn")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row per task
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(starts), "part")
    rank = (F.col("start") + F.col("nth")).cast("long")
    return numbered.select(*scored.columns, F.when(rank <= n_drawn, rank).alias("rank")).unionByName(scored.where(~inside).select("*", none))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, limit: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``share`` percent of those with ``min_words`` words are drawn.

    ``target`` (text) is what the documents shall look like.
    """
    rows = counted(docs, buckets, limit)
    gain = gains(rows, counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, limit), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = weighed(rows, gain).withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "scored")
    long_enough = F.col("n_features") >= 2 * min_words - 1  # every word, and every pair of neighbours
    n = scored.where(long_enough).count()
    return ranked(scored, share * n // 100, long_enough).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn by likeness to ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) t(i)),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
cut AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM texts),
features AS (SELECT side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM cut),
counted AS (SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM bytes, tab),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain FROM sums, totals),
means AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(gain * n)::DOUBLE / sum(n))::BIGINT AS weight
  FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) AS words,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT id AS doc_id, ws FROM cut WHERE side = 0) LEFT JOIN means USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM scored WHERE words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= {SHARE} * n // 100 THEN nth END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
