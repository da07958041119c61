"""Ingest of files or rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lectern.config import DEFAULTS, Settings
from lectern.operators import bm25, catalog, chunking, segments, vectors
from lectern.sources import files


def default_split(settings: Settings = DEFAULTS) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: chunking.recursive(rows, settings.chunk_size, settings.chunk_overlap, settings.separators)


def chunk_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType | str, file_format: str = "parquet", glob: str = "*", settings: Settings = DEFAULTS, split: Callable | None = None) -> StreamingQuery:
    """Cut each new document (doc_id, text) and append the chunks to ``target``; all that is there, then stop.

    The file sink commits each batch once, so a restart from the checkpoint neither loses nor repeats a chunk.
    """
    docs = spark.readStream.format(file_format).schema(schema).option("pathGlobFilter", glob).load(source)
    chunks = (split or default_split(settings))(docs.select("doc_id", "text")).select(
        F.col("doc_id").alias("document_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "content", F.sha2("content", 256).alias("content_hash")
    )
    return chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage(name: str, seq: int, **more: Column) -> list[Column]:
    """The columns of a status log's entry for a step of ingest."""
    progress, current = catalog.STAGES[name]
    status = name if name in ("pending", "completed", "failed") else "processing"
    columns = {"error_message": F.lit(None).cast("string"), "chunk_count": F.lit(0).cast("bigint"), "total_characters": F.lit(0).cast("bigint")} | more
    return [F.lit(seq).alias("seq"), F.lit(status).alias("status"), F.lit(progress).alias("progress"), F.lit(current).cast("string").alias("current_stage"), *[c.alias(n) for n, c in columns.items()]]


def index_batch(documents: DataFrame, target: str, number: int, dim: int, split: Callable[[DataFrame], DataFrame], provider: str = "hashing") -> None:
    """Parse, cut, count and embed documents (document_id, path, text); write their chunks and their status log.

    The chunks become a segment of the index under the batch's number, which is added once; the log is
    overwritten when the batch runs again, so a restart repeats nothing. The log's entries come from what was written.
    """
    spark = documents.sparkSession
    good, failed = files.parse(documents)
    cut = split(good.select("document_id", "source", "file_type", F.col("content").alias("text"))).drop("text")
    cut = cut.withColumn("chunk_index", F.col("chunk_index").cast("int")).select("document_id", "chunk_index", "content", "source", "file_type")
    segments.add(cut, f"{target}/index", number, lambda rows: vectors.embed(bm25.count_tokens(rows), dim, provider=provider))
    chunks = segments.of_batch(spark, f"{target}/index", number)
    sizes = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("size"))
    done = good.select("document_id").join(sizes, "document_id", "left")
    count, size = F.coalesce("n", F.lit(0)).cast("bigint"), F.coalesce("size", F.lit(0)).cast("bigint")
    log = documents.select(F.col("document_id").cast("string").alias("document_id"), *stage("parsing", 0))
    for seq, name in enumerate(("chunking", "embedding"), 1):
        log = log.unionByName(good.select("document_id", *stage(name, seq)))
    log = log.unionByName(done.select("document_id", *stage("completed", 3, chunk_count=count, total_characters=size)))
    log = log.unionByName(failed.select("document_id", *stage("failed", 3, error_message=F.col("error"))))
    log.write.mode("overwrite").parquet(f"{target}/status/batch={number}")


def index_stream(spark: SparkSession, documents: DataFrame, target: str, checkpoint: str, dim: int, settings: Settings = DEFAULTS, split: Callable | None = None, provider: str = "hashing") -> StreamingQuery:
    """Index a stream of documents (document_id, path, text) from parsing to status; all that is there, then stop."""
    split = split or default_split(settings)
    run = lambda batch, number: index_batch(batch, target, number, dim, split, provider)
    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index(spark: SparkSession, target: str, settings: Settings = DEFAULTS) -> tuple[DataFrame, bm25.Index, DataFrame]:
    """(chunks, keyword index, latest status of each document) of all batches so far; weights are those of all chunks."""
    path = f"{target}/index"
    log = spark.read.parquet(f"{target}/status")
    latest = catalog.latest(log.withColumn("at", F.struct("batch", "seq")), "document_id", "at").drop("at", "seq", "batch")
    return segments.chunks(spark, path), segments.index(spark, path, settings), latest


def first_of_each(chunks: DataFrame) -> DataFrame:
    """A document's contents that come again, as when a file is processed twice, once; other documents keep theirs."""
    return chunks.dropDuplicates(["document_id", "content_hash"])


def once(stream: DataFrame, arrived: str, delay: str) -> DataFrame:
    """The same for a stream: a document's content that comes again within ``delay`` of its first arrival is dropped.

    The state of a content is dropped when the watermark has passed it, so it stays as large as ``delay`` asks for.
    """
    return stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["document_id", "content_hash"])
