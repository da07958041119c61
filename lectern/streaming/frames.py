"""Replies as they arrive, as server-sent event frames that a service can send on.

A batch's frames are written under its number, which is overwritten when the batch runs again, so a restart neither loses nor repeats a frame. A reply's
frames stand in one file in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import answer


def write_frames(replies: DataFrame, target: str, number: int, cite: Callable[[DataFrame], DataFrame], keys: tuple[str, ...]) -> None:
    found = answer.events(replies, cite(replies), keys=keys).select(*keys, "seq", answer.frame(F.col("type"), F.col("data")).alias("frame"))
    found.repartition(*keys).sortWithinPartitions(*keys, "seq").write.mode("overwrite").parquet(f"{target}/batch={number}")


def event_stream(replies: DataFrame, target: str, checkpoint: str, cite: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("conversation_id",)) -> StreamingQuery:
    """Frame a stream of replies (keys, content, and error if one can fail), whose citations (keys, citation) ``cite`` gives; all that is there, then stop."""
    run = lambda batch, number: write_frames(batch, target, number, cite, keys)
    return replies.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, target: str) -> DataFrame:
    """keys, seq, frame of all batches so far."""
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*").drop("batch")


def events(frames: DataFrame, keys: tuple[str, ...] = ("conversation_id",)) -> DataFrame:
    """keys, seq, type, data of written frames."""
    line = F.from_json(F.substring("frame", len("data: ") + 1, 1 << 30), "type string, data string")
    return frames.select(*keys, "seq", line.alias("e")).select(*keys, "seq", "e.*")
