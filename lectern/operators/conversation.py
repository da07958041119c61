"""Message lists of conversations (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions.text import ellipsis
from lectern.sources import snapshots

#: Batches of messages that a writer may come back to, the last ones.
LAST_BATCHES = 100


def trim(messages: DataFrame, keep: int = DEFAULTS.kept_messages) -> DataFrame:
    """Conversations of up to keep + 1 messages stay; longer ones keep a leading system message and the last ``keep``."""
    by = Window.partitionBy("conv_id")
    rows = messages.withColumn("_n", F.count("*").over(by)).withColumn("_nth", F.row_number().over(by.orderBy("turn")))
    last = F.col("_nth") > F.col("_n") - keep
    lead = (F.col("_nth") == 1) & (F.col("role") == "system")
    return rows.where((F.col("_n") <= keep + 1) | last | lead).drop("_n", "_nth")


def threads(messages: DataFrame, system_prompt: str, known: DataFrame | None = None) -> DataFrame:
    """Messages with a system prompt before the first of each thread that is new; ``known`` has conv_id."""
    first = messages.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    new = first if known is None else first.join(known.select("conv_id").distinct(), "conv_id", "left_anti")
    prompts = new.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("system").alias("role"), F.lit(system_prompt).alias("text"))
    return messages.select("conv_id", "turn", "role", "text").unionByName(prompts)


def deltas(contents: DataFrame) -> DataFrame:
    """conv_id, seq, delta: of growing contents what each adds; nothing where it adds nothing."""
    before = F.max(F.length("content")).over(Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = contents.withColumn("_before", F.coalesce(before, F.lit(0)))
    return rows.where(F.length("content") > F.col("_before")).select("conv_id", "seq", F.substr("content", F.col("_before") + 1).alias("delta"))


def titles(messages: DataFrame, n: int = 50) -> DataFrame:
    """conv_id, title: the start of each conversation's first user message."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", ellipsis(F.col("text"), n).alias("title"))


def post(messages: DataFrame, path: str, batch: str) -> None:
    """Store messages (conv_id, turn, role, text, created_at); a batch that is there already is not stored again."""
    spark = messages.sparkSession
    now = snapshots.read(spark, path)
    if batch in now.facts.get("batches", []):
        return
    folder = snapshots.new_folder(path, "messages")
    messages.select("conv_id", "turn", "role", "text", "created_at").write.parquet(folder)
    snapshots.commit(spark, path, now.added({"batches": [*now.facts.get("batches", []), batch][-LAST_BATCHES:]}, messages=folder))


def remove(conversations: DataFrame, path: str) -> None:
    """Delete the conversations (conv_id) with their messages; what is posted later lives."""
    spark = conversations.sparkSession
    now, folder = snapshots.read(spark, path), snapshots.new_folder(path, "messages")
    messages(spark, path).join(conversations.select("conv_id").distinct(), "conv_id", "left_anti").write.parquet(folder)
    snapshots.commit(spark, path, snapshots.Snapshot(now.version + 1, {"messages": [folder]}, now.facts))


def messages(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return snapshots.table(spark, path, snapshots.read(spark, path, version), "messages")


def listed(spark: SparkSession, path: str, title: int = 50) -> DataFrame:
    """conv_id, title, message_count, created_at, updated_at: derived from the messages in one aggregation, so no count can be off.

    The title is the start of the first message; a conversation changes when a reply comes.
    """
    replied = F.max(F.when(F.col("role") == "assistant", F.col("created_at")))
    rows = messages(spark, path).groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first"), F.count("*").alias("message_count"), F.min("created_at").alias("created_at"), replied.alias("replied")
    )
    return rows.select("conv_id", ellipsis(F.col("first"), title).alias("title"), "message_count", "created_at", F.coalesce("replied", "created_at").alias("updated_at"))
