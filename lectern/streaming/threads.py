"""Keyed state of conversation threads over a stream of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_messages(messages: DataFrame, keep: int) -> DataFrame:
    """conv_id, n_messages, turns, texts: after each batch, the last ``keep`` messages of the threads that it touched."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, turns, texts = state.get if state.exists else (0, [], [])
        rows = list(zip(turns, texts))
        for frame in frames:
            n += len(frame)
            rows += zip(frame["turn"].tolist(), frame["text"].tolist())
            rows = sorted(rows, key=lambda r: r[0])[-keep:]
        turns, texts = [r[0] for r in rows], [r[1] for r in rows]
        state.update((n, turns, texts))
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [n], "turns": [turns], "texts": [texts]})

    shape = "n_messages long, turns array<long>, texts array<string>"
    return messages.groupBy("conv_id").applyInPandasWithState(update, f"conv_id long, {shape}", shape, "update", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY = "conv_id long, checkpoint_id long, parent_id long, n_messages long, turns array<long>, texts array<string>"


class _History(StatefulProcessor):
    """A thread's messages by the checkpoint that brought them, its checkpoints, and its newest messages."""

    def __init__(self, keep: int, ttl_ms: int | None):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "checkpoint_id long, turn long", "role string, text string", self.ttl_ms)
        self.checkpoints = handle.getMapState("checkpoints", "checkpoint_id long", "parent_id long, n_messages long", self.ttl_ms)
        self.known = handle.getMapState("known", "turn long", "role string, text string", self.ttl_ms)
        self.newest = handle.getValueState("newest", "checkpoint_id long, n_messages long, turns array<long>, texts array<string>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        parent, n, turns, texts = self.newest.get() or (None, 0, [], [])
        checkpoint, last, changed = (parent or 0) + 1, dict(zip(turns, texts)), False
        # Turns above the newest are not known, so the state, a call for each turn, is asked for earlier ones only.
        top, seen = max(turns, default=None), {}
        for frame in rows:
            for turn, role, text in zip(frame["turn"].tolist(), frame["role"].tolist(), frame["text"].tolist()):
                old = seen.get(turn)
                if old is None and top is not None and turn <= top:
                    old = self.known.getValue((turn,))
                if old is not None and tuple(old) == (role, text):
                    continue  # it came before
                seen[turn] = (role, text)
                self.known.updateValue((turn,), (role, text))
                self.messages.updateValue((checkpoint, turn), (role, text))
                n, changed = n + (old is None), True
                if turn in last or len(last) < self.keep or turn > min(last):
                    last[turn] = text
                    last = dict(sorted(last.items())[-self.keep :])
        if changed:
            self.checkpoints.updateValue((checkpoint,), (parent, n))
            self.newest.update((checkpoint, n, list(last), list(last.values())))
            yield pd.DataFrame({"conv_id": [key[0]], "checkpoint_id": [checkpoint], "parent_id": pd.array([parent], "Int64"), "n_messages": [n], "turns": [list(last)], "texts": [list(last.values())]})

    def close(self) -> None:
        pass


def with_history(messages: DataFrame, keep: int, ttl_seconds: int | None = None) -> DataFrame:
    """One row for each checkpoint of a thread: every batch that brings it something new makes one, which names its parent.

    ``messages``: conv_id, turn, role, text. A message that comes again as it was changes nothing; a turn with
    another text is a new version of it. With ``ttl_seconds`` what has not changed for so long is forgotten. The state can be read
    back with ``checkpoints`` and ``state_at``. The stream needs the session's state store to be RocksDB, which this sets.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = _History(keep, None if ttl_seconds is None else 1000 * ttl_seconds)
    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithStateInPandas(processor, HISTORY, "Append", "none" if ttl_seconds is None else "processingtime")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def checkpoints(spark: SparkSession, checkpoint: str) -> DataFrame:
    """conv_id, checkpoint_id, parent_id, n_messages of all threads, from the stream's state."""
    return _state(spark, checkpoint, "checkpoints").select("key.conv_id", "user_map_key.checkpoint_id", "user_map_value.parent_id", "user_map_value.n_messages")


def state_at(spark: SparkSession, checkpoint: str, wanted: DataFrame) -> DataFrame:
    """conv_id, checkpoint_id, turn, role, text: the messages that a thread had at each ``wanted`` (conv_id, checkpoint_id)."""
    rows = _state(spark, checkpoint, "messages").select("key.conv_id", F.col("user_map_key.checkpoint_id").alias("since"), "user_map_key.turn", "user_map_value.*")
    found = rows.join(wanted.select("conv_id", "checkpoint_id"), "conv_id").where("since <= checkpoint_id")
    return found.groupBy("conv_id", "checkpoint_id", "turn").agg(F.max_by(F.struct("role", "text"), "since").alias("message")).select("conv_id", "checkpoint_id", "turn", "message.*")
