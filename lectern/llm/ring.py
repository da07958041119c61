"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Equal texts have one position on the ring, so copies go to the same shard while it has room.
No shard takes more than the mean load and a slack; what overflows a full shard continues
clockwise to the next one. A shard fills in the order of a second hash, so the result does not
depend on the order of rows. Only DataFrame functions run: hash histograms find where a shard's
room ends, and a row's shard is then a comparison with at most rounds x shards numbers.

Defined results: a null text counts as the empty text; rows with a null doc_id are placed like
any other; a hot text takes the room that is left, shard after shard; of rows that are equal in doc_id and text
each is numbered and placed on its own; rows that fit nowhere stay on their first shard; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import small_side, stored, table
from lectern.llm.cuts import BITS, xx_60

SHARDS = 8
VIRTUAL_NODES = 64
SLOT_BITS = 12
#: Hash bits of a level of buckets.
STEP = 12
SLACK = 0.001
#: Rows of a shard's numbering that one task sorts at a time, about.
NUMBERED_ROWS = 50_000


def ring_orders(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each of the ring's slots the shards in clockwise order."""
    slots = 1 << SLOT_BITS
    digest = lambda s, v: int.from_bytes(hashlib.md5(f"{s}-{v}".encode()).digest()[:8], "big")
    nodes = sorted((digest(s, v) % slots, digest(s, v), s) for s in range(shards) for v in range(virtual_nodes))
    orders, at = [], 0
    for slot in range(slots):
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        orders.append(list(dict.fromkeys(nodes[(at + k) % len(nodes)][2] for k in range(len(nodes)))))
    return orders


def _pick(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def _ends(items: DataFrame, room: list[int]) -> dict[int, tuple[int, int, int]]:
    """For every shard that items ask for: the hash at which its room ends, the sum below it, the items at it.

    Sums by hash bucket are at most shards x 4096 rows whatever the input; only the bucket in which
    the room ends is summed again by finer buckets, until it holds one hash value.
    """
    found: dict[int, tuple] = {}
    for shift in range(BITS - STEP, -1, -STEP):
        inside = items
        if found:
            prefixes = [found[s][0] >> shift + STEP if s in found else -1 for s in range(len(room))]
            inside = items.where(F.shiftright("h", shift + STEP) == _pick(prefixes, F.col("grp")))
        buckets = inside.groupBy("grp", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        sums: dict[int, list] = {}
        for b in sorted(buckets.collect(), key=lambda b: (b["grp"], b["bucket"])):
            sums.setdefault(b["grp"], []).append(b)
        for s, rows in sums.items():
            before = found[s][1] if s in found else 0
            if before + sum(b["size"] for b in rows) <= room[s]:
                found[s] = (1 << BITS, before + sum(b["size"] for b in rows), 0, True)
                continue
            for b in rows:
                if before + b["size"] > room[s]:
                    break
                before += b["size"]
            found[s] = (b["low"], before, b["n"], b["low"] == b["high"])
        if all(done for *_, done in found.values()):
            break
    return {s: (end, before, n) for s, (end, before, n, _) in found.items()}


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Rows of equal ``row_turn``, which are equal in all, each with one of its own.

    A key's rows are counted where they are and numbered from there on: no task gets all rows of
    a key that repeats, and the one that has no copies, as a rule all rows, is not shuffled.
    """
    again = stored(rows.groupBy("row_turn").agg(F.count("*").alias("n")).where("n > 1").select("row_turn"), "repeated")
    if again.isEmpty():
        return rows
    again = small_side(again)
    copies = stored(rows.join(again, "row_turn", "left_semi").withColumn("task", F.spark_partition_id()), "copies")
    counts = copies.groupBy("row_turn", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("row_turn").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("row_turn", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("row_turn", "task").orderBy("doc_id")) - 1
    made = copies.withColumn("nth", nth).join(starts, ["row_turn", "task"]).withColumn("copy", F.col("start") + F.col("nth"))
    own = F.when(F.col("copy") == 0, F.col("row_turn")).otherwise(xx_60(F.lit("copy"), F.col("row_turn"), F.col("copy")))
    made = made.withColumn("row_turn", own).select(rows.columns)
    return stored(rows.join(again, "row_turn", "left_anti").select(rows.columns).unionByName(made), "own-turns")


def place(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, first_shard, shard of every row.

    A row's size is the UTF-8 bytes of its text plus 1. On the first lap no shard takes more than
    the mean and the slack. The few rows that then fitted nowhere, each larger than the room that
    its shards had left, go round once more, with room for one largest row more on every shard;
    as full shards then hold more than the mean, some shard always has room.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            xx_60(text).alias("position"),
            xx_60(F.lit("turn"), text).alias("turn"),
            xx_60(F.lit("row"), F.col("doc_id"), text).alias("row_turn"),
        ),
        "sizes",
    )
    rows = numbered_copies(rows)
    orders = ";".join(",".join(map(str, order)) for order in ring_orders(shards, virtual_nodes))
    ring = spark.range(1).select(F.posexplode(F.split(F.lit(orders), ";")).alias("slot", "order"))
    ring = ring.select("slot", F.split("order", ",").cast("array<int>").alias("shards"))
    slot = F.shiftright("position", BITS - SLOT_BITS).cast("int")
    rows = rows.withColumn("slot", slot).join(F.broadcast(ring), "slot")  # the ring has 4096 rows at any size
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    room = [int((1 + slack) * total / shards)] * shards

    waiting, shard = rows, F.lit(None).cast("int")
    for turn in range(2 * shards):
        if turn == shards:
            room = [r + largest for r in room]
        here = F.element_at("shards", turn % shards + 1)
        items = waiting.select(here.alias("grp"), F.col("turn").alias("h"), "size", "row_turn")
        cuts = _ends(items, room)
        if not cuts:
            break
        # Up to which hash each shard takes; a shard with room for all takes all.
        ends, row_ends = [1 << BITS] * shards, [0] * shards
        for s, (end, before, _) in cuts.items():
            ends[s], room[s] = end, room[s] - before
        split = [s for s, (_, _, n) in cuts.items() if n > 1]
        if split:  # copies at the end of the room are taken row by row
            copies = items.where((F.col("h") == _pick(ends, F.col("grp"))) & F.col("grp").isin(split))
            for s, (end, before, _) in _ends(copies.select("grp", F.col("row_turn").alias("h"), "size"), room).items():
                row_ends[s], room[s] = end, room[s] - before
        taken = (F.col("turn") < _pick(ends, here)) | ((F.col("turn") == _pick(ends, here)) & (F.col("row_turn") < _pick(row_ends, here)))
        shard = F.coalesce(shard, F.when(taken, here))
        if all(end == 1 << BITS for end in ends):
            break
        waiting = stored(waiting.where(~taken), "overflow")
    first = F.element_at("shards", 1)
    return rows.select("doc_id", "size", "text_crc32", "row_turn", first.alias("first_shard"), F.coalesce(shard, first).alias("shard"))


def number(placed: DataFrame) -> DataFrame:
    """Add ``slot``, without gaps from 0 in each shard, in an order that is a function of the rows."""
    placed = stored(placed, "placed")
    parts = max(1, placed.count() // NUMBERED_ROWS)
    placed = placed.withColumn("part", F.pmod("row_turn", F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("row_turn", "doc_id", "size", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "part"])
        .withColumn("slot", F.col("start") + F.col("nth"))
    )


def op7_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number(place(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "first_shard",
    )
