"""Mixing sources to target weights by hash-threshold histograms.

Every source's target is its weight's share of all words, stopped at ``max_repeats`` times its
size. A target of k whole sizes and a rest takes every document k times, and once more those
whose hash lies under the source's threshold. Histograms of words by source and hash bucket find
the thresholds; only the bucket in which a budget ends is refined; a filter on the hash does the
rest. Thresholds are nested: a smaller budget takes a part of what a larger one takes.

Defined results: a null text has 0 words; a null source is a source of its own, last in order; a
row is hashed by its doc_id and text, so rows that share one of them are taken or left each on
its own; rows equal in both are numbered, and each has a hash of its own; a source
without words has target 0; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, join_few, small_side, stored, table
from lectern.llm.cuts import budget_ends, md5_60
from lectern.llm.ring import numbered_copies

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def in_order(sizes: DataFrame) -> DataFrame:
    """Add ``nth``, from 0, by source in the order of code points, null last: numbers within ranges, and a start for each range."""
    spark, order = sizes.sparkSession, F.col("source").asc_nulls_last()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(sizes.repartitionByRange(tasks, order).withColumn("part", F.spark_partition_id()), "sources")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # one row per task
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return rows.withColumn("nth", nth).join(F.broadcast(starts), "part").withColumn("nth", F.col("start") + F.col("nth")).drop("part", "start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    Sources whose share of the words is above their cap stop there, and the rest is shared anew by
    the others' weights, which raises the share, until no further source is above. Each step is one
    aggregation, so sources may be many; there are as many steps as times that the share rises.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    rows = stored(in_order(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("cap")), "caps")
    number = lambda column: F.coalesce(column, F.lit(0)).cast("long")
    total, all_weight = rows.agg(number(F.sum("source_size")), number(F.sum("weight"))).first()
    left_size, left_weight = total, all_weight
    exact = lambda column: F.lit(column).cast("decimal(19,0)")
    while left_weight:
        capped = F.col("cap").cast("decimal(19,0)") * exact(left_weight) <= F.col("weight").cast("decimal(19,0)") * exact(left_size)
        stopped, open_weight = rows.agg(number(F.sum(F.when(capped, F.col("cap")))), number(F.sum(F.when(~capped, F.col("weight"))))).first()
        if (total - stopped, open_weight) == (left_size, left_weight):
            break
        left_size, left_weight = total - stopped, open_weight
    if not left_weight:
        return rows.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    return rows.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(left_size / left_weight) * F.col("weight")).alias("target"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def hashed() -> Column:
    return md5_60(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), F.coalesce(F.col("text"), F.lit(""))))


def times() -> Column:
    """How often the mix takes a row: the hash at the end itself is taken if that comes nearer to the budget."""
    nearer = (F.col("h") == F.col("end")) & (F.col("before") + F.col("end_size") / 2 <= F.col("budget"))
    return (F.col("whole") + F.when((F.col("h") < F.col("end")) | nearer, 1).otherwise(0)).cast("int")


def own_hashes(rows: DataFrame) -> DataFrame:
    """Rows with the same ``h``, each with one of its own: the first keeps it."""
    return numbered_copies(rows.withColumnRenamed("h", "row_turn")).withColumnRenamed("row_turn", "h")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, grp, size, h of every row, written once: texts are not read again. Rows equal in all have the same ``h``."""
    return stored(docs.select("doc_id", "source", source_key(F.col("source")).alias("grp"), words().alias("size"), hashed().alias("h")), "sizes")


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: its size and target, the whole repeats, and where the rest's budget ends."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = stored(
        targets(sizes, weights, max_repeats)
        .withColumn("whole", whole)
        .withColumn("budget", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .select(source_key(F.col("source")).alias("grp"), "source_size", "target", "whole", "budget"),
        "targets",
    )
    ends = budget_ends(rows.select("grp", "h", "size"), goals.select("grp", "budget"))
    return stored(goals.join(ends.select("grp", "end", "before", F.col("size").alias("end_size")), "grp", "left"), "thresholds")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; the mix takes it ``taken / size`` times."""
    rows = own_hashes(sized(docs))
    return join_few(rows, thresholds(rows, weights, max_repeats), "grp").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times()).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, filtered where they are read."""
    sizes = sized(docs)
    goals = thresholds(own_hashes(sizes), weights, max_repeats)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", source_key(F.col("source")).alias("grp"), hashed().alias("h"))
    again = stored(sizes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "equal-rows")
    if not again.isEmpty():  # only such rows are written to be numbered
        again = small_side(again)
        copies = own_hashes(stored(rows.join(again, "h", "left_semi"), "copies-of-rows"))
        rows = rows.join(again, "h", "left_anti").unionByName(copies)
    return join_few(rows, goals, "grp").select("doc", F.explode(F.array_repeat(F.lit(1), times())).alias("nth")).select("doc.*")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h  -- rows of one table are equal in both nowhere
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighted AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight, source_size * 3 AS cap FROM sizes),
lefts AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM weighted),
marked AS (SELECT *, cap * left_weight <= left_size * weight AS capped FROM lefts),
shares AS (SELECT min_by(left_size::DOUBLE / left_weight::DOUBLE, nth) AS share FROM marked WHERE NOT capped),
goals AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE share * weight END AS target FROM marked LEFT JOIN shares ON true),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         greatest(target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size, 0) AS budget FROM goals),
runs AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         sum(size) OVER (PARTITION BY source, h) AS same FROM rows)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN run - same / 2.0 <= budget AND run - same <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs JOIN budgets ON runs.source IS NOT DISTINCT FROM budgets.source
"""
