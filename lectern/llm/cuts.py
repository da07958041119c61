"""Budget ends in hash order without sorting.

Each group's items stand in the order of a hash of 60 bits; the group's budget ends at some
hash. Sums by hash bucket find the bucket in which it ends; only that bucket is summed again by
finer buckets, until one hash value is left. Every step is one aggregation with map-side sums,
so a group of any size is summed by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import join_few, stored

#: Bits of a hash, and of one level of buckets.
BITS, STEP = 60, 15
#: Bits of the buckets whose prefix sums are made together.
INNER = 7


def md5_60(text: Column) -> Column:
    """A hash of 60 bits that other SQL engines give too: the first 15 hex digits of the md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def xx_60(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)


def budget_ends(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """grp, end, before, size, n: the hash at which each group's budget ends.

    ``items``: grp, h, size (0 or more). ``budgets``: grp, budget (0 or more); a group's items are
    taken in ascending h. ``end`` is the last hash whose predecessors, ``before`` in sum, keep within
    the budget; ``size`` and ``n`` are the sum and the number of the items at ``end`` itself. Groups
    without items are left out.
    """
    found = stored(budgets.select("grp", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")), "budgets")
    for shift in range(BITS - STEP, -1, -STEP):
        inside = join_few(items, found.select("grp", "prefix"), "grp").where(F.shiftright("h", shift + STEP) == F.col("prefix"))
        if shift < BITS - STEP:
            items = inside = stored(inside.select("grp", "h", "size"), "boundary")
        sums = inside.groupBy("grp", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        # Prefix sums in two levels: within 2 ** INNER neighbouring buckets, and over these groups.
        sums = sums.withColumn("part", F.shiftright("bucket", INNER))
        before = lambda window, column: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = sums.groupBy("grp", "part").agg(F.sum("size").alias("size"))
        parts = parts.select("grp", "part", before(Window.partitionBy("grp").orderBy("part"), "size").alias("outer"))
        last = (
            sums.withColumn("inner", before(Window.partitionBy("grp", "part").orderBy("bucket"), "size"))
            .join(parts, ["grp", "part"])
            .withColumn("run", F.col("outer") + F.col("inner"))
            .join(found.select("grp", "budget", "before"), "grp")
            .withColumn("before", F.col("before") + F.col("run"))
            .where("before <= budget")
            .groupBy("grp", "budget")
            .agg(F.max_by(F.struct("bucket", "before", "size", "n", "low", "high"), "bucket").alias("at"))
        )
        found = stored(last.select("grp", "budget", "at.*").withColumnRenamed("bucket", "prefix"), "ends")
        if found.where("low < high").isEmpty():
            break
    return found.select("grp", F.col("low").alias("end"), "before", "size", "n")
