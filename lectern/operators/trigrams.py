"""Substring search by trigrams: postings, their intersection, then verification.

Every text is known by its distinct runs of three lower-case characters, kept in folders by hash of the run.
A long pattern asks for its rarest runs only; what has all of them is a candidate, and candidates alone are read and
compared. A pattern of up to ``PIECES`` characters is met by the runs of just its length, which need no comparing: each pair
that is made is a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of postings; runs of a pattern that are looked up.
BUCKETS, RAREST = 16, 3
#: Characters of the longest pattern that is met by runs of its own length.
PIECES = 8
#: Short patterns up to which they are broadcast; more of them meet the texts' runs in a shuffle.
FEW = 200_000


def runs(text: Column, size: int = 3) -> Column:
    """The distinct runs of ``size`` lower-case characters of a text; none of a shorter one or of null."""
    low = F.lower(text)
    last = F.length(low) - (size - 1)
    found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(low, i, F.lit(size)))
    return F.when(F.coalesce(last, F.lit(0)) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, path: str, key: str, *columns: str) -> None:
    """Write the rows (key and text columns) and the postings of their texts."""
    spark = rows.sparkSession
    rows.select(key, *columns).write.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    grams = F.array_distinct(F.flatten(F.array(*[runs(F.col(c)) for c in columns])))
    postings = stored.select(F.explode(grams).alias("gram"), F.col(key).alias("key")).withColumn("bucket", _bucket(F.col("gram")))
    # Files of a good size, in the order of the runs, so that a pattern reads few row groups.
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, patterns: DataFrame) -> DataFrame:
    """pattern_id, key of what has the rarest runs of each pattern (pattern_id, pattern) of three characters or more."""
    asked = patterns.select("pattern_id", F.explode(runs(F.col("pattern"))).alias("gram"))
    counted = asked.join(spark.read.parquet(f"{path}/counts"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = counted.withColumn("nth", F.row_number().over(Window.partitionBy("pattern_id").orderBy("n", "gram"))).where(F.col("nth") <= RAREST)
    rare = rare.withColumn("wanted", F.count("*").over(Window.partitionBy("pattern_id"))).select("pattern_id", "gram", "wanted")
    buckets = [r[0] for r in rare.select(_bucket(F.col("gram"))).distinct().collect()]  # at most BUCKETS
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets)).select("gram", "key")
    met = postings.join(rare, "gram").groupBy("pattern_id", "key", "wanted").agg(F.count("*").alias("has"))
    return met.where("has = wanted").select("pattern_id", "key")


def search(spark: SparkSession, path: str, patterns: DataFrame, key: str, *columns: str) -> DataFrame:
    """pattern_id, key of the rows one of whose ``columns`` has the pattern, whatever the case; ``%`` and ``_`` are ordinary.

    An empty pattern is in every text, a null one in none.
    """
    rows = spark.read.parquet(f"{path}/rows")
    low = patterns.select("pattern_id", F.lower("pattern").alias("pattern"))
    has = F.lit(False)
    for column in columns:
        has = has | F.coalesce(F.contains(F.lower(column), F.col("pattern")), F.lit(False))
    size = F.length("pattern")
    short = low.where(size <= PIECES)
    sizes = dict(map(tuple, short.groupBy(size).count().collect()))  # at most PIECES + 1 rows
    longer = low.where(size > PIECES)
    met = candidates(spark, path, longer).withColumnRenamed("key", key)
    found = rows.join(met, key).join(longer, "pattern_id").where(has).select("pattern_id", key)
    if wanted := [n for n in sorted(sizes) if n > 0]:
        pieces = F.array_distinct(F.flatten(F.array(*[runs(F.col(c), n) for c in columns for n in wanted])))
        # Estimates of size know nothing of how many runs a text has: left alone, a plan may broadcast the runs.
        held = short.hint("broadcast" if sum(sizes.values()) <= FEW else "merge")
        found = found.unionByName(rows.select(key, F.explode(pieces).alias("pattern")).join(held, "pattern").select("pattern_id", key))
    if 0 in sizes:
        found = found.unionByName(rows.join(F.broadcast(low.where(size == 0)), has).select("pattern_id", key))  # the empty pattern
    return found
