"""A dictionary of words learnt from texts without spaces.

A run of characters is taken for a word if it is frequent, its parts hold together (the least pointwise
mutual information of its two-part splits), and what stands before and after it varies (the entropy of both
neighbours). All is counted by aggregations with map-side sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The same scripts as in ``functions.words``, as the JVM names them.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Characters of a word, occurrences, cohesion and freedom that it needs at least, words that are kept at most.
LONGEST, LEAST, COHESION, FREEDOM, MOST = 4, 5, 2.0, 1.0, 500_000


def grams(texts: DataFrame, scripts: str = UNSPACED, longest: int = LONGEST) -> DataFrame:
    """gram, before, after: every run of one to ``longest`` characters with its neighbours, empty at the ends of a run of the scripts."""
    run = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{scripts}]+"), F.lit(0))).alias("run"))
    at = run.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    n = at.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))).alias("n"))
    before = F.when(F.col("at") > 1, F.substr("run", F.col("at") - 1, F.lit(1))).otherwise("")
    return n.select(F.substr("run", "at", "n").alias("gram"), before.alias("before"), F.substr("run", F.col("at") + F.col("n"), F.lit(1)).alias("after"))


def freedom(rows: DataFrame, side: str) -> DataFrame:
    """gram and ``side``, the entropy of what stands on that side."""
    each = rows.groupBy("gram", side).agg(F.count("*").alias("c"))
    return each.groupBy("gram").agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias(side))


def candidates(texts: DataFrame, scripts: str = UNSPACED, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """word, n, cohesion, freedom of every run of two characters or more that occurs ``least`` times."""
    rows = grams(texts, scripts, longest)
    counts = rows.groupBy("gram").agg(F.count("*").alias("n"))
    total = counts.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    frequent = counts.where((F.col("n") >= least) & (F.length("gram") > 1))
    split = frequent.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("at"))
    split = split.select("gram", "n", F.substr("gram", F.lit(1), "at").alias("left"), F.substr("gram", F.col("at") + 1, F.length("gram")).alias("right"))
    split = split.join(counts.select(F.col("gram").alias("left"), F.col("n").alias("n_left")), "left").join(counts.select(F.col("gram").alias("right"), F.col("n").alias("n_right")), "right")
    held = split.join(F.broadcast(total)).groupBy("gram", "n").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("n_left") * F.col("n_right")))).alias("cohesion"))  # one row
    wide = rows.join(frequent.select("gram"), "gram", "left_semi")
    found = held.join(freedom(wide, "before"), "gram").join(freedom(wide, "after"), "gram")
    return found.select(F.col("gram").alias("word"), "n", "cohesion", F.least("before", "after").alias("freedom"))


def learn(texts: DataFrame, scripts: str = UNSPACED, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, free: float = FREEDOM, most: int = MOST) -> dict[str, int]:
    """Words and their counts for ``functions.words.Cutter``: the ``most`` frequent of those that pass, and single characters."""
    rows = candidates(texts, scripts, longest, least).where((F.col("cohesion") >= cohesion) & (F.col("freedom") >= free)).select("word", "n")
    single = grams(texts, scripts, 1).groupBy(F.col("gram").alias("word")).agg(F.count("*").alias("n"))
    return dict(rows.unionByName(single).orderBy(F.desc("n"), "word").limit(most).collect())
