"""The best rows for each of many queries, scored by Arrow batches where the rows are.

Every task keeps the k best rows of each query over all its batches, so what is shuffled is at
most k rows per query and task, however many pairs are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows that are scored at a time; hits that a task holds before it cuts them down to the best.
SLICE, HELD = 8192, 200_000


def kth_best(scores: np.ndarray, k: int, least: float | None) -> np.ndarray:
    """Where the k highest scores are, of equal ones the first; none that is not a number, minus infinity or below ``least``."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.nonzero(scores > limit)[0]
        chosen = np.r_[above, np.nonzero(scores == limit)[0][: k - len(above)]]
    else:
        chosen = np.arange(len(scores))
    return chosen[(scores[chosen] > -np.inf) if least is None else (scores[chosen] >= least)]


def best_rows(
    rows: DataFrame, keys: list[str], query_field: StructField, queries: Broadcast, score: Callable[[object, pa.RecordBatch], Iterator[np.ndarray]], k: int, name: str,
    least: float | None = None, decimals: int = 6,
) -> DataFrame:
    """query_id, rank, keys, ``name``: per query the k rows with the highest scores, rounded; of equal ones those with the smaller keys.

    ``queries`` holds (ids, what ``score`` needs); ``score`` gives, for a batch of ``rows`` in the
    order of the keys, one array of scores per query.
    """
    fields = [StructField("query_id", query_field.dataType), *[StructField(f.name, f.dataType) for f in rows.select(*keys).schema], StructField(name, DoubleType())]
    schema = StructType(fields)
    target = to_arrow_schema(schema)
    order = [("query_id", "ascending"), (name, "descending"), *[(key, "ascending") for key in keys]]

    def cut_down(held: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(held).sort_by(order)
        number = table.column("query_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.nonzero(np.diff(number, prepend=number[0] - 1 if len(number) else 0))[0]
        nth = np.arange(len(number)) - np.repeat(first, np.diff(np.r_[first, len(number)]))
        return table.filter(pa.array(nth < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = queries.value
        ids, held, n = pa.array(ids, type=target.field("query_id").type), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                part = part.take(pc.sort_indices(part, sort_keys=[(key, "ascending") for key in keys]))
                who, where, values = [], [], []
                for i, scores in enumerate(score(wanted, part)):
                    scores = np.round(scores, decimals)
                    chosen = kth_best(scores, k, least)
                    who.append(np.full(len(chosen), i))
                    where.append(chosen)
                    values.append(scores[chosen])
                if not who:
                    continue
                taken = pa.array(np.concatenate(where))
                columns = [ids.take(pa.array(np.concatenate(who))), *[part.column(key).take(taken) for key in keys], pa.array(np.concatenate(values), type=pa.float64())]
                held.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target))
                n += len(taken)
                if n > HELD:
                    held = [cut_down(held)]
                    n = held[0].num_rows
        if held:
            yield from cut_down(held).combine_chunks().to_batches()

    found = rows.mapInArrow(run, schema)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(name).desc(), *keys))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", *keys, name)


def blocks(queries: DataFrame, columns: list[str], size: int, limit: int) -> Iterator[list]:
    """The queries as lists of rows of about ``limit`` bytes, given the ``size`` of all of them in bytes."""
    n = max(1, -(-size // limit))
    for number in range(n):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number) if n > 1 else queries
        yield part.select(*columns).collect()


def together(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
