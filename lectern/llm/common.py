"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: The white space of the word contracts: space and \x09-\x0D. ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{paths}" if paths else ROOT


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without one a local folder, but only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "lectern-shared")
    return folder.rstrip("/")


_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    _paths.append(path)
    return path


@contextmanager
def spent(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end the tables that were stored inside, but for those of the frames given to what this yields.

    For steps whose result is stored, and which are not read again otherwise.
    """
    before, kept = len(_paths), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(df.inputFiles())
        return df

    yield keep
    jvm = spark.sparkContext._jvm
    for path in _paths[before:]:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if not any(f"/{name}/" in file for file in kept):
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            _paths.remove(path)


#: For tables with large rows: readers hold a row group at a time, so it shall be a few rows, not thousands.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` are the writer's.

    It cuts the lineage like a reliable checkpoint, survives lost executors, and the reread
    table has sizes and column pruning.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a small side may have to be broadcast; rows of one key from which on it counts as hot, and its least share of all rows.
BROADCAST_BYTES, HOT_ROWS, HOT_SHARE = 64 << 20, 100_000, 10_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, stored already, with a hint to broadcast it if its size is below ``BROADCAST_BYTES``."""
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    size = df.agg(F.coalesce(F.sum(sum(text, F.lit(16 * len(df.columns))).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` joined with ``table`` (key, n, more), which says how many of the ``total`` rows each key has; without n.

    Keys with so many rows that one task should not take them are at most ``HOT_SHARE``, so they are
    broadcast and their rows stay where they are; the others meet in a shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = table.where(F.col("n") > limit)
    if total <= limit or hot.isEmpty():
        return rows.join(table.drop("n"), key)
    found = rows.join(F.broadcast(hot.drop("n")), key)  # at most HOT_SHARE keys
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col("n") <= limit).drop("n"), key)
    return found.unionByName(rest)


#: Rows of a table with one row per key up to which it is broadcast.
FEW_KEYS = 100_000


def join_few(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table``, stored already, which has one row per ``key``: few are broadcast; of many, hot keys' rows stay where they are."""
    if table.count() <= FEW_KEYS:
        return rows.join(F.broadcast(table), key)
    counts = stored(rows.groupBy(key).agg(F.count("*").alias("n")).join(table, key), "counted-keys")
    return join_counted(rows, counts, key, counts.agg(F.sum("n")).first()[0] or 0)


def lowest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the lowest hashes of ``keys``, the same on every run.

    A threshold that about 4n rows pass comes first, so the task that orders them gets few rows at any size.
    """
    hashed = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    limit = min(1.0, 4 * n / max(1, df.count())) * (1 << 40)
    return df.withColumn("_hash", hashed).where(F.col("_hash") <= int(limit)).orderBy("_hash", *keys).limit(n).drop("_hash")


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[Iterable[tuple]], Iterator[tuple]]]) -> DataFrame:
    """Arrow in, Arrow out: ``make()`` gives, once per task, a generator over the rows of a batch.

    Rows leave in slices of bounded size, so a batch of long texts never doubles in memory.
    """
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for at in range(0, batch.num_rows, 256):
                rows = list(work(zip(*(c.slice(at, 256).to_pylist() for c in columns))))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, type=field.type) for values, field in zip(zip(*rows), target)], schema=target
                    )

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[[object], bool]]) -> DataFrame:
    """The rows of ``df`` whose value in ``column`` passes ``make()``'s predicate, made once per task; no shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = part.column(part.schema.get_field_index(column)).to_pylist()
                if (passed := part.filter(pa.array([keep(v) for v in values]))).num_rows:
                    yield passed

    return df.mapInArrow(run, df.schema)


_large: dict = {}


def one_per_worker(key, make: Callable = lambda: None):
    """A worker's one large object, kept from task to task; another key's object makes room for it."""
    if key not in _large:
        _large.clear()
        gc.collect()
        _large[key] = make()
    return _large[key]


class Memo(dict):
    """A bounded memo of a function of one word; when full it starts anew, frequent words return at once."""

    def __init__(self, function: Callable, limit: int = 300_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.function(key)
        if len(key) <= 64:
            self[key] = value
        return value
