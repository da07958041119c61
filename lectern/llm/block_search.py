"""Ranked lexical search with block-max pruning over a forward index.

Each task cuts its part of the documents into shards of bounded size and writes each shard as one
row: a forward index (per document its terms and how often each occurs) and, for ranges of
``BLOCK`` documents, per term the largest number of occurrences and the fewest terms of a
document that has it. Documents are numbered so that alike ones, and ones of like length, stand
together. A score grows with the occurrences and falls with the length, so the two numbers give
a bound for every document of the range under any statistics. Document frequencies, the number
of documents and their terms are summed over all shards before the search, so scores are global
and the shards' best merge exactly.

For a query, a shard's blocks are sorted by their bound; their documents are scored from the
forward index, best blocks first, until the next bound is below the k-th best score so far. A
task's shards raise this score for one another. Queries come in blocks of bounded bytes.

Scores are 64-bit integers: a term of the query adds its weight, floor(1000 ln((2N+2) / (2df+1))),
times (1000000000 tf) div (1000 tf + 12 m), where m is 75 + (25 n N) div L.

Defined results: a null text or query has no terms; documents without terms do not count; only
scores above 0 are hits; equal scores by ascending doc_id, null last; repeated rows are hits of
their own; rows of ``benchmark`` that share an item_id, null included, are one query with their terms together; other
columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lectern.llm.common import LARGE_ROWS, map_rows, ship, stored, table
from lectern.llm.search import _ranges

TOP = 20
#: Bytes of text in a shard and of queries in a block; documents in a range with maxima of its own.
SHARD_BYTES, QUERY_BYTES, BLOCK = 2 << 20, 16 << 20, 16
#: Tasks that search, for each core of the cluster; shards that a task reads at most, about.
TASKS_PER_CORE, SHARDS_PER_TASK = 3, 64
#: Ranges that are scored at first; each further step takes twice as many.
FIRST_BLOCKS = 4

#: A-Z lower-cased, all other ASCII but digits and a-z made to spaces: what is left between spaces are the terms.
_FOLD = bytes(ord(" ") if not (chr(i).isascii() and chr(i).isalnum()) and i < 128 else i for i in range(256)).lower()

INDEX = (
    "shard string, n_docs long, n_terms long, doc_ids binary, nulls binary, lengths binary, terms binary, dfs binary, doc_starts binary, doc_terms binary, doc_tfs binary, "
    "block_starts binary, block_terms binary, block_tfs binary, block_lengths binary"
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _largest(values: np.ndarray, starts: np.ndarray, function=np.maximum) -> np.ndarray:
    return function.reduceat(values, starts) if len(starts) else values[:0]


def build_shard(name: str, rows: list[tuple[int | None, array]], number: dict[bytes, int]) -> tuple:
    """One row of the index from (doc_id, its terms' numbers) rows, all with terms, and the terms by number."""
    kinds, lengths = len(number), np.array([len(terms) for _, terms in rows], dtype=np.int64)
    flat = np.concatenate([np.frombuffer(terms, dtype=np.int32) for _, terms in rows])
    keys, tfs = np.unique(np.repeat(np.arange(len(rows)), lengths) * kinds + flat, return_counts=True)
    docs, terms = np.divmod(keys, kinds)
    dfs = np.bincount(terms, minlength=kinds)
    # The most shared term of a document stands for what it is about.
    about = np.maximum.reduceat(dfs[terms] * kinds + terms, np.searchsorted(docs, np.arange(len(rows))))
    order = np.lexsort((lengths, about))
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.arange(len(rows))
    moved = np.argsort(place[docs], kind="stable")
    docs, terms, tfs, lengths = place[docs][moved], terms[moved], tfs[moved], lengths[order]
    doc_starts = np.searchsorted(docs, np.arange(len(rows) + 1))
    n_blocks = -(-len(rows) // BLOCK)
    ranged = docs // BLOCK * kinds + terms
    by_block = np.argsort(ranged, kind="stable")
    ranged = ranged[by_block]
    first = np.nonzero(np.diff(ranged, prepend=-1))[0]
    block_tfs, block_lengths = _largest(tfs[by_block], first), _largest(lengths[docs[by_block]], first, np.minimum)
    blocks, block_terms = np.divmod(ranged[first], kinds)
    ids = [rows[i][0] for i in order]
    small = lambda a: a.astype("<i4").tobytes()
    return (
        name, len(rows), int(lengths.sum()), np.array([0 if d is None else d for d in ids], dtype="<i8").tobytes(), np.array([d is None for d in ids]).tobytes(),
        small(lengths), b" ".join(number), small(dfs), doc_starts.astype("<i8").tobytes(), small(terms), small(tfs),
        np.searchsorted(blocks, np.arange(n_blocks + 1)).astype("<i8").tobytes(), small(block_terms), small(block_tfs), small(block_lengths),
    )


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of all documents that have a term."""
    ship(docs.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n, rows, number, size = TaskContext.get().partitionId(), 0, [], {}, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(build_shard(f"{partition}-{n}", rows, number), target)], schema=target)

        for batch in batches:
            texts = batch.column(1)
            for at, doc_id in enumerate(batch.column(0).to_pylist()):
                terms = terms_of(texts[at].as_py())
                if not terms:
                    continue
                # As numbers at once: the words themselves would take ten times the room.
                rows.append((doc_id, array("i", [number.setdefault(t, len(number)) for t in terms])))
                size += len(texts[at].as_buffer()) + 64
                if size >= shard_bytes:
                    yield row()
                    n, rows, number, size = n + 1, [], {}, 0
        if rows:
            yield row()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX), "forward-index", **LARGE_ROWS)


class Queries:
    """Some queries: their ids, and their terms as numbers of a common vocabulary with how often each occurs; ``weights`` of the vocabulary come later."""

    def __init__(self, rows: list[tuple]):
        counts: dict[object, Counter] = {}
        for query_id, text in rows:
            counts.setdefault(query_id, Counter()).update(terms_of(text))
        self.vocabulary: dict[bytes, int] = {}
        self.ids = list(counts)
        self.terms = [
            (np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in counts.values()
        ]

    def numbers(self, terms: bytes) -> np.ndarray:
        """Of a shard's terms their numbers in this vocabulary, or -1."""
        get = self.vocabulary.get
        return np.array([get(t, -1) for t in terms.split(b" ")], dtype=np.int64)


def part(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds for each unit of its weight."""
    m = 75 + 25 * length * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Best:
    """The k best hits of a query so far; ``least`` is the score that a document must reach, and ties count."""

    __slots__ = ("ids", "nulls", "scores", "least")

    def __init__(self):
        self.ids, self.nulls, self.scores, self.least = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), 1

    def add(self, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray, k: int) -> None:
        good = scores >= self.least
        ids, nulls, scores = np.r_[self.ids, ids[good]], np.r_[self.nulls, nulls[good]], np.r_[self.scores, scores[good]]
        if len(scores) > k:
            keep = np.lexsort((ids, nulls, -scores))[:k]
            ids, nulls, scores = ids[keep], nulls[keep], scores[keep]
        self.ids, self.nulls, self.scores = ids, nulls, scores
        if len(scores) == k:
            self.least = int(scores.min())


class Shard:
    """What a shard has of the queries' terms: documents with scores per term, and bounds per term of their ranges."""

    def __init__(self, batch: pa.RecordBatch, at: int, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs = batch.column(0)[at].as_py()
        ids, nulls, lengths, terms, doc_starts, doc_terms, doc_tfs, block_starts, block_terms, block_tfs, block_lengths = [c[at].as_buffer() for c in batch.columns[1:]]
        self.ids, self.nulls, terms = np.frombuffer(ids, dtype="<i8"), np.frombuffer(nulls, dtype=bool), terms.to_pybytes()
        number, small = queries.numbers(terms), lambda b, some=slice(None): np.frombuffer(b, dtype="<i4")[some].astype(np.int64)
        self.terms, self.starts, inside = self._asked(number, np.frombuffer(doc_terms, dtype="<i4"), np.frombuffer(doc_starts, dtype="<i8"))
        length = np.repeat(small(lengths), np.diff(self.starts))
        self.scores = weights[self.terms] * part(small(doc_tfs, inside), length, n_docs, n_terms)
        # Bounds stand by term, so that a query reads those of its own terms only.
        self.n_blocks = -(-self.n_docs // BLOCK)
        found, starts, inside = self._asked(number, np.frombuffer(block_terms, dtype="<i4"), np.frombuffer(block_starts, dtype="<i8"))
        block = np.repeat(np.arange(self.n_blocks), np.diff(starts))
        bounds = weights[found] * part(small(block_tfs, inside), small(block_lengths, inside), n_docs, n_terms)
        by_term = np.argsort(found, kind="stable")
        self.block, self.bounds = block[by_term], bounds[by_term].astype(float)
        self.of_term = np.searchsorted(found[by_term], np.arange(len(weights) + 1))

    @staticmethod
    def _asked(number: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked terms' numbers, where each range starts among them, which entries they are)."""
        numbers = number[terms]
        inside = np.nonzero(numbers >= 0)[0]
        return numbers[inside], np.searchsorted(inside, starts), inside

    def improve(self, best: Best, words: np.ndarray, times: np.ndarray, wanted: np.ndarray, k: int) -> int:
        """Put the shard's documents among the best so far; ``wanted`` is a vector of zeros over the vocabulary to work in. Gives the number of documents scored."""
        first, stop = self.of_term[words], self.of_term[words + 1]
        entries = _ranges(first, stop)
        bounds = np.bincount(self.block[entries], weights=self.bounds[entries] * np.repeat(times, stop - first), minlength=self.n_blocks)
        # Sums beyond 2 ** 53 are rounded, so bounds are raised by more than that.
        bounds = np.where(bounds > 0, bounds * (1 + 1e-9) + 1, 0)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        wanted[words] = times
        at, step, scored = 0, FIRST_BLOCKS, 0
        while at < len(order) and bounds[order[at]] >= best.least:
            some = order[at : at + step]
            some = some[bounds[some] >= best.least]
            docs = _ranges(some * BLOCK, np.minimum(some * BLOCK + BLOCK, self.n_docs))
            start, end = self.starts[docs], self.starts[docs + 1]
            entries = _ranges(start, end)
            sums = np.r_[0, np.cumsum(self.scores[entries] * wanted[self.terms[entries]])]
            ends = np.cumsum(end - start)
            best.add(self.ids[docs], self.nulls[docs], sums[ends] - sums[ends - (end - start)], k)
            scored += len(docs)
            at, step = at + step, 2 * step
        wanted[words] = 0
        return scored


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES, counts: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each of ``queries`` (item_id, text).

    ``counts`` may name two accumulators: documents that were scored, and all documents times all queries.
    """
    spark = docs.sparkSession
    index = build_index(docs, shard_bytes)
    number = lambda column: F.coalesce(F.sum(column), F.lit(0))
    n_docs, n_terms, n_shards = index.agg(number("n_docs"), number("n_terms"), F.count("*")).first()
    queries = queries.select("item_id", F.col("text").cast("binary").alias("text"))
    n_blocks = queries.agg(number(F.octet_length("text"))).first()[0] // query_bytes + 1
    hits = None
    for nth in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == nth).collect()  # query_bytes of text, about
        found = stored(_search_block(spark, index, Queries(rows), queries.schema["item_id"].dataType, n_docs, n_terms, n_shards, k, counts), "hits")
        hits = found if hits is None else hits.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, index: DataFrame, queries: Queries, id_type, n_docs: int, n_terms: int, n_shards: int, k: int, counters: tuple[Accumulator, Accumulator] | None) -> DataFrame:
    shared = spark.sparkContext.broadcast(queries)  # a block of queries, of bounded bytes

    def make_counts():
        own = shared.value

        def rows(batch):
            for terms, dfs in batch:
                number = own.numbers(terms)
                asked = np.nonzero(number >= 0)[0]
                yield from zip(number[asked].tolist(), np.frombuffer(dfs, dtype="<i4")[asked].tolist())

        return rows

    found = map_rows(index.select("terms", "dfs"), "term int, n long", make_counts).groupBy("term").agg(F.sum("n").alias("n"))
    found = np.array(found.collect(), dtype=np.int64).reshape(-1, 2)  # at most the block's vocabulary
    df = np.zeros(len(queries.vocabulary), dtype=np.int64)
    df[found[:, 0]] = found[:, 1]
    weights = spark.sparkContext.broadcast(weight(n_docs, df))
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best, wanted, scored = [Best() for _ in own.ids], np.zeros(len(own.vocabulary), dtype=np.int64), 0
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(batch, at, own, weights.value, n_docs, n_terms)
                scored += sum(shard.improve(b, words, times, wanted, k) for b, (words, times) in zip(best, own.terms))
                if counters is not None:
                    counters[1].add(shard.n_docs * len(best))
        if counters is not None:
            counters[0].add(scored)
        for start in range(0, len(best), 1024):
            some = best[start : start + 1024]
            sizes = np.array([len(b.ids) for b in some])
            if sizes.sum():
                ids = pa.array(own.ids[start : start + 1024], type=arrow_id).take(pa.array(np.repeat(np.arange(len(some)), sizes)))
                doc_ids = pa.array(np.concatenate([b.ids for b in some]), mask=np.concatenate([b.nulls for b in some]))
                yield pa.RecordBatch.from_arrays([ids, doc_ids, pa.array(np.concatenate([b.scores for b in some]))], names=["item_id", "doc_id", "score"])

    # A task merges its shards' hits, and reads a bounded number of shards, so that a lost task is soon repeated.
    few = index.drop("shard", "n_terms", "dfs").coalesce(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-n_shards // SHARDS_PER_TASK)))
    return few.mapInArrow(run, f"item_id {id_type.simpleString()}, doc_id long, score long")


def op13_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every item of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM found GROUP BY doc_id, t),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM dl),
qf AS (SELECT item_id, t, count(*) AS qf FROM asked GROUP BY item_id, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, stats GROUP BY t, docs),
scored AS (
  SELECT item_id, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM qf JOIN w USING (t) JOIN tf USING (t) JOIN dl USING (doc_id), stats GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= {TOP}
"""
