"""Exact top-k search by BM25 over an inverted index with block-max WAND pruning.

Each task reads its part of the documents into shards of bounded size and writes each shard's
inverted index as one row: no text is shuffled. Document frequencies, the number of documents
and their mean length are summed over all shards, so every shard scores with global statistics
and the shards' top k merge exactly.

A task's shards raise the k-th best score for one another, and the task passes on its k best only.

Within a shard documents are numbered so that alike ones stand together. A query's terms are
parted at a pivot into the frequent ones, whose lists are long and whose weights are small, and
the others. The frequent ones have maxima over blocks of document numbers that are the same for
all terms; in so small blocks the others' maxima would be nearly as many as their postings. The
others' postings are scored, and a document is given up if these and its block's maxima of the
frequent terms fall short of the k-th best score so far; only for documents that pass, best
limits first, are the frequent terms' postings looked up. ``Best`` counts the postings that are
scored and those that all documents would have needed.

Queries of the same text are searched once. They come in blocks of bounded bytes; each is broadcast and runs against all shards.

Defined results: words are those of the lower-cased (A-Z) text; a null text has none but counts
as a document; only documents that share a word with the query are found; a document is no hit
of itself; scores are rounded to six decimals and ties go to the smaller doc_id, null first;
repeated rows are hits of their own; a query that repeats a doc_id has the rows' words together;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import LARGE_ROWS, ship, stored, table

K1, B = 1.2, 0.75
TOP = 10
#: Bytes of text in a shard, of queries in a block, documents in a block of postings.
SHARD_BYTES, QUERY_BYTES, BLOCK = 16 << 20, 16 << 20, 4
#: The pivot: a word that at least one document in so many of a shard has is looked up for documents that pass only.
FREQUENT = 12
#: Tasks that search, for each core of the cluster; shards that a task reads at most, about.
TASKS_PER_CORE, SHARDS_PER_TASK = 3, 8
#: Queries whose bounds are found by one matrix product.
TOGETHER = 256
#: Rounding of scores; bounds are compared with this slack.
DECIMALS, EPSILON = 6, 1e-5
#: Bounds of the frequent words are sums of short floats, and raised by more than these can be off.
ABOVE = 1 + 1e-4
NO_ID = -(1 << 63)

INDEX = "shard string, n_docs long, n_words long, doc_ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at the contract's white space


def build_shard(name: str, rows: list[tuple]) -> tuple:
    """One row of the index from (doc_id, words) rows; documents are numbered by their most shared word, then by length."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    flat = np.array([number[w] for _, words in rows for w in words], dtype=np.int64)
    ids = np.array([r[0] if r[0] is not None else NO_ID for r in rows], dtype="<i8")
    lengths = np.array([len(words) for _, words in rows], dtype="<i4")
    n_docs = max(1, len(rows))
    keys, tfs = np.unique(flat * n_docs + np.repeat(np.arange(len(rows), dtype=np.int64), lengths), return_counts=True)
    terms, docs = np.divmod(keys, n_docs)
    likeness, filled = np.full(len(rows), -1, dtype=np.int64), np.nonzero(lengths)[0]
    if len(filled):
        shared = np.bincount(terms)[flat] * len(number) + flat
        likeness[filled] = np.maximum.reduceat(shared, (np.cumsum(lengths, dtype=np.int64) - lengths)[filled]) % len(number)
    order = np.lexsort((ids, lengths, likeness))
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.arange(len(rows))
    docs = place[docs]
    sort = np.argsort(terms * n_docs + docs)
    ids, lengths, docs, tfs = ids[order], lengths[order], docs[sort], tfs[sort]
    starts = np.searchsorted(terms, np.arange(len(number) + 1)).astype("<i8")
    return (
        name, len(rows), int(lengths.sum()), ids.tobytes(), lengths.tobytes(), b" ".join(number), starts.tobytes(), docs.astype("<i4").tobytes(), tfs.astype("<i4").tobytes()
    )


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    ship(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            return pa.RecordBatch.from_pylist([dict(zip(target.names, build_shard(f"{partition}-{n}", rows)))], schema=target)

        for batch in batches:
            texts = batch.column(1)
            for at, doc_id in enumerate(batch.column(0).to_pylist()):
                words = words_of(texts[at].as_py())
                rows.append((doc_id, words))
                size += sum(map(len, words)) + len(words) + 64
                if size >= shard_bytes:
                    yield row()
                    n, rows, size = n + 1, [], 0
        if rows:
            yield row()

    return stored(docs.select("doc_id", "text").mapInArrow(run, INDEX), "inverted-index", **LARGE_ROWS)


class QueryBlock:
    """Some queries: their ids, and their words as numbers of the block's vocabulary, with how often they occur.

    ``shared`` says of each whether several queries have its words.
    """

    def __init__(self, rows: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}
        self.queries, self.shared = [], [shared for _, _, shared in rows]
        for query_id, text, _ in rows:
            counts = Counter(words_of(text))
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in counts], dtype=np.int64)
            self.queries.append((query_id, words, np.array(list(counts.values()), dtype=float)))
        self.idf = np.zeros(len(self.vocabulary))

    def numbers(self, terms: bytes) -> np.ndarray:
        """Of a shard's terms their numbers in this block's vocabulary, or -1."""
        get = self.vocabulary.get
        return np.array([get(t, -1) for t in terms.split(b" ")] if terms else [], dtype=np.int64)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all the half-open ranges, one after the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Best:
    """The k best hits of a query so far, the document ``own`` left out; ``least`` is the score that a document must reach.

    ``scored`` of ``asked`` postings were read to find them; both count where ``counting`` is wanted.
    """

    __slots__ = ("k", "own", "ids", "scores", "least", "scored", "asked", "counting")

    def __init__(self, k: int, own: int | None = None, counting: bool = False):
        self.k, self.own, self.ids, self.scores, self.least, self.scored, self.asked, self.counting = k, own, np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 0, counting

    def enough(self) -> float:
        """What a score has to be above to be among the best, with slack for rounding."""
        return max(0.0, self.least - EPSILON)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take these documents' scores, those that are high enough."""
        good = scores > self.enough()
        if self.own is not None:
            good &= ids != self.own
        if not good.any():
            return
        ids, scores = np.concatenate((self.ids, ids[good])), np.concatenate((self.scores, scores[good].round(DECIMALS)))
        if len(scores) > self.k:
            keep = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[keep], scores[keep]
        self.ids, self.scores = ids, scores
        if len(scores) == self.k:
            self.least = scores.min()


class Shard:
    """A shard's postings of the words that a block of queries asks for.

    The frequent words' postings stand in rows by document, to be looked up, with block maxima; the others' in lists.
    """

    def __init__(self, row: tuple, block: QueryBlock, mean_length: float):
        _, n_docs, _, ids, lengths, terms, starts, docs, tfs = row
        self.ids, self.n_docs = np.frombuffer(ids, dtype="<i8"), n_docs
        norm = K1 * (1 - B + B * np.frombuffer(lengths, dtype="<i4") / mean_length)
        number, starts = block.numbers(terms), np.frombuffer(starts, dtype="<i8")
        asked = np.nonzero(number >= 0)[0]
        frequent = np.diff(starts)[asked] * FREQUENT >= n_docs
        n_frequent, asked = int(frequent.sum()), np.concatenate((asked[frequent], asked[~frequent]))
        words, sizes = number[asked], starts[asked + 1] - starts[asked]
        picked = _ranges(starts[asked], starts[asked + 1])
        docs = np.frombuffer(docs, dtype="<i4")[picked].astype(np.int64)
        tf = np.frombuffer(tfs, dtype="<i4")[picked].astype(float)
        impact = np.repeat(block.idf[words] * (K1 + 1), sizes) * tf / (tf + norm[docs])
        self.sizes = np.zeros(len(block.vocabulary), dtype=np.int64)
        self.sizes[words] = sizes

        inside = int(sizes[:n_frequent].sum())
        self.rows = np.full(len(block.vocabulary), -1)
        self.rows[words[:n_frequent]] = np.arange(n_frequent)
        self.by_doc = np.zeros((n_docs, n_frequent))
        self.by_doc[docs[:inside], np.repeat(np.arange(n_frequent), sizes[:n_frequent])] = impact[:inside]
        self.short = self.by_doc.astype(np.float32)
        self.row_most = np.maximum.reduceat(self.short, np.arange(0, n_docs, BLOCK), axis=0).T.copy()

        self.docs, self.impact = docs[inside:], impact[inside:]
        self.first, self.stop = np.zeros((2, len(block.vocabulary)), dtype=np.int64)
        self.stop[words[n_frequent:]] = ends = np.cumsum(sizes[n_frequent:])
        self.first[words[n_frequent:]] = ends - sizes[n_frequent:]

    def improve(self, best: list[Best], queries: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Put the shard's documents among the best so far of each query."""
        for start in range(0, len(queries), TOGETHER):
            part = queries[start : start + TOGETHER]
            weights = np.zeros((len(part), len(self.row_most)), dtype=np.float32)
            for i, (_, words, times) in enumerate(part):
                rows = self.rows[words]
                weights[i, rows[rows >= 0]] = times[rows >= 0]
            row_bounds = (weights @ self.row_most).astype(float) * ABOVE
            for found, (_, words, times), bounds, weight in zip(best[start : start + TOGETHER], part, row_bounds, weights):
                self._improve(found, words, times, bounds, weight)

    def _improve(self, best: Best, words: np.ndarray, times: np.ndarray, row_bounds: np.ndarray, weights: np.ndarray) -> None:
        starts, stops = self.first[words], self.stop[words]
        postings = _ranges(starts, stops)
        score = np.bincount(self.docs[postings], weights=self.impact[postings] * np.repeat(times, stops - starts), minlength=len(row_bounds) * BLOCK)
        limit = (score.reshape(-1, BLOCK) + row_bounds[:, None]).ravel()[: self.n_docs]
        left = np.nonzero(limit > best.enough())[0]
        if best.counting:
            best.asked += int(self.sizes[words].sum())
            best.scored += len(postings)
        few = 8 * best.k
        if len(best.scores) < best.k and len(left) > few:  # the likeliest alone first, for a score to beat
            likely = np.argpartition(-limit[left], few)
            self._look_up(best, left[likely[:few]], score, weights)
            left = left[likely[few:]]
            left = left[limit[left] > best.enough()]
        if len(left):
            self._look_up(best, left, score, weights)

    def _look_up(self, best: Best, some: np.ndarray, score: np.ndarray, weights: np.ndarray) -> None:
        """Add the frequent words to the scores of some documents: by short floats first, exactly where these let them pass."""
        found = self.short[some]
        best.scored += int(np.count_nonzero(found[:, weights > 0])) if best.counting else 0
        limit = score[some] + (found @ weights) * ABOVE
        step = 4 * best.k
        while len(some := some[passing := limit > best.enough()]):  # the likeliest first: what they score spares others
            limit = limit[passing]
            at = np.argpartition(-limit, step)[:step] if len(some) > step else slice(None)
            best.add(self.ids[some[at]], score[some[at]] + self.by_doc[some[at]] @ weights)
            limit[at], step = -1.0, 4 * step


def one_of_each(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, text, copies: one row for all queries of the same text, whose ids are in ``copies``.

    The rows of a repeated id have their words together. A query whose id several documents have stands alone, since it leaves out all of them.
    """
    whole = queries.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    several = docs.select(F.col("doc_id").alias("query_id")).join(queries.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1")
    alone = whole.join(several, "query_id", "left").withColumn("alone", F.when(F.col("n").isNotNull(), F.col("query_id")))
    return alone.groupBy("text", "alone").agg(F.min("query_id").alias("query_id"), F.collect_list("query_id").alias("copies")).select("query_id", "text", "copies")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES, counts: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents for each row of ``queries`` (query_id, text).

    ``counts`` may name two accumulators: postings that were scored, and those that all documents would have needed.
    """
    spark = docs.sparkSession
    index = build_index(docs, shard_bytes)
    n_docs, n_words, n_shards = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    queries = stored(one_of_each(queries.where("query_id is not null").select("query_id", "text"), docs), "queries")
    size = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = size // query_bytes + 1
    hits = None
    for number in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == number)
        block = QueryBlock(part.select("query_id", "text", F.size("copies") > 1).collect())  # query_bytes of text, about
        found = _search_block(spark, index, block, n_docs, n_words / n_docs if n_words else 1.0, n_shards, k, counts)
        found = stored(found, "hits")
        hits = found if hits is None else hits.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    rank = F.row_number().over(order)
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= k + 1).join(queries.select("query_id", "copies"), "query_id")
    hits = hits.select(F.explode("copies").alias("query_id"), "doc_id", "score").where("not (doc_id <=> query_id)")
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, index: DataFrame, block: QueryBlock, n_docs: int, mean_length: float, n_shards: int, k: int, counters: tuple[Accumulator, Accumulator] | None) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)  # a block of queries, of bounded bytes

    # A task merges its shards' counts and hits, and reads a bounded number of shards, so that a lost task is soon repeated.
    n_tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-n_shards // SHARDS_PER_TASK))

    def count_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n = np.zeros(len(own.vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, starts in zip(*batch.columns):
                number = own.numbers(terms.as_py())
                asked = np.nonzero(number >= 0)[0]
                n[number[asked]] += np.diff(np.frombuffer(starts.as_py(), dtype="<i8"))[asked]
        found = np.nonzero(n)[0].astype(np.int32)
        for start in range(0, len(found), 1 << 16):
            part = found[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], names=["term", "n"])

    counts = index.select("terms", "starts").coalesce(n_tasks).mapInArrow(count_docs, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.array(counts.collect(), dtype=np.int64).reshape(-1, 2)  # at most the block's vocabulary
    df = np.zeros(len(block.vocabulary))
    df[found[:, 0]] = found[:, 1]
    idf = spark.sparkContext.broadcast(np.log(1 + (n_docs - df + 0.5) / (df + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.idf = idf.value
        # What queries share leaves none of their documents out, but has a hit more.
        best = [Best(k + shared, None if shared else q[0], counters is not None) for q, shared in zip(own.queries, own.shared)]
        for batch in batches:
            for at in range(batch.num_rows):
                row = tuple(c[at].as_py() for c in batch.columns)
                Shard(row, own, mean_length).improve(best, own.queries)
        if counters is not None:
            counters[0].add(sum(b.scored for b in best))
            counters[1].add(sum(b.asked for b in best))
        for start in range(0, len(best), 1024):
            part = [(q[0], d if d != NO_ID else None, s) for q, b in zip(own.queries[start : start + 1024], best[start : start + 1024]) for d, s in zip(b.ids.tolist(), b.scores.tolist())]
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*part), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])

    return index.coalesce(n_tasks).mapInArrow(run, "query_id long, doc_id long, score double")


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose doc_id is divisible by 100, by its whole text."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, queries)


OP2_SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM words GROUP BY doc_id, w),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents)::DOUBLE AS mean_dl),
idf AS (SELECT w, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, stats GROUP BY w, n),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * {K1 + 1}::DOUBLE / (d.tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * dl / mean_dl))), {DECIMALS}) AS score
  FROM tf q JOIN tf d ON q.w = d.w JOIN idf ON idf.w = q.w JOIN dl ON dl.doc_id = d.doc_id, stats
  WHERE q.doc_id % 100 = 0 AND d.doc_id <> q.doc_id GROUP BY q.doc_id, d.doc_id)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= {TOP}
"""
