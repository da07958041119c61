"""Approximate nearest neighbours by cosine: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of the rows; every row then descends it to one leaf, and
rows are stored by contiguous ranges of leaves. Equal vectors are one row with the few smallest ids that any
answer can need, so a vector that a third of all rows share weighs nothing.

A query takes the tree's nodes from a priority queue, nearest centre first: an inner node puts
its children into the queue, a leaf is visited. How many leaves are visited is calibrated: for a bounded sample of
the queries the exact neighbours among all rows are found, and visits widen until the leaves that
they reach hold ``RECALL`` of those; a query whose leaves have too few rows widens further on its own.

Queries run in blocks of bounded bytes. A block's queries are near each other in the tree, and only the
folders with leaves that it visits are read; each task keeps the best of each query. Candidates by a
fast product are scored again, in an order of summation that is the same for equal vectors, so ties are ties.

Defined results: vectors that are null, zero, of another length than most usable ones have, or hold null or non-finite
components take no part; a row is no candidate of itself, but equal rows and rows that share its
id are; ties go to the smaller vec_id, null last (the largest 64-bit integer counts as null); rows that share a vec_id divisible by the
step are queries of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import join_counted, lowest, new_path, ship, stored, table

K, STEP, RECALL = 5, 50, 0.95
#: Rows, and bytes, of the sample that the tree is fitted on; queries of the calibration.
SAMPLE, SAMPLE_BYTES, CALIBRATION = 32_768, 64 << 20, 256
#: Children of a node, sampled vectors that a leaf has at most unless they can't be parted, rounds of k-means.
BRANCHING, LEAF, ROUNDS, SEED = 8, 32, 8, 11
#: Bytes of a block of queries, and of a folder of the index, about.
QUERY_BYTES, FOLDER_BYTES = 16 << 20, 64 << 20
NO_ID = (1 << 63) - 1
#: By so much a fast product may be off.
SLACK = 1e-9


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, initial=0))[1][:, None])


def norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def unit(matrix: np.ndarray) -> np.ndarray:
    matrix = scaled(matrix)
    sizes = norms(matrix)[:, None]
    return matrix / np.where(sizes == 0, 1, sizes)


class Tree:
    """Centres of all nodes; the children of a node stand together. Node 0 is the root; leaves are numbered so that near ones have near numbers."""

    def __init__(self, points: np.ndarray, branching: int = BRANCHING, leaf: int = LEAF, seed: int = SEED):
        random = np.random.default_rng(seed)
        centers, self.children, self.leaf = [np.zeros(points.shape[1])], {}, {}
        waiting = [(0, np.arange(len(points)))]
        self.weights = []
        while waiting:  # depth first, so that leaves of a branch have neighbouring numbers
            node, inside = waiting.pop()
            groups = self._parts(points[inside], branching, random) if len(inside) > leaf else []
            if len(groups) < 2:
                self.leaf[node] = len(self.leaf)
                self.weights.append(max(1, len(inside)))
                continue
            first = len(centers)
            self.children[node] = (first, first + len(groups))
            for number, (center, members) in enumerate(groups):
                centers.append(center)
                waiting.append((first + number, inside[members]))
        self.centers = np.array(centers)

    @staticmethod
    def _parts(points: np.ndarray, branching: int, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        """(centre, members) of the clusters by spherical k-means."""
        centers = points[random.choice(len(points), min(branching, len(points)), replace=False)]
        for _ in range(ROUNDS):
            own = np.argmax(points @ centers.T, axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, points)
            alive = np.bincount(own, minlength=len(centers)) > 0
            centers = unit(sums[alive])
        own = np.argmax(points @ centers.T, axis=1)
        return [(centers[c], np.nonzero(own == c)[0]) for c in np.unique(own)]

    def __len__(self) -> int:
        return len(self.leaf)

    def descend(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point comes to by always taking the nearest child."""
        found, waiting = np.zeros(len(points), dtype=np.int32), [(0, np.arange(len(points)))]
        while waiting:
            node, inside = waiting.pop()
            if node in self.leaf:
                found[inside] = self.leaf[node]
                continue
            first, stop = self.children[node]
            own = np.argmax(points[inside] @ self.centers[first:stop].T, axis=1)
            waiting += [(first + c, inside[own == c]) for c in np.unique(own)]
        return found

    def traverse(self, nearness: np.ndarray) -> Iterator[int]:
        """Leaves best bin first, given a query's nearness to all centres."""
        nearness, queue = nearness.tolist(), [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node in self.leaf:
                yield self.leaf[node]
            else:
                for child in range(*self.children[node]):
                    heapq.heappush(queue, (-nearness[child], child))

    def visits(self, points: np.ndarray, n: int, rows: np.ndarray, least: int) -> np.ndarray:
        """Per point a bit for each leaf: the first ``n`` ones, and more until they have ``least`` of the ``rows`` that leaves have."""
        found = np.zeros((len(points), len(self)), dtype=bool)
        for start in range(0, len(points), 256):
            for i, nearness in enumerate(points[start : start + 256] @ self.centers.T, start):
                seen = have = 0
                for leaf in self.traverse(nearness):
                    if seen >= n and have >= least:
                        break
                    found[i, leaf] = True
                    seen, have = seen + 1, have + int(rows[leaf])
        return np.packbits(found, axis=1)


def matrix_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have usable vectors, these vectors)."""
    whole = np.nonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)[0]
    flat = column.take(pa.array(whole)).flatten()
    found = flat.to_numpy(zero_copy_only=False).reshape(len(whole), dim)
    good = np.isfinite(found).all(axis=1) & (found != 0).any(axis=1)
    return whole[good], found[good] + 0.0  # no -0.0, which would make equal vectors differ


def dimension(rows: DataFrame) -> int | None:
    """The length that most usable vectors have, the larger of equally frequent ones."""
    x = F.col("embedding")
    usable = F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    found = rows.where(usable).groupBy(F.size(x).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return found and found["dim"]


class Search:
    """The rows of an index, and how queries run against it."""

    def __init__(self, rows: DataFrame, k: int = K, sample: int = SAMPLE, leaf: int = LEAF, folder_bytes: int = FOLDER_BYTES):
        self.spark, self.k = rows.sparkSession, k
        ship(self.spark)
        self.rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        self.kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
        self.dim = dimension(self.rows)
        if self.dim is None:
            return
        self.tree = self._fit(min(sample, max(1, SAMPLE_BYTES // (8 * self.dim))), leaf)
        self._store(folder_bytes)

    def _fit(self, sample: int, leaf: int) -> Tree:
        found = lowest(self.rows.where(F.size("embedding") == self.dim), sample, "vec_id", "embedding").select("embedding").toArrow()["embedding"]
        found = matrix_of(found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found, self.dim)[1]
        return Tree(unit(np.unique(found, axis=0).astype(float)), leaf=leaf)

    def _in_leaves(self, rows: DataFrame) -> DataFrame:
        """vec_id, leaf, vector (its bytes) of the usable rows; equal vectors of a batch are one row with ``ids``, at most k + 1 of them."""
        shared, dim, kind, most = self.spark.sparkContext.broadcast(self.tree), self.dim, self.kind, self.k + 1  # of bounded size, as the sample is

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which, matrix = matrix_of(batch.column(1), dim)
                if not len(which):
                    continue
                matrix = np.ascontiguousarray(matrix, dtype=kind)
                ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)[which]
                keys, first, own = np.unique(matrix.view(f"V{matrix.itemsize * dim}").ravel(), return_index=True, return_inverse=True)
                order = np.lexsort((ids, own))
                starts = np.searchsorted(own[order], np.arange(len(keys) + 1))
                nth = np.arange(len(ids)) - starts[own[order]]
                order = order[nth < most]
                offsets = np.searchsorted(own[order], np.arange(len(keys) + 1)).astype(np.int32)
                leaves = shared.value.descend(unit(matrix[first].astype(float)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves), pa.array([k.tobytes() for k in keys], type=pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[order]))], names=["leaf", "vector", "ids"]
                )

        return rows.mapInArrow(run, "leaf int, vector binary, ids array<long>")

    def _store(self, folder_bytes: int) -> None:
        """Write the rows by folders of neighbouring leaves; a leaf that is larger than a folder takes several."""
        weights = np.array(self.tree.weights, dtype=float)
        size = self.rows.count() * (self.dim * int(self.kind[-1]) + 16)
        folders = max(2 * self.spark.sparkContext.defaultParallelism, size // folder_bytes)
        share = weights / weights.sum() * folders
        pieces = np.maximum(1, np.floor(share)).astype(int)
        start = np.floor(np.cumsum(share) - share + 1e-9).astype(int)
        self.folders = [set(range(a, a + n)) for a, n in zip(start.tolist(), pieces.tolist())]
        of_leaf = self.spark.createDataFrame(list(zip(range(len(self.tree)), start.tolist(), pieces.tolist())), "leaf int, start int, pieces int")
        tagged = self._in_leaves(self.rows).join(F.broadcast(of_leaf), "leaf")  # a row per leaf
        tagged = tagged.withColumn("folder", (F.col("start") + F.pmod(F.xxhash64("vector"), F.col("pieces"))).cast("int"))
        ids = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, self.k + 1)
        # Folders are dealt first, so the aggregation needs no shuffle of its own; copies were put together where they were read.
        found = tagged.repartition("folder").groupBy("folder", "leaf", "vector").agg(ids.alias("ids")).sortWithinPartitions("folder", "leaf")
        path = new_path(self.spark, "kmeans-tree")
        found.write.partitionBy("folder").parquet(path)
        self.index = self.spark.read.schema("leaf int, vector binary, ids array<long>, folder int").parquet(path)
        self.sizes = np.zeros(len(self.tree), dtype=np.int64)
        for leaf, n in self.index.groupBy("leaf").agg(F.sum(F.size("ids"))).collect():  # a row per leaf
            self.sizes[leaf] = n

    def _best(self, matrix: np.ndarray, numbers: np.ndarray, visits: np.ndarray, counts: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
        """number, vec_id, score, same, leaf: the k + 1 best rows of the visited leaves for each query that each task finds. ``same`` rows have the query's very vector."""
        k, dim, kind = self.k + 1, self.dim, self.kind
        shared = self.spark.sparkContext.broadcast((matrix, numbers, visits))  # a block of queries, of bounded bytes
        asked = np.unpackbits(np.bitwise_or.reduce(visits, axis=0), count=len(self.tree)).astype(bool)
        folders = sorted(set().union(*[self.folders[leaf] for leaf in np.nonzero(asked)[0]]))
        every = sorted(set().union(*self.folders))
        rows = self.index if folders == every else self.index.where(F.col("folder").isin(folders))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, numbers, visits = shared.value
            matrix = matrix.astype(float)
            wide = scaled(matrix)
            sizes, best = norms(wide), Best(len(matrix), k)
            units, scored, met = wide / sizes[:, None], 0, 0
            for batch in batches:
                leaves = batch.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(leaves, kind="stable")
                values = np.frombuffer(b"".join(batch.column(1).take(pa.array(order)).to_pylist()), dtype=kind).reshape(len(order), dim).astype(float)
                lists = batch.column(2).take(pa.array(order))
                starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
                ids, own = lists.flatten().to_numpy(zero_copy_only=False), scaled(values)
                own_sizes = norms(own)
                edges = np.nonzero(np.diff(leaves[order], prepend=-1))[0]
                for first, stop in zip(edges, np.r_[edges[1:], len(order)]):
                    leaf = int(leaves[order[first]])
                    who = np.nonzero(visits[:, leaf >> 3] >> (7 - (leaf & 7)) & 1)[0]
                    met += (stop - first) * len(matrix)
                    scored += (stop - first) * len(who)
                    for at in range(0, len(who), 512):
                        for part in range(first, stop, 4096):
                            some, end = who[at : at + 512], min(part + 4096, stop)
                            fast = units[some] @ (own[part:end] / own_sizes[part:end, None]).T
                            limit = best.least[some]
                            if fast.shape[1] > k:
                                limit = np.maximum(limit, np.partition(fast, fast.shape[1] - k, axis=1)[:, -k])
                            q, r = np.nonzero(fast >= limit[:, None] - SLACK)
                            q, r = some[q], r + part
                            score = (wide[q] * own[r]).sum(axis=1) / (sizes[q] * own_sizes[r])
                            copies = starts[r + 1] - starts[r]
                            nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                            same = (matrix[q] == values[r]).all(axis=1)
                            best.add(np.repeat(q, copies), ids[np.repeat(starts[r], copies) + nth], np.repeat(score, copies), np.repeat(same, copies), leaf)
            if counts is not None:
                counts[0].add(int(scored))
                counts[1].add(int(met))
            q, columns = best.rows()
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (numbers[q], *columns)], names=["number", "vec_id", "score", "same", "leaf"])

        return rows.mapInArrow(run, "number long, vec_id long, score double, same boolean, leaf int")

    def _merged(self, hits: DataFrame) -> DataFrame:
        """number, hits: of each query the k + 1 best over all tasks, as an array of structs in order."""
        struct = F.struct((-F.col("score")).alias("less"), "vec_id", "same", "leaf")
        return hits.groupBy("number").agg(F.slice(F.sort_array(F.collect_list(struct)), 1, self.k + 1).alias("hits"))  # at most k + 1 of each task

    def _queries(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(vec_id, vector of all usable query rows; number, vector, leaf, n of the different vectors among them)."""
        own = self._in_leaves_whole(rows)
        own = stored(own, "queries")
        each = own.groupBy("vector").agg(F.first("leaf").alias("leaf"), F.count("*").alias("n"))
        return own, stored(each.withColumn("number", F.monotonically_increasing_id()), "query-vectors")

    def _in_leaves_whole(self, rows: DataFrame) -> DataFrame:
        """vec_id, leaf, vector of every usable row."""
        shared, dim, kind = self.spark.sparkContext.broadcast(self.tree), self.dim, self.kind  # of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which, matrix = matrix_of(batch.column(1), dim)
                if len(which):
                    matrix = np.ascontiguousarray(matrix, dtype=kind)
                    vectors = pa.array([row.tobytes() for row in matrix], type=pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(shared.value.descend(unit(matrix.astype(float)))), vectors], names=["vec_id", "leaf", "vector"])

        return rows.mapInArrow(run, "vec_id long, leaf int, vector binary")

    def calibrate(self, vectors: DataFrame, recall: float = RECALL, n: int = CALIBRATION) -> int:
        """How many leaves the queries of a sample must visit to reach ``recall`` of their exact neighbours among all rows."""
        rows = lowest(vectors.select("vector"), n, "vector").collect()
        matrix = np.frombuffer(b"".join(bytes(r[0]) for r in rows), dtype=self.kind).reshape(len(rows), self.dim)
        whole = np.packbits(np.ones((len(rows), len(self.tree)), dtype=bool), axis=1)
        exact = self._merged(self._best(matrix, np.arange(len(rows)), whole)).select("number", F.explode("hits").alias("h")).select("number", "h.leaf", "h.same").collect()
        order, nearness = {}, unit(matrix.astype(float)) @ self.tree.centers.T
        for number in range(len(rows)):
            order[number] = {leaf: place for place, leaf in enumerate(self.tree.traverse(nearness[number]), 1)}
        # The query's own row is found at once, so it says nothing.
        places = np.array(sorted(order[r["number"]][r["leaf"]] for r in exact if not r["same"]))
        return int(places[int(np.ceil(recall * len(places))) - 1]) if len(places) else len(self.tree)

    def run(self, queries: DataFrame, recall: float = RECALL, query_bytes: int = QUERY_BYTES, counts: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
        """query_id, rank, vec_id, score of every usable row of ``queries`` (vec_id, embedding), which are rows of the index too."""
        empty = self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        if self.dim is None:
            return empty
        own, vectors = self._queries(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
        n = vectors.count()
        if not n:
            return empty
        visited = stored(self._visiting(vectors, self.calibrate(vectors, recall)), "visits")
        # Blocks of neighbouring leaves read few folders; a leaf with more queries than a block is parted by hash.
        each = self.dim * int(self.kind[-1]) + (len(self.tree) + 7) // 8 + 8
        n_blocks, hits = max(1, -(-n * each // query_bytes)), None
        if n_blocks > 1:
            by_leaf = dict(vectors.groupBy("leaf").count().collect())  # a row per leaf
            share = np.array([by_leaf.get(leaf, 0) for leaf in range(len(self.tree))]) / n * n_blocks
            start, pieces = np.floor(np.cumsum(share) - share + 1e-9).astype(int), np.maximum(1, np.floor(share)).astype(int)
            place = self.spark.createDataFrame(list(zip(range(len(self.tree)), start.tolist(), pieces.tolist())), "leaf int, start int, pieces int")
            visited = visited.join(F.broadcast(place), "leaf").withColumn("block", (F.col("start") + F.pmod(F.xxhash64("vector"), F.col("pieces"))).cast("int"))  # a row per leaf
            visited = stored(visited, "blocks")
        for block in range(n_blocks + (n_blocks > 1)):
            rows = (visited.where(F.col("block") == block) if n_blocks > 1 else visited).select("number", "vector", "visits").collect()  # query_bytes, about
            if not rows:
                continue
            matrix = np.frombuffer(b"".join(bytes(r[1]) for r in rows), dtype=self.kind).reshape(len(rows), self.dim)
            visits = np.frombuffer(b"".join(bytes(r[2]) for r in rows), dtype=np.uint8).reshape(len(rows), -1)
            found = stored(self._merged(self._best(matrix, np.array([r[0] for r in rows], dtype=np.int64), visits, counts)), "neighbours")
            hits = found if hits is None else hits.unionByName(found)
        return self._without_own(own, vectors, hits)

    def _visiting(self, vectors: DataFrame, n: int) -> DataFrame:
        """Add ``visits``, the leaves that each query visits, as bits."""
        shared, dim, kind, least = self.spark.sparkContext.broadcast((self.tree, self.sizes)), self.dim, self.kind, self.k + 1  # of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sizes = shared.value
            for batch in batches:
                matrix = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=kind).reshape(batch.num_rows, dim).astype(float)
                bits = tree.visits(unit(matrix), n, sizes, least)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in bits], type=pa.binary())], names=["number", "vector", "leaf", "visits"])

        # A narrow table has few splits, but each query is some work: deal them out first.
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return vectors.select("number", "vector", "leaf").repartition(tasks, "number").mapInArrow(run, "number long, vector binary, leaf int, visits binary")

    def _without_own(self, own: DataFrame, vectors: DataFrame, hits: DataFrame) -> DataFrame:
        """The hits of each query row: those of its vector but for one row that is its own."""
        table = stored(vectors.select("vector", "number", "n").join(hits, "number").select("vector", "n", "hits"), "hits-of-vectors")
        rows = join_counted(own.select("vec_id", "vector"), table, "vector", own.count()).withColumnRenamed("vec_id", "query_id")
        mine = F.array_position(F.transform("hits", lambda h: h["same"] & (h["vec_id"] == F.col("query_id"))), True)
        others = F.slice(F.filter("hits", lambda h, i: i + 1 != F.col("mine")), 1, self.k)
        each = rows.withColumn("mine", mine).select("query_id", F.posexplode(others).alias("at", "hit"))
        vec_id = F.when(F.col("hit.vec_id") != NO_ID, F.col("hit.vec_id"))
        return each.select("query_id", (F.col("at") + 1).alias("rank"), vec_id.alias("vec_id"), (-F.col("hit.less")).alias("score"))


class Best:
    """The k best rows of each of n queries so far, by score and then smaller id; ``least`` is the score to reach."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int32)]

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, same: np.ndarray, leaf: int) -> None:
        good = scores >= self.least[q]
        new = [q[good], ids[good], scores[good], same[good], np.full(int(good.sum()), leaf, dtype=np.int32)]
        touched = np.zeros(len(self.least), dtype=bool)
        touched[new[0]] = True
        moved = touched[self.held[0]]
        rest, some = [c[~moved] for c in self.held], [np.concatenate([c[moved], n]) for c, n in zip(self.held, new)]
        order = np.lexsort((some[1], -some[2], some[0]))
        some = [c[order] for c in some]
        first = np.searchsorted(some[0], some[0])
        nth = np.arange(len(first)) - first
        some = [c[nth < self.k] for c in some]
        last = nth[nth < self.k] == self.k - 1
        self.least[some[0][last]] = some[2][last]
        self.held = [np.concatenate([r, s]) for r, s in zip(rest, some)]

    def rows(self) -> tuple[np.ndarray, list[np.ndarray]]:
        return self.held[0], self.held[1:]


def neighbours(rows: DataFrame, step: int = STEP, k: int = K, recall: float = RECALL, counts: tuple[Accumulator, Accumulator] | None = None, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row of ``rows`` (vec_id, embedding) whose vec_id is divisible by ``step``.

    ``counts`` may name two accumulators: pairs of query and vector that were scored, and those of the folders read.
    """
    query_bytes = sizes.pop("query_bytes", QUERY_BYTES)
    return Search(rows, k, **sizes).run(rows.where(F.col("vec_id") % step == 0), recall, query_bytes, counts)


def op11_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for every one whose vec_id is divisible by 50."""
    return neighbours(table(spark, sf_dir, "embeddings"))
