"""Approximate search in layered neighbour graphs, one for each shard of the vectors.

A shard is built where its rows are and stored as one row of arrays. A node's highest layer
falls off geometrically by a hash of its id. In every layer each node is linked to those of its
nearest nodes that are nearer to it than to a node it is linked to already, and these links hold
both ways. A search goes down the layers greedily and keeps the ``ef`` best nodes of the lowest; shards are searched
apart and their best are merged.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lectern.operators import scan
from lectern.operators import vectors as V

#: Rows of a shard; links of a node in an upper layer, twice as many in the lowest; nearest nodes that links are chosen from.
SHARD, LINKS, CANDIDATES = 4096, 12, 48
#: Nodes that a search keeps in the lowest layer.
EF = 64
GRAPH = "shard long, dim int, ids array<long>, units binary, layers array<struct<nodes: array<int>, starts: array<int>, links: array<int>>>"


def level(vec_id: int, links: int = LINKS) -> int:
    """The highest layer of a node, the same wherever it is built."""
    draw = (int.from_bytes(hashlib.md5(str(vec_id).encode()).digest()[:7], "little") + 1) / (1 << 56)
    return int(-np.log(draw) / np.log(links))


def linked(units: np.ndarray, links: int, candidates: int = CANDIDATES) -> list[np.ndarray]:
    """The neighbours of each node of one layer: diverse ones among the nearest, both ways, nearest first if they are too many."""
    n, chosen = len(units), []
    for start in range(0, n, 256):
        near = units[start : start + 256] @ units.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        some = np.argsort(-near, axis=1, kind="stable")[:, : min(candidates, n - 1)]
        for row, others in zip(near, some):
            between = units[others] @ units[others].T
            kept: list[int] = []
            for i in range(len(others)):
                if len(kept) == links:
                    break
                if not kept or between[i, kept].max() < row[others[i]]:
                    kept.append(i)
            chosen.append(others[kept])
    both: list[set[int]] = [set(c.tolist()) for c in chosen]
    for a, c in enumerate(chosen):
        for b in c.tolist():
            both[b].add(a)
    found = []
    for a, others in enumerate(both):
        others = np.array(sorted(others), dtype=np.int32)
        if len(others) > 2 * links:
            others = others[np.argsort(-(units[others] @ units[a]), kind="stable")[: 2 * links]]
        found.append(others)
    return found


def graph(ids: np.ndarray, units: np.ndarray, links: int = LINKS) -> list[dict]:
    """Layers from the lowest up: nodes, where each node's links start, and the links as places in the layer."""
    levels = np.array([level(i, links) for i in ids.tolist()])
    levels[np.argmax(levels)] = levels.max(initial=0)
    layers = []
    for height in range(int(levels.max(initial=0)) + 1):
        nodes = np.nonzero(levels >= height)[0]
        found = linked(units[nodes], 2 * links if height == 0 else links)
        layers.append({"nodes": nodes.tolist(), "starts": np.r_[0, np.cumsum([len(f) for f in found])].tolist(), "links": nodes[np.concatenate(found)].tolist() if len(nodes) > 1 else []})
    return layers


def build(rows: DataFrame, path: str, shard: int = SHARD, links: int = LINKS) -> None:
    """Write the graphs of rows (vec_id, embedding); rows whose embedding is null, of another length than the longest, or no numbers are left out, as are those without an id."""
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    fit = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    schema = to_arrow_schema(_parse_datatype_string(GRAPH))

    def make(name: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).sort_by("vec_id")
        units = V._unit(V._matrix(table.column("embedding").combine_chunks())).astype(np.float32)
        ids = table.column("vec_id").to_numpy()
        row = {"shard": name, "dim": dim, "ids": ids.tolist(), "units": units.tobytes(), "layers": graph(ids, units, links)}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                parts.append(batch.slice(at, shard - size))
                at, size = at + parts[-1].num_rows, size + parts[-1].num_rows
                if size == shard:
                    yield make(name, parts)
                    name, parts, size = name + 1, [], 0
        if size:
            yield make(name, parts)

    # A row group is a shard or two, as a search reads them one by one.
    options = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1"}
    fit.select("vec_id", "embedding").mapInArrow(run, GRAPH).write.options(**options).parquet(path)


class Graph:
    """A shard's graph, and how many vectors its searches looked at."""

    def __init__(self, ids: list[int], units: bytes, dim: int, layers: list[dict]):
        self.ids, self.units = np.array(ids, dtype=np.int64), np.frombuffer(units, dtype=np.float32).reshape(-1, dim)
        self.layers = []
        for layer in layers:
            place = np.full(len(ids), -1)
            place[layer["nodes"]] = np.arange(len(layer["nodes"]))
            self.layers.append((place, np.array(layer["starts"]), np.array(layer["links"], dtype=np.int64)))
        self.entry = layers[-1]["nodes"][0]

    def search(self, query: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, nearness, vectors looked at) of the k best nodes found, best first."""
        seen = 1
        best = [(float(self.units[self.entry] @ query), self.entry)]
        for height in range(len(self.layers) - 1, -1, -1):
            best, looked = self._layer(query, best, 1 if height else max(ef, k), *self.layers[height])
            seen += looked
        best.sort(reverse=True)
        return np.array([b[1] for b in best[:k]], dtype=np.int64), np.array([b[0] for b in best[:k]]), seen

    def _layer(self, query: np.ndarray, start: list[tuple[float, int]], ef: int, place: np.ndarray, starts: np.ndarray, links: np.ndarray) -> tuple[list[tuple[float, int]], int]:
        visited = np.zeros(len(self.ids), dtype=bool)
        visited[[node for _, node in start]] = True
        waiting, best, looked = [(-near, node) for near, node in start], list(start), 0
        heapq.heapify(waiting)
        heapq.heapify(best)
        while waiting:
            near, node = heapq.heappop(waiting)
            if -near < best[0][0] and len(best) >= ef:
                break
            others = links[starts[place[node]] : starts[place[node] + 1]]
            others = others[~visited[others]]
            visited[others] = True
            looked += len(others)
            for value, other in zip((self.units[others] @ query).tolist(), others.tolist()):
                if len(best) < ef or value > best[0][0]:
                    heapq.heappush(waiting, (-value, other))
                    heapq.heappush(best, (value, other))
                    if len(best) > ef:
                        heapq.heappop(best)
        return best, looked


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, ef: int = EF, decimals: int = 6, query_bytes: int = V.QUERY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, vec_id, score of the k nearest found for each query but its own row; query_id, looked: how many vectors it was compared with)."""
    shards, parts = spark.read.parquet(path), []
    dim = (shards.select("dim").first() or [1])[0]
    fit = queries.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    for block in scan.blocks(fit, ["query_id", "embedding"], fit.count() * dim * 8, query_bytes):
        ids = np.array([r[0] for r in block], dtype=np.int64)
        units = V._unit(np.array([r[1] for r in block], dtype=np.float64).reshape(len(block), dim)).astype(np.float32)
        shared = spark.sparkContext.broadcast((ids, units))  # query_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, units = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    one, out = Graph(row["ids"], row["units"], row["dim"], row["layers"]), []
                    for query_id, unit in zip(ids.tolist(), units):
                        places, near, looked = one.search(unit, k + 1, ef)
                        out += [(query_id, int(v), float(s), 0) for v, s in zip(one.ids[places], np.round(near.astype(float), decimals)) if v != query_id] + [(query_id, None, None, looked)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "vec_id", "score", "looked"])

        parts.append(shards.mapInArrow(run, "query_id long, vec_id long, score double, looked long"))
    found = scan.together(parts)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return hits, found.groupBy("query_id").agg(F.sum("looked").alias("looked"))
