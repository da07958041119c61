"""Embeddings that are learnt: the right singular vectors of the corpus' weighted token matrix.

A text is the sum of its tokens' vectors by (1 + ln tf) times ln((n + 1) / (df + 1)), as long texts weigh no more made unit length. The vectors span
the space in which the corpus' texts differ most, so texts that share few words but the same company are near.
They are found by subspace iteration: each round is one distributed pass that multiplies the matrix with a block of vectors and
its transpose with the product; a task sums its rows' part, and only the block, ``MOST`` tokens times the rank, is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators import vectors as V
from lectern.operators.bm25 import count_lists
from lectern.sources.shared import scratch, written

#: Tokens that have vectors, the most frequent ones; vectors of the block besides the wanted; rounds; rows that are multiplied at a time.
MOST, SPARE, ROUNDS, ROWS = 50_000, 8, 6, 512
ENTRIES = "n int, rows binary, tokens binary, order binary, data binary"


@dataclass
class Model:
    """``number``: the tokens' rows in ``basis`` (tokens x dimensions), whose ``weight`` is the tokens' inverse document frequency."""

    number: dict[str, int]
    weight: np.ndarray
    basis: np.ndarray
    singular: np.ndarray


def _matrix(toks: pa.Array, tfs: pa.Array, number: dict[str, int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, token, value) of the entries of some texts, rows of unit length, and the number of texts."""
    coded = toks.flatten().dictionary_encode()
    known = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()] or [0], dtype=np.int64)
    token = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(toks)), toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    value = 1 + np.log(tfs.flatten().to_numpy(zero_copy_only=False).astype(float))
    inside = token >= 0
    row, token, value = row[inside], token[inside], value[inside] * weight[token[inside]]
    size = np.sqrt(np.bincount(row, weights=value * value, minlength=len(toks)))
    return row, token, value / np.where(size > 0, size, 1)[row], len(toks)


def _times(row: np.ndarray, token: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    found = np.zeros((n, basis.shape[1]))
    if len(row):
        first = np.nonzero(np.diff(row, prepend=-1))[0]
        found[row[first]] = np.add.reduceat(basis[token] * value[:, None], first, axis=0)
    return found


def _entries(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (toks, tfs) to blocks of the matrix: each entry's row, token and value, and the entries' order by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weight = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, token, value, n = _matrix(part.column(0), part.column(1), number, weight)
                packed = [row.astype("<i4"), token.astype("<i4"), np.argsort(token, kind="stable").astype("<i4"), value.astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int32()), *[pa.array([p.tobytes()]) for p in packed]], names=["n", "rows", "tokens", "order", "data"])

    return run


def fit(counted: DataFrame, dim: int, most: int = MOST, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Learn from counted texts (toks, tfs), as ``bm25.count_tokens`` makes them.

    Tokens become numbers once; every round reads the stored entries of the matrix, a block of texts in a row.
    """
    spark = counted.sparkSession
    rows = counted.select("toks", "tfs")
    n = rows.count()
    found = rows.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "tok").limit(most).collect()
    number = {r["tok"]: i for i, r in enumerate(found)}
    weight = np.log((n + 1) / (np.array([r["df"] for r in found], dtype=float) + 1))
    rank = min(dim + SPARE, max(1, len(number)))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(number), rank)))[0] if number else np.zeros((0, rank))
    values = np.zeros(rank)
    entries = written(rows.mapInArrow(_entries(spark.sparkContext.broadcast((number, weight))), ENTRIES), scratch(spark, "matrix")) if rounds and number else None  # at most MOST tokens
    for _ in range(rounds if number else 0):
        shared = spark.sparkContext.broadcast(basis)  # at most MOST tokens

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            basis = shared.value
            total = np.zeros_like(basis)
            for batch in batches:
                for n, *packed in zip(*[column.to_pylist() for column in batch.columns]):
                    row, token, order, value = (np.frombuffer(p, kind) for p, kind in zip(packed, ("<i4", "<i4", "<i4", "<f8")))
                    if not len(row):
                        continue
                    part = (_times(row, token, value, n, basis)[row] * value[:, None])[order]
                    token = token[order]
                    first = np.nonzero(np.diff(token, prepend=-1))[0]
                    total[token[first]] += np.add.reduceat(part, first, axis=0)
            touched = np.nonzero(total.any(axis=1))[0]
            for at in range(0, len(touched), 4096):
                some = touched[at : at + 4096]
                flat = pa.array(total[some].ravel())
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, basis.shape[1], dtype=np.int32)), flat)], names=["token", "part"])

        sums = [F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(rank)]
        product = np.zeros_like(basis)
        for token, *values in entries.mapInArrow(run, "token long, part array<double>").groupBy("token").agg(*sums).collect():  # a row per token
            product[token] = values
        # The product's singular values are the squares of the matrix' own once the basis is its right singular vectors.
        basis, values, _ = np.linalg.svd(product, full_matrices=False)
    return Model(number, weight, basis[:, :dim], np.sqrt(values[:dim]))


def embedder(spark: SparkSession, model: Model):
    """A function of (text column, dimension) for ``vectors.EMBEDDERS``; a text without known tokens is all zeros."""
    shared = spark.sparkContext.broadcast(model)  # at most MOST tokens

    @F.arrow_udf("array<double>")
    def embed(lists: pa.Array) -> pa.Array:
        own, found = shared.value, []
        counts = count_lists(lists)
        for at in range(0, len(lists), ROWS):
            toks, tfs = (counts.field(name).slice(at, ROWS) for name in ("toks", "tfs"))
            found.append(V._unit(_times(*_matrix(toks, tfs, own.number, own.weight), own.basis)))
        flat = np.vstack(found).ravel() if found else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, own.basis.shape[1], dtype=np.int32)), pa.array(flat))

    def of(text: Column, dim: int) -> Column:
        if dim != model.basis.shape[1]:
            raise ValueError(f"the model has {model.basis.shape[1]} dimensions")
        return embed(tokens(text))

    return of


def register(spark: SparkSession, model: Model, provider: str) -> None:
    """Make the model known as an embedding provider."""
    V.EMBEDDERS[provider] = embedder(spark, model)
