"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are dealt into slices.  In a slice, the offset of a vector from the
slice's mean is normalised, padded with zeros to the length of the code, rotated
by a fixed random rotation and kept as one bit a dimension, with two correction
scalars: the offset's length, and the inner product of the offset and its code.
From a query's rotated vector and the bits an inner product is estimated, with a
bound on its error.  The vectors with the largest estimates are compared first;
the k-th best of them is the mark that a vector's upper bound must reach to be
compared as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Index:
    """slice, block: vectors and queries in one task's tile; bits: least code length; width: error bound in standard deviations; first: vectors compared for the mark, as a multiple of k."""

    slice: int = 8192
    block: int = 16384
    bits: int = 256
    width: float = 3.0
    first: int = 3
    seed: int = 11


@lru_cache(maxsize=4)
def rotation(size: int, bits: int, seed: int) -> np.ndarray:
    """The rows of a random rotation of ``bits`` dimensions that the first ``size`` of them meet."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:size]


@dataclass
class Codes:
    """One-bit codes of a slice and what corrects them."""

    mean: np.ndarray
    turn: np.ndarray
    bits: np.ndarray
    length: np.ndarray
    agreement: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, index: Index) -> Codes:
        size = vectors.shape[1]
        bits = max(-(-size // 8) * 8, index.bits)
        turn, mean = rotation(size, bits, index.seed), vectors.mean(axis=0)
        offset = vectors - mean
        length = np.linalg.norm(offset, axis=1)
        unit = offset / np.where(length > 0, length, 1.0)[:, None] @ turn
        agreement = np.abs(unit).sum(axis=1) / math.sqrt(bits)
        return cls(mean, turn, np.packbits(unit > 0, axis=1), length, np.where(agreement > 0, agreement, 1.0))

    def bounds(self, queries: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products, queries by vectors, and how far off they may be."""
        size = self.turn.shape[1]
        signs = np.unpackbits(self.bits, axis=1).astype(np.float32) * 2 - 1
        inner = (queries @ self.turn).astype(np.float32) @ signs.T
        inner *= (self.length / self.agreement / math.sqrt(size)).astype(np.float32)
        inner += (queries @ self.mean).astype(np.float32)[:, None]
        spread = self.length * np.sqrt(np.maximum(1 / self.agreement**2 - 1, 0) / max(size - 1, 1))
        error = np.outer(width * np.linalg.norm(queries, axis=1), spread).astype(np.float32)
        error += 1e-5 * (1 + np.abs(inner))  # single precision
        return inner, error


def exact(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first dimension to the last."""
    total = np.zeros(columns.shape[1])
    for x, column in zip(query, columns):
        total += x * column
    return total


def _first_of_equal(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows in id order without those of which ``k`` equal vectors with smaller ids exist: they can't be found."""
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(vectors[order]).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    first = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
    return order[np.sort(by[place < k])]


def _tile(queries: pa.Table, vectors: pa.Table, k: int, index: Index) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Query id and copy, and the ids and scores of its best in the slice."""
    matrix = lambda t: np.array(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(len(t), -1)
    ids, data = vectors.column("vec_id").to_numpy(), matrix(vectors)
    kept = _first_of_equal(ids, data, k + 1)
    ids, data = ids[kept], data[kept]
    codes, first = Codes.of(data, index), index.first * k + 1
    query_ids, copies, asked = queries.column("vec_id").to_numpy(), queries.column("copy").to_numpy(), matrix(queries)
    for at in range(0, len(asked), 256):
        upper, error = codes.bounds(asked[at : at + 256], index.width)
        top = np.argpartition(upper, -first, axis=1)[:, -first:] if len(ids) > first else np.tile(np.arange(len(ids)), (len(upper), 1))
        upper += error
        for i, query in enumerate(asked[at : at + 256]):
            best = np.sort((data[top[i]] @ query)[ids[top[i]] != query_ids[at + i]])
            mark = best[-k] - 1e-9 * (1 + abs(best[-k])) if len(best) >= k else -np.inf
            near = np.flatnonzero(upper[i] >= mark)
            near = near[(ids[near] != query_ids[at + i]) & (data[near] @ query >= mark)]
            score = exact(query, data[near].T)
            best = np.lexsort((ids[near], -score))[:k]
            yield query_ids[at + i], copies[at + i], ids[near][best], score[best]


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, index: Index = Index()) -> DataFrame:
    """The ``k`` nearest vectors of each query by inner product: query_id, rank, vec_id, score.

    Both have ``vec_id`` and ``embedding``; other columns are ignored.  Rows
    with a null id or an unusable vector take no part, and only vectors of a
    query's dimension are compared with it.  A query is not compared with rows
    of its own id; repeated rows (same id and vector) count once; ties go to the
    smaller id; with fewer candidates all are returned; empty tables give an
    empty result.  Tiles of at most about ``slice`` vectors and ``block``
    queries are compared, every slice with every block.
    """

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        rows = rows.withColumn("copy", F.xxhash64("embedding")).dropDuplicates(["vec_id", "copy"])
        return rows.withColumn("size", F.size("embedding"))

    vectors, queries = clean(vectors), clean(queries)
    n_slices = max(1, -(-vectors.count() // index.slice))
    n_blocks = max(1, -(-queries.count() // index.block))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = vectors.select("size", part(n_slices).alias("slice"), every(n_blocks).alias("block"), "vec_id", "embedding")
    asked = queries.select("size", every(n_slices).alias("slice"), part(n_blocks).alias("block"), "vec_id", "copy", "embedding")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if len(left) and len(right):
            for query, copy, ids, score in _tile(left, right, k, index):
                for column, value in zip(columns, (np.full(len(ids), query), np.full(len(ids), copy), ids, score)):
                    column.append(value)
        names, kinds = ["query_id", "copy", "vec_id", "score"], [pa.int64()] * 3 + [pa.float64()]
        return pa.table({n: pa.array(np.concatenate(c) if c else [], t) for n, c, t in zip(names, columns, kinds)})

    keys = ["size", "slice", "block"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(work, "query_id bigint, copy bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
