"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Vectors are dealt into slices and anchors into blocks; a task joins one slice
with one block.  Dimensions are visited in one order, heaviest first.  At a
threshold, a vector's last dimensions whose norm can't lift a score to it are
left out of the index: the others are posted in chunks of dimensions, and as
vectors lie in the order of their posted length, a chunk's posting list is the
first part of them.  An anchor adds up partial scores chunk by chunk and drops
what the norms of the dimensions that remain can't lift to its threshold; what
is left is compared whole, in exact integers.  Anchors whose windows are not
full go on with a lower threshold and a longer index.

There are two such joins: the first finds each anchor's positives, the second
fills a window of scores below each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketladder.session import stored

NO_ID = np.iinfo(np.int64).max  # a null id counts as larger than any other
EXACT = float(1 << 53)  # doubles hold every integer below
SLACK = 1e-4  # more than what single precision loses on vectors of length 1
BATCH = 64  # anchors whose partial scores are added up together
SPARSE = 8  # they are while more than one row in so many is alive


@dataclass(frozen=True)
class Mining:
    """positives, negatives: rows of an anchor and of a positive; low, high: the window in hundredths of the positive's score; slice, block: vectors and anchors of a task; chunk: dimensions of a posting list; fall: next threshold as a part of the last."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    slice: int = 8192
    block: int = 8192
    chunk: int = 8
    fall: float = 0.75


# ---- the index of a slice ----------------------------------------------------------------------------------------


class Slice:
    """The vectors of a slice, scaled by the largest norm, with their dimensions in visiting order, and the norms of what follows each chunk."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, chunk: int):
        self.ids, self.labels, self.whole = ids, labels, vectors
        doubles = vectors.astype(np.float64)
        self.turn = np.argsort(-np.square(doubles).sum(axis=0), kind="stable")
        self.cuts = [*range(0, vectors.shape[1], chunk), vectors.shape[1]]
        self.largest = float(np.sqrt(np.square(doubles).sum(axis=1)).max(initial=0.0))
        self.exact = doubles if self.largest < EXACT else None
        scaled = doubles[:, self.turn] / (self.largest or 1.0)
        self.values, self.rest = scaled.astype(np.float32), self.norms(scaled)

    def norms(self, values: np.ndarray) -> np.ndarray:
        """For each row the norm of the dimensions from each cut on."""
        after = np.sqrt(np.cumsum(np.square(values[:, ::-1]), axis=1))[:, ::-1]
        after = np.concatenate([after, np.zeros((len(values), 1))], axis=1)
        return after[:, self.cuts].astype(np.float32)

    def posted(self, share: float, rows: np.ndarray) -> Postings:
        """The index of some rows for scores of ``share``, as a part of the largest norms; all dimensions where it isn't above 0."""
        if share <= 0:
            return Postings(self, rows, np.full(len(rows), len(self.cuts) - 1))
        covered = self.rest[rows] < share - SLACK
        covered[:, -1] = True
        length = covered.argmax(axis=1)
        kept = length > 0  # a vector that is covered whole can't reach the threshold
        return Postings(self, rows[kept], length[kept])

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact integer inner products; what a long can't hold becomes the largest one."""
        doubles = anchor.astype(np.float64)
        if self.exact is not None and np.linalg.norm(doubles) * self.largest < EXACT:
            return (self.exact[rows] @ doubles).astype(np.int64)
        products = [sum(int(x) * int(y) for x, y in zip(row, anchor)) for row in self.whole[rows]]
        return np.array([max(-NO_ID, min(NO_ID, p)) for p in products], np.int64)


class Postings:
    """Rows in the order of their posted length; chunk c is posted for the first ``ends[c]`` of them."""

    def __init__(self, own: Slice, rows: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        self.own, self.rows = own, rows[order]
        self.ends = np.searchsorted(-length[order], -np.arange(1, len(own.cuts)), side="right")
        self.rest = np.ascontiguousarray(own.rest[self.rows].T)
        self.chunks = [np.ascontiguousarray(own.values[self.rows[:end], a:b]) for a, b, end in zip(own.cuts, own.cuts[1:], self.ends)]

    def reaching(self, anchors: np.ndarray, after: np.ndarray, thresholds: np.ndarray) -> list[np.ndarray]:
        """For each anchor, rows of the slice that may score its threshold or more.

        Anchors have length 1 and their dimensions in visiting order, ``after``
        their norms from each cut on.  While most rows are alive, partial scores
        of all anchors are added up at once; then for the live rows of each.
        """
        marks = (thresholds - SLACK).astype(np.float32)
        ready: list[list[np.ndarray]] = [[] for _ in marks]
        scores, live = np.zeros((len(marks), len(self.rows)), np.float32), None
        for c, (a, b, end) in enumerate(zip(self.own.cuts, self.own.cuts[1:], self.ends)):
            if live is None:
                alive = scores + after[:, c, None] * self.rest[c][: scores.shape[1]] >= marks[:, None]
                for i in np.flatnonzero(alive[:, end:].any(axis=1)):  # their other dimensions are not in the index
                    ready[i].append(np.flatnonzero(alive[i, end:]) + end)
                if alive[:, :end].sum() * SPARSE > alive[:, :end].size:
                    scores = scores[:, :end] + anchors[:, a:b] @ self.chunks[c].T
                    continue
                live = [np.flatnonzero(x) for x in alive[:, :end]]
                partial = [scores[i, at] + self.chunks[c][at] @ anchors[i, a:b] for i, at in enumerate(live)]
                continue
            for i, at in enumerate(live):
                if len(at):
                    kept = partial[i] + after[i, c] * self.rest[c][at] >= marks[i]
                    at, score = at[kept], partial[i][kept]
                    cut = int(np.searchsorted(at, end))
                    ready[i].append(at[cut:])
                    live[i] = at[:cut]
                    partial[i] = score[:cut] + self.chunks[c][at[:cut]] @ anchors[i, a:b]
        for i in range(len(marks)):
            ready[i].append(np.flatnonzero(scores[i] >= marks[i]) if live is None else live[i][partial[i] >= marks[i]])
        return [self.rows[np.concatenate(r)] for r in ready]


def lowering(own: Slice, rows: np.ndarray, anchors: list, rule: Mining, start: Callable, floor: Callable, full: Callable) -> Iterator:
    """``(number, rows, scores)`` of an anchor once its windows are ``full`` or its threshold has reached its floor.

    ``anchors`` are (number, vector) pairs.  Thresholds are parts of the product
    of an anchor's norm and the slice's largest, the same series for all, so
    that they share each index; an anchor joins where the series passes its
    start, and none goes below its floor, which is at least 0.
    """
    numbers = np.array([n for n, _ in anchors])
    vectors = {n: v for n, v in anchors}
    norm = {n: float(np.linalg.norm(v.astype(np.float64))) * own.largest for n, v in anchors}
    share = 1.0
    while len(numbers):
        share = share * rule.fall if share > 0.02 else 0.0
        # an anchor of norm 0 has only scores of 0, so no dimension is covered
        due = np.array([share <= 0 or (norm[n] > 0 and share * norm[n] < start(n)) for n in numbers])
        left, index = list(numbers[~due]), own.posted(share, rows)
        for at in range(0, int(due.sum()), BATCH):
            batch = numbers[due][at : at + BATCH]
            turned = np.stack([vectors[n][own.turn] for n in batch]).astype(np.float64)
            turned /= np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-300)
            least = np.array([floor(n) for n in batch])
            sizes = np.array([norm[n] for n in batch])
            marks = np.maximum(share, np.divide(least, sizes, out=np.zeros(len(batch)), where=sizes > 0))
            for n, low, found in zip(batch, least, index.reaching(turned.astype(np.float32), own.norms(turned), marks)):
                threshold = max(share * norm[n], low)
                scores = own.scores(found, vectors[n])
                reached = scores >= threshold
                found, scores = found[reached], scores[reached]
                if threshold <= low or full(n, found, scores, threshold):
                    yield n, found, scores
                else:
                    left.append(n)
        numbers = np.array(left)


# ---- the two joins of a tile -------------------------------------------------------------------------------------


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _matrix(table: pa.Table) -> np.ndarray:
    size = table.column("size")[0].as_py()
    return np.array(table.column("vector").combine_chunks().flatten(), np.int64).reshape(len(table), size)


def _slice(table: pa.Table, rule: Mining) -> Slice:
    column = lambda n: table.column(n).to_numpy()
    return Slice(column("id"), column("label"), _matrix(table), rule.chunk)


POSITIVES = "anchor bigint, copy bigint, id bigint, score bigint"
NEGATIVES = "anchor bigint, copy bigint, positive bigint, place bigint, positive_score bigint, id bigint, score bigint"


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    names = [field.split()[0] for field in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def _positives(anchors: pa.Table, vectors: pa.Table, rule: Mining) -> pa.Table:
    """The best rows of the slice with an anchor's label, down to a score of 0."""
    own = _slice(vectors, rule)
    ids, copies, labels, asked = (anchors.column(n).to_numpy() for n in ("id", "copy", "label", "vector"))
    asked, out = _matrix(anchors), []
    for label in np.unique(labels):
        mine = np.flatnonzero(labels == label)
        rows = np.flatnonzero(own.labels == label)
        others = lambda n, found: found[own.ids[found] != ids[n]]
        full = lambda n, found, scores, t: len(others(n, found)) >= rule.positives
        pairs = [(n, asked[n]) for n in mine]
        for n, found, scores in lowering(own, rows, pairs, rule, lambda n: np.inf, lambda n: 0.0, full):
            other = own.ids[found] != ids[n]
            found, scores = found[other], scores[other]
            for i in _first(own.ids[found], scores, rule.positives):
                out.append((ids[n], copies[n], own.ids[found[i]], scores[i]))
    return _arrow(out, POSITIVES)


def _negatives(anchors: pa.Table, vectors: pa.Table, rule: Mining) -> pa.Table:
    """The best rows of the slice with another label in the window of each positive."""
    own = _slice(vectors, rule)
    ids, copies, labels = (anchors.column(n).to_numpy() for n in ("id", "copy", "label"))
    asked, out = _matrix(anchors), []
    windows = [[(p["id"], p["place"], p["score"], -(-rule.low * p["score"] // 100), rule.high * p["score"] // 100) for p in w] for w in anchors.column("positives").to_pylist()]
    highest = [float(max(w[4] for w in each)) for each in windows]
    lowest = [float(min(w[3] for w in each)) for each in windows]

    def full(n: int, found: np.ndarray, scores: np.ndarray, threshold: float) -> bool:
        other = scores[own.labels[found] != labels[n]]
        return all(lo >= threshold or int((other <= hi).sum()) >= rule.negatives for _, _, _, lo, hi in windows[n])

    for n, found, scores in lowering(own, np.arange(len(own.ids)), list(enumerate(asked)), rule, lambda n: highest[n] + 1, lambda n: lowest[n], full):
        other = own.labels[found] != labels[n]
        found, scores = found[other], scores[other]
        for positive, place, score, lo, hi in windows[n]:
            inside = np.flatnonzero((scores >= lo) & (scores <= hi))
            for i in inside[_first(own.ids[found[inside]], scores[inside], rule.negatives)]:
                out.append((ids[n], copies[n], positive, place, score, own.ids[found[i]], scores[i]))
    return _arrow(out, NEGATIVES)


# ---- the job -----------------------------------------------------------------------------------------------------


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(256.0)).cast("bigint"))


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _tiles(anchors: DataFrame, vectors: DataFrame, n_blocks: int, n_slices: int, work: Callable, schema: str) -> DataFrame:
    """Every slice of vectors with every block of anchors, both dealt by a hash of id and vector."""
    part = lambda n: F.pmod(F.xxhash64("id", "copy"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.select("*", part(n_blocks).alias("block"), every(n_slices).alias("slice"))
    data = vectors.select("*", part(n_slices).alias("slice"), every(n_blocks).alias("block"))
    keys = ["size", "slice", "block"]
    empty = _arrow([], schema)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right) if len(left) and len(right) else empty

    return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(joined, schema)


def mine(rows: DataFrame, anchors: Column, rule: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, label and vector (integers); those with a null label,
    vector or component take no part.  ``anchors`` tells which are anchors.  An anchor's positives are its first other rows of its
    label by inner product, ties by smaller id; for each positive its first rows
    of another label whose score is between ``low`` and ``high`` hundredths of
    the positive's are returned.  A positive with a score below 0 has no such
    rows.  Rows of the anchor's id are not its others; repeated rows count once,
    rows of one id that differ count each; a null id is a row like any other,
    after all others among ties.  Vectors are compared with those of their
    length.  Scores are exact; one that a long can't hold counts as the largest.
    Other columns are ignored; an empty table gives an empty result.
    """
    columns = F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<bigint>").alias("vector")
    chosen = F.coalesce(anchors, F.lit(False)).alias("anchor")
    all_rows = rows.select(*columns, chosen).filter("label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    all_rows = all_rows.withColumn("copy", F.xxhash64("label", "vector"))
    all_rows = all_rows.withColumns({"id": F.coalesce("id", F.lit(int(NO_ID))), "size": F.size("vector")})
    all_rows = stored(all_rows.dropDuplicates(["id", "copy"]))
    vectors, asked = all_rows.drop("anchor"), all_rows.filter("anchor").drop("anchor")
    counts = all_rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("m")).first()
    n_slices, n_blocks = max(1, -(-counts.n // rule.slice)), max(1, -(-counts.m // rule.block))
    tiles = lambda queries, work, schema: _tiles(queries, vectors, n_blocks, n_slices, lambda a, v: work(a, v, rule), schema)

    first = Window.partitionBy("anchor", "copy").orderBy(F.desc("score"), "id")
    near = tiles(asked, _positives, POSITIVES).withColumn("place", F.row_number().over(first).cast("bigint"))
    listed = F.collect_list(F.struct("id", "place", "score")).alias("positives")  # at most ``positives`` of them
    positives = near.filter(F.col("place") <= rule.positives).groupBy(F.col("anchor").alias("id"), "copy").agg(listed)
    found = tiles(stored(asked.join(positives, ["id", "copy"])), _negatives, NEGATIVES)
    best = Window.partitionBy("anchor", "copy", "place").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= rule.negatives)
    known = lambda c: F.nullif(F.col(c), F.lit(int(NO_ID)))
    return ranked.select(
        known("anchor").alias("anchor_id"), known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
