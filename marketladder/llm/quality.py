"""Quality classifier: naive Bayes support vectors.

A text becomes a set of hashed n-grams (runs of three bytes, single words, pairs
of different words, and patterns of one word several times running).  Over
all labelled rows the n-grams are counted by class; the log ratio of the two
classes' shares scales each indicator.  A linear model with hinge loss is then
fitted by dual coordinate descent on a bounded sample of the scaled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketladder.llm.training import held_out
from marketladder.llm.words import distinct, mixed, word_hashes

BITS = 18
SIZE = 1 << BITS
#: Numbers kept for the constant term, which every text has, and for the patterns of repeated words: a word 2 to 6
#: times running, and 1/64, 1/16, 1/4 and 1/2 of the words equal to the one before.
CONSTANT, RUNS, SHARES, RESERVED = 0, 1, 6, 16


@dataclass(frozen=True)
class Fit:
    """sample: rows of each class the linear model is fitted on, at most."""

    sample: int = 3000
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    slope: float = 4.0


def features(text: str | None) -> np.ndarray:
    """Sorted distinct n-gram numbers below ``SIZE``."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    grams = [np.array([CONSTANT], np.uint32)]

    def add(hashes: np.ndarray) -> None:
        numbers = (hashes >> np.uint64(64 - BITS)).astype(np.uint32)
        grams.append(np.maximum(numbers, RESERVED))

    if len(data) >= 3:
        wide = data.astype(np.uint64)
        add(mixed(distinct(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) + np.uint64(1)))
    words = word_hashes(data)
    if len(words):
        add(mixed(words + np.uint64(2)))
    if len(words) > 1:
        same = words[1:] == words[:-1]
        add(mixed(mixed(words[:-1]) + words[1:])[~same])
        grams.append(np.flatnonzero(same.mean() >= np.array([1 / 64, 1 / 16, 1 / 4, 1 / 2])).astype(np.uint32) + np.uint32(SHARES))
        again, times = same, RUNS
        while times < SHARES and again.any():
            grams.append(np.array([times], np.uint32))
            again, times = again[1:] & same[times:], times + 1
    return distinct(np.concatenate(grams))


def class_counts(rows: DataFrame) -> DataFrame:
    """``feature, n0, n1``: documents of each class that hold the feature; all rows count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                counts[int(label.as_py() > 0), features(text.as_py())] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"feature": seen.astype(np.int32), "n0": counts[0, seen], "n1": counts[1, seen]})

    parts = rows.select("text", "label").mapInArrow(work, "feature int, n0 bigint, n1 bigint")
    return parts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def sample_rows(rows: DataFrame, per_class: int) -> list[tuple[np.ndarray, int]]:
    """Features of the rows of each class with the smallest id hashes, at most ``per_class``."""
    def first(condition: str) -> DataFrame:
        return rows.filter(condition).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)

    ids = first("label > 0").union(first("label <= 0"))
    picked = rows.join(F.broadcast(ids.distinct()), "doc_id")  # at most 2 x per_class ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "grams": pa.array(grams, pa.binary()), "label": batch.column(2)})

    found = picked.select("doc_id", "text", "label").mapInArrow(work, "doc_id bigint, grams binary, label int").collect()
    return [(np.frombuffer(r.grams, np.uint32), r.label) for r in sorted(found, key=lambda r: (r.doc_id, bytes(r.grams)))]


def log_ratios(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log of the classes' smoothed shares, 0 for n-grams not seen; ``counts`` has a row for each class."""
    share = np.where(counts.any(axis=0), counts + smoothing, 1e-9)
    share = share / share.sum(axis=1, keepdims=True)
    return np.where(counts.any(axis=0), np.log(share[1] / share[0]), 0.0)


def dual_descent(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, fit: Fit) -> np.ndarray:
    """Weights of the scaled indicators, by coordinate descent on the dual of the hinge loss.

    Both classes get the same total cost, so the rarer one is not outvoted.
    """
    weight = np.zeros(len(ratio))
    share = np.bincount([int(label > 0) for _, label in rows], minlength=2)
    if not share.all():
        return weight
    cost = fit.cost * len(rows) / (2.0 * share)
    data = []
    for grams, label in rows:
        value = ratio[grams] / np.sqrt(len(grams))
        data.append((grams, value, 1.0 if label > 0 else -1.0, float(value @ value), cost[int(label > 0)]))
    alpha, order = np.zeros(len(data)), np.random.default_rng(7)
    for _ in range(fit.epochs):
        for i in order.permutation(len(data)):
            grams, value, sign, square, most = data[i]
            if square == 0:
                continue
            slope = sign * float(weight[grams] @ value) - 1.0
            new = min(max(alpha[i] - slope / square, 0.0), most)
            if new != alpha[i]:
                weight[grams] += (new - alpha[i]) * sign * value
                alpha[i] = new
    return weight


def train(rows: DataFrame, fit: Fit = Fit()) -> np.ndarray:
    """One weight per n-gram; ``rows`` has ``doc_id``, ``text`` and ``label``.

    The driver holds a vector of ``SIZE`` counts by class and the bounded
    sample.  With a class missing all weights are 0 and every score is 0.5.
    """
    counts = np.zeros((2, SIZE))
    for r in class_counts(rows).toLocalIterator():
        counts[:, r.feature] = r.n0, r.n1
    ratio = log_ratios(counts, fit.smoothing)
    return ratio * dual_descent(sample_rows(rows, fit.sample), ratio, fit)


def score_documents(docs: DataFrame, weight: np.ndarray, fit: Fit = Fit()) -> DataFrame:
    """Score of every text: one row per input row; null and empty texts have the constant term only.

    Null ids stay null and are not held out; repeated rows give repeated results; other columns are ignored.
    """
    table, slope = weight.astype(np.float32), fit.slope

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for text in batch.column(2):
                grams = features(text.as_py())
                margins.append(float(table[grams].sum(dtype=np.float64)) / np.sqrt(len(grams)))
            score = 1.0 / (1.0 + np.exp(-np.clip(slope * np.array(margins, float), -700, 700)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(1), "score": score,
                "predicted": (score >= 0.5).astype(np.int32),
            })

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")
