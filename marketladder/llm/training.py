"""Labelled rows that a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id's text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of the labelled rows that are not held out.

    Rows without an id or a label teach nothing; of several labels of an id the
    larger counts; a null text is empty.  The labels grow with the documents,
    so they are never broadcast: both sides are shuffled at any size.
    """
    known = (
        labels.select("doc_id", F.col(label).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.filter(~held_out(F.col("doc_id"))).join(known.hint("merge"), "doc_id")
