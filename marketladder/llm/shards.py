"""Hierarchical weighted hash tree: documents descend region, rack and shard.

At every level each child draws ``-ln(u) / weight`` with ``u`` from a hash of
the document id and the child's name; the smallest draw wins.  So a child gets
its share of the weight, and a changed weight moves rows only into or out of
the subtree it belongs to.  A shard added as a region of its own takes rows
only into itself.  All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketladder.session import stored

#: (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]

#: Eight equal shards in two regions of two racks each.
EIGHT: list[Leaf] = [(f"region{s // 4}", f"rack{s // 2}", s, 1.0) for s in range(8)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region and a rack of its own."""
    shard = max(leaf[2] for leaf in tree) + 1
    return [*tree, (f"region+{shard}", f"rack+{shard}", shard, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of a child; the smallest of several wins by weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    unit = (bits.cast("double") + F.lit(1.0)) / F.lit(float(2**53 + 1))
    return -F.log(unit) / F.lit(float(weight))


def _winner(key: Column, children: dict[str, float]) -> Column:
    """Place of the child with the smallest draw."""
    draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight) in enumerate(children.items())]
    return F.least(*draws)["i"] if len(draws) > 1 else F.lit(0)


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key; leaves of no weight get nothing."""
    leaves = [leaf for leaf in tree if leaf[3] > 0]
    if not leaves:
        raise ValueError("the tree needs a shard with a weight above 0")

    def descend(below: list[Leaf], level: int, path: str) -> Column:
        if level == 3:
            return F.lit(below[0][2])
        groups: dict[str, list[Leaf]] = {}
        for leaf in below:
            groups.setdefault(f"{path}/{leaf[level]}", []).append(leaf)
        place = _winner(key, {name: sum(leaf[3] for leaf in group) for name, group in groups.items()})
        targets = [descend(group, level + 1, name) for name, group in groups.items()]
        return reduce(lambda chosen, i: F.when(place == i, targets[i]).otherwise(chosen), range(1, len(targets)), targets[0])

    return descend(leaves, 0, "").cast("int")


def assign(docs: DataFrame, tree: Sequence[Leaf] = tuple(EIGHT), block_rows: int = 1 << 16) -> DataFrame:
    """Shard, slot within the shard, and the shard after growth by one.

    The id alone decides, so rows with equal ids meet in one shard; a null id
    is a key like any other.  ``size`` is the text's UTF-8 bytes plus 1, a null
    text has none.  Slots count without gaps from 0, in no order that matters:
    rows are dealt at random, whatever their id, into blocks of about
    ``block_rows``, and a table of a count for each shard and block gives every
    block its offset.  The dealt rows, without texts, are stored, so numbers and
    counts come from one deal also if an executor is lost.  An empty table
    gives an empty result.
    """
    blocks = max(1, -(-docs.count() // block_rows))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    dealt = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"),
        F.floor(F.rand() * blocks).cast("int").alias("block"),
    )
    rows = stored(dealt)
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(place) - 1)
    return numbered.join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("place")).cast("bigint").alias("slot"), "grown_shard",
    )
