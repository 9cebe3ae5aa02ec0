"""Blocks of whole texts, and corpus-wide counts of their keys.

Texts are dealt into blocks of a few megabytes by a hash of id and text, so a
hot source or id is spread.  Rows that repeat both id and text would meet in one
block: where their copies are many bytes, one stands for all (``combined``).  A
task sees one block at a time and works on packed arrays; what blocks have in
common is found by sending each block's distinct keys, combined per block first,
to the bucket that owns them.  However often a key occurs, a block sends it once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketladder.llm.memory import frugal
from marketladder.session import stored

BLOCK_BYTES = 4 << 20
REPEATED_BYTES = 1 << 20  # from here on, the copies of a row are combined
COPIES_A_SALT = 1024
OWN_KEYS = "block int, bucket int, keys binary, counts binary, large binary"
KEYS = "block int, bucket int, keys binary, counts binary"
KEYS_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
OWN_ARROW = KEYS_ARROW.append(pa.field("large", pa.binary()))
MANY = 255  # in a byte of counts: the count is the next of the large ones


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for these texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return int(max(1, -(-size // block_bytes)))


def bucket_count(blocks: int, each: int = 2) -> int:
    """Buckets that own the keys: ``each`` a block, and from 256 on one for four blocks.

    Each block sends a row to each bucket, so on large tables buckets are as
    large as a task holds with ease: the keys of 16 MB of texts.
    """
    return min(each * blocks, max(256, -(-blocks // 4)))


def combined(docs: DataFrame, name: str, least: int = REPEATED_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """The rows, of those that repeat id and text only one, and all of those repeated rows.

    Only rows whose copies have ``least`` bytes together are combined.  Both
    tables have the columns of ``docs`` and ``name``, a struct (key, salts, salt):
    ``key`` is the same for equal id and text, null for other rows; a key's rows
    are dealt to ``salts`` values of ``salt``.  Without such rows the second is None.
    """
    same = F.xxhash64("doc_id", "text")
    copies = docs.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text").cast("bigint")).alias("size"))
    many = stored(copies.filter((F.col("copies") > 1) & (F.col("copies") * F.col("size") >= least)))
    if many.isEmpty():
        return docs.withColumn(name, F.lit(None).cast("struct<key:string,salts:int,salt:int>")), None
    known = free_name(docs, "same")
    salts = F.ceil(F.col("copies") / COPIES_A_SALT).cast("int")
    marked = docs.withColumn(known, same).join(many.select(F.col("same").alias(known), salts.alias(name)), known, "left").drop(known)
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")), 256)
    copy = F.struct(key.alias("key"), F.col(name).alias("salts"), F.floor(F.rand() * F.col(name)).cast("int").alias("salt"))
    heavy = marked.filter(F.col(name).isNotNull()).withColumn(name, copy)
    single = heavy.groupBy(F.col(name)["key"].alias("key")).agg(F.any_value(F.struct("*")).alias("row")).select("row.*")
    light = marked.filter(F.col(name).isNull()).withColumn(name, F.lit(None).cast(heavy.schema[name].dataType))
    return light.unionByName(single), heavy


def given_back(repeated: DataFrame, values: DataFrame, name: str, value: str) -> DataFrame:
    """The repeated rows of ``combined`` without ``name``, each with the column ``value`` of its key.

    ``values`` has key, salts and ``value``; a key's rows meet it in as many
    groups as it has salts.
    """
    key, salt = free_name(repeated, "key"), free_name(repeated, "salt")
    spread = values.select(F.col("key").alias(key), value, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias(salt))
    rows = repeated.withColumns({key: F.col(name)["key"], salt: F.col(name)["salt"]}).drop(name)
    return rows.join(spread, [key, salt]).drop(key, salt)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def in_blocks(docs: DataFrame, blocks: int, name: str = "block") -> DataFrame:
    """The rows with their block as first column, called ``name``."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias(name), "*")


def split_key(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 32 further bits that name a key within it.

    A bucket's share of the corpus stays the same size, so its keys rarely meet
    in the 32 bits however large the corpus is.
    """
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def joined_key(bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return bucket.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64)


def pack_keys(block: int, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Rows of ``OWN_KEYS`` for distinct hashes of a block and their counts in it: a byte each, and 32 bits for large ones."""
    bucket, rest = split_key(hashes, buckets)
    order = np.lexsort((rest, bucket))
    bucket, rest, counts = bucket[order], rest[order], counts[order]
    small = np.minimum(counts, MANY).astype(np.uint8)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    rows = []
    for start, end in zip(cuts, [*cuts[1:], len(bucket)]):
        large = counts[start:end][small[start:end] == MANY].astype(np.uint32)
        rows.append({
            "block": block, "bucket": int(bucket[start]), "keys": rest[start:end].tobytes(), "counts": small[start:end].tobytes(),
            "large": large.tobytes() if len(large) else None,
        })
    return pa.Table.from_pylist(rows, OWN_ARROW)


def unpack_counts(small: bytes, large: bytes | None) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.uint32)
    if large is not None:
        counts[counts == MANY] = np.frombuffer(large, np.uint32)
    return counts


def shared_keys(parts: DataFrame) -> DataFrame:
    """For each block those of its keys whose counts add up to 2 or more, with the 32-bit sums as counts."""

    @frugal
    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
        counts = np.concatenate([unpack_counts(r["counts"], r["large"]) for r in rows])
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        sums = np.add.reduceat(counts[order], starts)
        totals = np.empty(len(keys), np.uint32)
        totals[order] = np.repeat(sums, np.diff(np.r_[starts, len(keys)]))
        out, at = [], 0
        for r in rows:
            end = at + len(r["counts"])
            found = totals[at:end] >= 2
            if found.any():
                out.append({"block": r["block"], "bucket": r["bucket"], "keys": keys[at:end][found].tobytes(), "counts": totals[at:end][found].tobytes()})
            at = end
        return pa.Table.from_pylist(out, KEYS_ARROW)

    return parts.groupBy("bucket").applyInArrow(work, KEYS)


def unpack_shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted joined keys of one block and their totals."""
    rows = [r for r in table.to_pylist() if r["keys"] is not None]
    keys = [joined_key(np.full(len(r["keys"]) // 4, r["bucket"], np.uint64), np.frombuffer(r["keys"], np.uint32)) for r in rows]
    totals = [np.frombuffer(r["counts"], np.uint32) for r in rows]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    keys, totals = np.concatenate(keys), np.concatenate(totals)
    order = np.argsort(keys)
    return keys[order], totals[order]


def look_up(wanted: np.ndarray, keys: np.ndarray, totals: np.ndarray, default: int) -> np.ndarray:
    """The totals of joined keys; ``default`` where a key is not listed."""
    if not len(keys):
        return np.full(len(wanted), default, np.uint32)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, totals[place], np.uint32(default))
