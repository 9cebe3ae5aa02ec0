"""Jaccard join of word shingles, by token-combination prefixes.

The shingles of a document are its tokens.  Tokens are ordered from the rarest
to the most frequent; of a document that may lack at most ``t`` of its tokens in
a partner, the first tokens are indexed until ``t + 1`` of them could not all be
missing.  A rare token is indexed by itself.  Frequent tokens are dealt into
small classes, and in a class of ``m`` tokens all pairs are indexed, which
``m - 1`` missing tokens can destroy; so the prefix is extended by one token a
class.  Two linked documents always share an indexed token or pair.  Tokens that
occur once can't be shared: they use up ``t`` but are not indexed, so most
documents are done before anything is joined.

Documents with equal sets are one class from the start.  Candidates are found
in two rounds: first each document with one leader per index entry, which joins
groups of copies by as many comparisons as they have members; then all pairs
within an entry whose documents are still in different components.  Sizes,
tokens that occur once and a small count sketch rule out pairs before the exact
comparison.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marketladder.llm.blocks import (
    OWN_KEYS, block_count, bucket_count, combined, free_name, in_blocks, joined_key, look_up, pack_keys, shared_keys, split_key, unpack_shared,
)
from marketladder.llm.components import components
from marketladder.llm.memory import frugal, frugal_stream
from marketladder.llm.words import mixed, shingle_hashes, word_hashes
from marketladder.session import stored

WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Join:
    """Linked: share / whole of the union or more is common.

    frequent: a token in more documents than this is indexed in pairs; spread:
    tokens of a class of pairs, about; sketch: counters of a document; tile:
    documents of one index entry compared in one step with each other.
    """

    words: int = 4
    share: int = 85
    whole: int = 100
    frequent: int = 32
    spread: int = 4
    sketch: int = 512
    tile: int = 1024

    def common(self, both):  # noqa: ANN001, ANN201
        """Least intersection of two sets whose sizes add up to ``both``."""
        return -(-self.share * both // (self.share + self.whole))

    def missing(self, n: int) -> int:
        """How many of ``n`` tokens a partner may lack."""
        return n - -(-self.share * n // self.whole)

    def missing_in_larger(self, n: int) -> int:
        """How many of ``n`` tokens a partner of at least the same size may lack."""
        return n - int(self.common(2 * n))

    def sizes(self, n: int) -> tuple[int, int]:
        """Smallest and largest size of a partner."""
        return -(-self.share * n // self.whole), n * self.whole // self.share


def token_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return shingle_hashes(word_hashes(np.frombuffer((text or "").encode(), np.uint8)), words)


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


# ---- index entries of one document ---------------------------------------------------------------------------------


def _pairs_within(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (earlier, later) of all pairs within a class."""
    by = np.argsort(classes, kind="stable")
    cuts = np.flatnonzero(np.r_[True, classes[by][1:] != classes[by][:-1]]) if len(by) else []
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, end in zip(cuts, [*cuts[1:], len(by)]):
        a, b = np.triu_indices(end - start, 1)
        left.append(by[start + a])
        right.append(by[start + b])
    return np.concatenate(left), np.concatenate(right)


def index_entries(tokens: np.ndarray, totals: np.ndarray, rule: Join) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries of a set, and whether each is among those that find partners of its size and larger.

    How many classes frequent tokens are dealt into depends on the power of two
    below the size; a set is indexed for every power its partners may have.
    """
    n = len(tokens)
    order = np.lexsort((tokens, totals))
    tokens, totals = tokens[order], totals[order]
    frequent = totals > rule.frequent
    most, fewer = rule.missing(n) + 1, rule.missing_in_larger(n) + 1
    entries, early = [], []
    low, high = rule.sizes(n)
    for band in range(low.bit_length() - 1, high.bit_length()):
        classes = max(1, (1 << band) * (rule.whole - rule.share) // (rule.whole * rule.spread))
        where = np.flatnonzero(frequent)
        own = mixed(tokens[where] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(classes)
        gain = np.ones(n, np.int64)
        gain[where[np.unique(own, return_index=True)[1]]] = 0  # the first of a class can't be missed yet
        gain = np.cumsum(gain)
        end, inner = (int(np.searchsorted(gain, g)) + 1 for g in (most, fewer))
        single = np.flatnonzero(~frequent[:end] & (totals[:end] > 1))
        entries.append(mixed(tokens[single]))
        early.append(single < inner)
        inside = where < end
        left, right = _pairs_within(own[inside])
        left, right = where[inside][left], where[inside][right]
        entries.append(mixed(mixed(tokens[left] + np.uint64(band + 1)) + tokens[right]))
        early.append(right < inner)
    entries, early = np.concatenate(entries), np.concatenate(early)
    by = np.lexsort((~early, entries))
    entries, early = entries[by], early[by]
    first = np.r_[True, entries[1:] != entries[:-1]] if len(entries) else np.zeros(0, bool)
    return entries[first], early[first]


# ---- the job -------------------------------------------------------------------------------------------------------

MEMBERS = "block int, doc_id bigint, n_shingles bigint, digest binary"
ACTIVE = "node bigint, n int, once int, sketch binary, tokens binary, entries binary, early binary"
ENTRIES = "entry bigint, node bigint, n int, once int, early boolean"


def _members(blocks: DataFrame, rule: Join) -> DataFrame:
    """Size and digest of every row's set; no digest without words."""

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [token_set(t.as_py(), rule.words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())],
                ["block", "doc_id", "n_shingles", "digest"],
            )

    return stored(blocks.select("block", "doc_id", "text").mapInArrow(work, MEMBERS))


def _classes(members: DataFrame) -> DataFrame:
    """One row per distinct set: the node that names it, its smallest id, and the block of a row with that id."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "block"))
    rows = members.filter("digest IS NOT NULL").groupBy("digest").agg(least.alias("r"))
    return rows.select("digest", F.xxhash64("digest").alias("node"), "r.doc_id", "r.block")


def _named(block: DataFrame) -> DataFrame:
    """Rows that tell a block which of its documents stand for a class."""
    name = F.to_json(F.struct("doc_id", "node", F.hex("digest").alias("digest")))
    nothing = {"bucket": "int", "keys": "binary", "counts": "binary"}
    return block.select("block", *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()], name.alias("name"))


def _standing(texts: pa.Table, named: pa.Table, rule: Join) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, node and set of the documents of a block that stand for a class."""
    names = [json.loads(n) for n in named.column("name").to_pylist() if n is not None]
    nodes = {(n.get("doc_id"), n["digest"]): n["node"] for n in names}
    ids = {doc for doc, _ in nodes}
    for row, (doc, text) in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("text"))):
        if doc in ids:
            tokens = token_set(text.as_py(), rule.words)
            node = nodes.pop((doc, set_digest(tokens).hex().upper()), None)
            if node is not None:
                yield row, node, tokens


def _with_words() -> Column:
    return F.coalesce(F.col("text").rlike(WORD), F.lit(False))


def _active(blocks: DataFrame, number: int, classes: DataFrame, rule: Join) -> DataFrame:
    """The classes that may have a partner, with their sets and index entries; ``number`` blocks."""
    count = bucket_count(number, 1)

    @frugal
    def keys(key: tuple, texts: pa.Table, named: pa.Table) -> pa.Table:
        sets = [tokens for _, _, tokens in _standing(texts, named, rule)]
        found, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        return pack_keys(key[0].as_py(), found, counts, count)

    @frugal
    def index(key: tuple, texts: pa.Table, right: pa.Table) -> pa.Table:
        shared, totals = unpack_shared(right)
        rows = []
        for _, node, tokens in _standing(texts, right, rule):
            n = len(tokens)
            if rule.sizes(n) == (n, n):
                continue  # only an equal set could be a partner
            total = look_up(joined_key(*split_key(tokens, count)), shared, totals, 1)
            once = int((total == 1).sum())
            if once > rule.missing(n):
                continue
            entries, early = index_entries(tokens, total, rule)
            sketch = np.minimum(np.bincount((tokens % np.uint64(rule.sketch)).astype(np.int64), minlength=rule.sketch), 255)
            rows.append({
                "node": node, "n": n, "once": once, "sketch": sketch.astype(np.uint8).tobytes(), "tokens": tokens.tobytes(),
                "entries": entries.tobytes(), "early": early.tobytes(),
            })
        kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 4
        return pa.Table.from_pylist(rows, pa.schema(list(zip(["node", "n", "once", "sketch", "tokens", "entries", "early"], kinds))))

    texts = blocks.select("block", "doc_id", "text").groupBy("block")
    named = _named(classes)
    shared = shared_keys(texts.cogroup(named.groupBy("block")).applyInArrow(keys, OWN_KEYS))
    right = shared.withColumn("name", F.lit(None).cast("string")).unionByName(named)
    return texts.cogroup(right.groupBy("block")).applyInArrow(index, ACTIVE)


def _entries(active: DataFrame) -> DataFrame:
    """One row per index entry of a class."""

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                entries = np.frombuffer(r["entries"], np.int64)
                same = lambda v, k, m=len(entries): pa.array([v] * m, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entries), same(r["node"], pa.int64()), same(r["n"], pa.int32()), same(r["once"], pa.int32()), pa.array(np.frombuffer(r["early"], bool))],
                    ["entry", "node", "n", "once", "early"],
                )

    return active.select("node", "n", "once", "entries", "early").mapInArrow(work, ENTRIES)


def _possible(rule: Join, n: tuple[Column, Column], once: tuple[Column, Column]) -> Column:
    """Whether sizes, and the tokens that no other document has, allow a link."""
    sizes = F.least(*n) * rule.whole >= F.greatest(*n) * rule.share
    enough = F.least(n[0] - once[0], n[1] - once[1]) * (rule.share + rule.whole) >= (n[0] + n[1]) * rule.share
    return sizes & enough


def _led(entries: DataFrame, rule: Join) -> DataFrame:
    """Pairs of a document and the leader of an entry: the one with the fewest tokens of its own."""
    leader = F.min(F.struct("once", "node", "n")).alias("l")
    leaders = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("many"), leader).filter("many > 1")
    met = entries.join(leaders, "entry").filter(F.col("node") != F.col("l.node"))
    met = met.filter(_possible(rule, (F.col("n"), F.col("l.n")), (F.col("once"), F.col("l.once"))))
    return met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def _apart(entries: DataFrame, active: DataFrame, found: DataFrame, rule: Join) -> DataFrame:
    """Possible pairs within an entry whose documents are in different components.

    An entry's documents are dealt into chunks; tasks compare a chunk with
    itself or another, so no task holds all documents of a frequent entry.
    """
    placed = entries.join(found.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    chunks = F.ceil(F.count(F.lit(1)) / F.lit(rule.tile)).cast("int").alias("chunks")
    open_entries = placed.groupBy("entry").agg(chunks, F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    rows = stored(placed.join(open_entries.select("entry", "chunks"), "entry").join(active.select("node", "sketch"), "node"))
    groups = F.lit(max(1, -(-rows.count() // 20_000)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    tiles = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select("entry", "node", "n", "once", "early", "sketch", "part", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tiles = tiles.withColumn("task", F.pmod(F.xxhash64("entry", "i", "j"), groups))

    @frugal
    def work(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("entry", "node", "n", "once", "early", "part", "own", "i", "j")}
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(table), -1)
        by = np.lexsort((columns["node"], columns["n"], columns["j"], columns["i"], columns["entry"]))
        columns, sketch = {c: v[by] for c, v in columns.items()}, sketch[by]
        tile = np.stack([columns["entry"], columns["i"], columns["j"]])
        cuts = np.flatnonzero(np.r_[True, (tile[:, 1:] != tile[:, :-1]).any(axis=0)])
        pairs = [np.zeros((0, 2), np.int64)]
        for start, end in zip(cuts, [*cuts[1:], len(by)]):
            for x in range(start, end - 1):
                c = {k: v[x + 1 : end] for k, v in columns.items()}  # sizes of x and larger
                reach = int(np.searchsorted(c["n"] * rule.share, columns["n"][x] * rule.whole, side="right"))
                c = {k: v[:reach] for k, v in c.items()}
                both = c["n"].astype(np.int64) + columns["n"][x]
                need = rule.common(both)
                ok = (c["part"] != columns["part"][x]) & (np.minimum(c["n"] - c["once"], columns["n"][x] - columns["once"][x]) >= need)
                ok &= columns["early"][x] | (c["early"] & (c["n"] == columns["n"][x]))
                if columns["i"][x] != columns["j"][x]:
                    ok &= c["own"] != columns["own"][x]
                y = np.flatnonzero(ok)
                apart = np.abs(sketch[x + 1 + y].astype(np.int16) - sketch[x]).sum(axis=1)
                y = y[apart <= both[y] - 2 * need[y]]
                a, b = np.full(len(y), columns["node"][x]), c["node"][y]
                pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        distinct = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": distinct[:, 0], "b": distinct[:, 1]})

    return tiles.groupBy("task").applyInArrow(work, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, active: DataFrame, rule: Join) -> DataFrame:
    """The pairs whose sets are alike enough, compared exactly."""

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[place] == x).sum())
                linked.append(rule.whole * same >= rule.share * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    side = lambda c: active.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "tokens_a", "tokens_b")
    return met.mapInArrow(work, "a bigint, b bigint")


def _groups(members: DataFrame, blocks: DataFrame, count: int, rule: Join) -> DataFrame:
    """The classes with their component; a class without links is its own."""
    classes = stored(_classes(members))
    active = stored(_active(blocks, count, classes, rule))
    entries = _entries(active)
    led = stored(_led(entries, rule))
    links = stored(_verified(led, active, rule))
    near = components(links)
    more = _verified(_apart(entries, active, near, rule).join(led, ["a", "b"], "left_anti"), active, rule)
    joined = near.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(joined.union(more))
    return classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def join_documents(docs: DataFrame, rule: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per input row.

    A null or empty text has no shingles and is linked with nothing; rows with
    equal sets are linked, rows with one id and different sets only if these
    are alike.  A row without an id has the smallest id it is linked with, or
    null.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    rows, _ = combined(docs.filter(_with_words()), "copy")
    count = block_count(rows)
    members = _members(in_blocks(docs, count), rule)
    grouped = stored(_groups(members, in_blocks(rows, count), count, rule))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = grouped.select("digest", "component").join(smallest, "component").select("digest", "component_id")
    own = members.join(placed, "digest", "left")
    alone = F.when(F.col("digest").isNull(), F.col("doc_id"))
    return own.select("doc_id", "n_shingles", F.coalesce("component_id", alone).alias("component_id"))


def keep_first(docs: DataFrame, rule: Join = Join(words=5, share=80)) -> DataFrame:
    """The rows, with all their columns, of which no other stands for the group.

    Of linked rows the one with the smallest id stays; of several rows with
    that id and the same set one stays.  Rows without words all stay.
    """
    columns, schema, copy = docs.columns, docs.schema, free_name(docs, "copy")
    rows, _ = combined(docs.filter(_with_words()), copy)
    count, name = block_count(rows), free_name(docs, "block")
    blocks = in_blocks(rows.select("doc_id", "text"), count)
    members = _members(blocks, rule)
    first = F.min_by(F.struct("digest", "node", "doc_id", "block"), F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    names = _named(_groups(members, blocks, count, rule).groupBy("component").agg(first.alias("r")).select("r.*"))

    @frugal
    def work(texts: pa.Table, named: pa.Table) -> pa.Table:
        kept = sorted(row for row, _, _ in _standing(texts, named, rule))
        return texts.select(columns).take(pa.array(kept, pa.int64()))

    first_rows = in_blocks(rows, count, name).groupBy(name).cogroup(names.groupBy("block")).applyInArrow(work, schema)
    return first_rows.unionByName(docs.filter(~_with_words()))
