"""A Merkle manifest of documents, and what tampering with a document makes of it.

Leaves are numbered by source and id over sorted ranges, so neither a hot source
nor a hot id is one task's.  The tree of a source is cut into aligned blocks of
16 x 16 x 16 leaves; a block is built by one task, its root is a leaf of a block
above, up to the source's subroot, and the subroots are the leaves of one more
tree.  A tampered leaf creates a version of its block: the ancestors inside the
block are copied, all other nodes are shared with the untampered tree.  The
version's block root then enters the block above, where again only its ancestors
are copied, until each version has a root of its own.  Versions that meet in one
block above are dealt to tasks by chunks of leaves; each gets the block's nodes.
Proofs go the other way: a block hands each of its leaves the siblings from there
to the root.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketladder.session import stored

#: Nodes of a run, leaves of an aligned block, leaves whose versions one task takes further, rows of a sorted range.
RUN, DEPTH, CHUNK, RANGE = 16, 3, 1 << 14, 1 << 16
BLOCK = RUN**DEPTH
#: Rows of the streams: kind -1 what is above a block, 0 its nodes, 1 versions that enter at a node.
ROW = (
    "grp bigint, block bigint, chunk bigint, kind int, pos bigint, n bigint, first bigint, last bigint, "
    "leaf_grp bigint, leaf_pos bigint, digest string, above string, subroot string, doc_id bigint"
)
UP = pa.schema([(n, pa.int64()) for n in ("kind", "grp", "pos", "n", "first", "last", "leaf_grp", "leaf_pos")] + [("digest", pa.string())])
UP_SQL = "kind bigint, grp bigint, pos bigint, n bigint, first bigint, last bigint, leaf_grp bigint, leaf_pos bigint, digest string"
DOWN_SQL = "grp bigint, pos bigint, above string, subroot string"
RESULT = "doc_id bigint, leaf string, subroot string, proof string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """The nodes of one block, level by level; alone if the block is the whole tree."""

    def __init__(self, leaves: list[str], alone: bool):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if alone else len(self.levels) <= DEPTH:
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> str:
        """The others of the run of each node on the way up from a leaf."""
        found = []
        for nodes in self.levels[:-1]:
            start = at - at % RUN
            found += nodes[start:at], nodes[at + 1 : start + RUN]
            at //= RUN
        return "".join(x for part in found for x in part)

    def version(self, at: int, leaf: str) -> list[str]:
        """The copied nodes of a version with another leaf at ``at``, leaf first, root last; it shares the rest."""
        path = [leaf]
        for nodes in self.levels[:-1]:
            start = at - at % RUN
            path.append(digest("".join([*nodes[start:at], path[-1], *nodes[at + 1 : start + RUN]])))
            at //= RUN
        return path


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from rows sorted by key; a key has a bounded number of rows."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = np.stack([table.column(k).to_numpy() for k in keys])
        if held and any(held[-1].column(k)[-1].as_py() != int(v) for k, v in zip(keys, key[:, 0])):
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), table.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if held and start:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(start, end - start))
    if held:
        yield pa.concat_tables(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, list], Tree, range, range, range]]:
    """Columns, tree, and the rows of what is above, of nodes and of versions, for each block."""
    for table in _runs(batches, ["grp", "block", "chunk"]):
        kind = table.column("kind").to_numpy()
        a, b = int((kind < 0).sum()), int((kind < 1).sum())
        if a == len(kind):  # of an empty table there is only what is above
            continue
        rows = table.to_pydict()
        tree = Tree(rows["digest"][a:b], alone=rows["n"][a] <= BLOCK)
        yield rows, tree, range(a), range(a, b), range(b, len(kind))


def _rows(df: DataFrame, **values: Column) -> DataFrame:
    """Rows of ``ROW``; what is not given is null, the block follows from the place."""
    known = {c: F.col(c) for c in df.columns} | {"block": F.floor(F.col("pos") / BLOCK), "chunk": F.lit(0)} | values
    columns = [field.split() for field in ROW.split(", ")]
    return df.select(*[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in columns])


def _streamed(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    keys = ["grp", "block", "chunk"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "pos").mapInArrow(work, schema)


# ---- upwards: roots and versions ---------------------------------------------------------------------------------


def _raise(chunked: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tree, _, nodes, versions in _blocks(batches):
            out: list[tuple] = []
            grp, block, start = rows["grp"][0], rows["block"][0], rows["block"][0] * BLOCK
            more = -(-rows["n"][nodes[0]] // BLOCK)
            first, last = min(rows["first"][i] for i in nodes), max(rows["last"][i] for i in nodes)
            if not chunked or rows["chunk"][0] == first // CHUNK:  # of several tasks with these nodes one passes the root on
                out.append((0, grp, block, more, first, last, None, None, tree.root))
            for i in versions:
                root = tree.version(rows["pos"][i] - start, rows["digest"][i])[-1]
                out.append((1, grp, block, more, rows["first"][i], rows["last"][i], rows["leaf_grp"][i], rows["leaf_pos"][i], root))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), UP)], schema=UP)

    return work


def _climb(nodes: DataFrame, versions: DataFrame, chunked: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Layers of nodes, and what each layer of blocks leaves as finished trees: roots (kind 0) and versions (kind 1).

    The number of layers is the logarithm of the largest tree to the base 4,096.
    """
    layers, done = [], []
    while True:
        layers.append(nodes)
        sent, moved = _rows(nodes, kind=F.lit(0)), _rows(versions, kind=F.lit(1))
        if chunked:
            block = Window.partitionBy("grp", "block")
            chunks = F.sequence(F.floor(F.min("first").over(block) / CHUNK), F.floor(F.max("last").over(block) / CHUNK))
            sent = sent.withColumn("chunks", chunks).withColumn("chunk", F.explode("chunks")).drop("chunks")
            moved = moved.withColumn("chunk", F.floor(F.col("first") / CHUNK))
        out = stored(_streamed(sent.unionByName(moved), _raise(chunked), UP_SQL))
        done.append(out.filter("n = 1"))
        left = out.filter("n > 1")
        if left.isEmpty():
            return layers, done
        nodes, versions, chunked = left.filter("kind = 0"), left.filter("kind = 1"), True


# ---- downwards: proofs -------------------------------------------------------------------------------------------


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is above each node of a block."""
    for rows, tree, _, nodes, _ in _blocks(batches):
        above = [tree.siblings(i - nodes[0]) + rows["above"][0] for i in nodes]
        subroot = [rows["subroot"][0]] * len(nodes)
        columns = [rows["grp"][nodes[0] :], rows["pos"][nodes[0] :], above, subroot]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["grp", "pos", "above", "subroot"])


def _finish(root: str | None, whole: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tree, _, nodes, versions in _blocks(batches):
            folded = {rows["pos"][i]: rows["digest"][i] for i in versions}
            for at in range(0, len(nodes), 512):  # a proof may have many kilobytes
                part = nodes[at : at + 512]
                proof = [tree.siblings(i - nodes[0]) + rows["above"][0] for i in part]
                columns = [
                    rows["doc_id"][part[0] : part[-1] + 1], rows["digest"][part[0] : part[-1] + 1], [rows["subroot"][0]] * len(part),
                    proof if whole else [digest(p) for p in proof], [folded.get(rows["pos"][i], root) for i in part],
                ]
                kinds = [pa.int64(), *[pa.string()] * 4]
                names = ["doc_id", "leaf", "subroot", "proof", "folded_root"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return work


# ---- leaves ------------------------------------------------------------------------------------------------------


def leaf_of(text: Column) -> Column:
    """H of the fields of a row of ``documents``, with ``text`` in place of its text."""

    def field(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.sha2(F.concat(*[field(x) for x in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)]), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with source number, place in the source, leaves of the source, place in all; equal rows are told apart by ``salt``."""
    leaves = stored(leaves)
    ranges = max(1, -(-leaves.count() // RANGE))
    order = ["key", "doc_id", "leaf", "salt"]
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # place in the partition
    placed = stored(
        leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .select("key", "doc_id", "leaf", "changed", F.spark_partition_id().alias("pid"), index.alias("idx"))
    )
    # a source has a row for each range it is in, a range one for each source in it
    parts = placed.groupBy("pid", "key").agg(F.count(F.lit(1)).alias("rows"), F.min("idx").alias("start"))
    of_source, earlier = Window.partitionBy("key"), Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("*", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(of_source).alias("n"))
    sizes = parts.groupBy("pid").agg(F.sum("rows").alias("rows"), F.sum((F.col("before") == 0).cast("bigint")).alias("fresh"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = sizes.select("pid", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("rows", "fresh")])
    number = F.sum((F.col("before") == 0).cast("bigint")).over(Window.partitionBy("pid").orderBy("start"))
    parts = parts.withColumn("number", F.when(F.col("before") == 0, number - 1)).join(bases, "pid")
    parts = parts.withColumn("grp", F.max(F.col("fresh_ahead") + F.col("number")).over(of_source)).drop("rows", "fresh_ahead", "number")
    place = F.col("rows_ahead") + F.col("idx")
    return placed.join(parts, ["pid", "key"]).select(
        "grp", (F.col("before") + F.col("idx") - F.col("start")).alias("pos"), "n", place.alias("first"), place.alias("last"),
        "doc_id", F.col("leaf").alias("digest"), "changed",
    )


def manifest(docs: DataFrame, claimed: Column, whole_proofs: bool = False) -> DataFrame:
    """Leaf, subroot, root, proof and folded root of every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are
    ignored.  ``claimed`` is the text a row claims to have: where its leaf
    differs from the true one, ``folded_root`` is the root of the version with
    that leaf, else it equals ``root``; ``verified`` tells whether both agree.
    ``proof`` is the digest of the siblings of the way from leaf to root, or
    with ``whole_proofs`` the siblings themselves, 64 characters each.

    Each row is a leaf, repeated ones too.  Leaves of a source ascend by id, a
    null id first, those of one id by leaf; a null source comes first.  Null
    fields are part of the leaf.  A lone leaf is its source's subroot, and a
    lone subroot the root.  An empty table gives an empty result.
    """
    leaf, changed = leaf_of(F.col("text")), leaf_of(claimed)
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # a null before all others
    rows = docs.select(
        source.alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf.alias("leaf"),
        F.when(~claimed.eqNullSafe(F.col("text")), changed).alias("changed"), F.monotonically_increasing_id().alias("salt"),
    )
    leaves = stored(_numbered(rows))
    versions = leaves.filter("changed IS NOT NULL").select(
        "grp", "pos", "n", "first", "last", F.col("grp").alias("leaf_grp"), F.col("pos").alias("leaf_pos"), F.col("changed").alias("digest")
    )
    layers, finished = _climb(leaves.select("grp", "pos", "n", "first", "last", "digest"), versions, chunked=False)

    sources = sum(d.filter("kind = 0").count() for d in finished)
    tops = None
    for d in finished:
        top = d.withColumns({"pos": F.col("grp"), "grp": F.lit(0).cast("bigint"), "n": F.lit(sources).cast("bigint")})
        tops = top if tops is None else tops.unionByName(top)
    top_layers, top_finished = _climb(tops.filter("kind = 0"), tops.filter("kind = 1"), chunked=True)
    first = top_finished[-1].filter("kind = 0").first()
    root = first.digest if first else None

    def header(above: DataFrame, block: str = "pos") -> DataFrame:
        return _rows(above, kind=F.lit(-1), block=F.col(block), pos=F.lit(-1))

    above = docs.sparkSession.createDataFrame([(0, 0, "", "")], DOWN_SQL)
    for nodes in reversed(top_layers):
        above = _streamed(_rows(nodes, kind=F.lit(0)).unionByName(header(above)), _lower, DOWN_SQL)
    roots = [f.filter("kind = 0").select("grp", F.col("digest").alias("subroot")) for f in finished]
    by_source = stored(above.select(F.col("pos").alias("grp"), "above"))
    headers = None
    for depth in reversed(range(len(layers))):
        ends = header(by_source.join(roots[depth], "grp").withColumn("zero", F.lit(0)), "zero")
        headers = ends if headers is None else headers.unionByName(ends)
        if depth:
            lower = _streamed(_rows(layers[depth], kind=F.lit(0)).unionByName(headers), _lower, DOWN_SQL)
            headers = header(lower)
    folded = top_finished[-1].filter("kind = 1").select(F.col("leaf_grp").alias("grp"), F.col("leaf_pos").alias("pos"), "digest")
    final = _rows(leaves, kind=F.lit(0)).unionByName(headers).unionByName(_rows(folded, kind=F.lit(1)))
    out = _streamed(final, _finish(root, whole_proofs), RESULT)
    return out.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
