import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marketladder.llm import merkle, queries
from tests.llm.helpers import SCHEMA, table

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(show(v) for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Root, and for each leaf the runs it goes through as (left, right) siblings."""
    ways, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, at in zip(ways, where):
            start = at - at % 16
            way.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 16])))
        where = [at // 16 for at in where]
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0] if nodes else None, ways


def plain(rows):
    """Expected (doc_id, leaf, subroot, root, proof, folded root) of (doc_id, text, lang, source, n_chars) rows."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by_source = []
    for source in sources:
        own = [(r[0], leaf(r[0], r[3], r[2], r[4], r[1]), r) for r in rows if r[3] == source]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        by_source.append((own, *plain_tree([x[1] for x in own])))
    root, tops = plain_tree([s[1] for s in by_source])
    out = []
    for (own, subroot, ways), top in zip(by_source, tops):
        for (doc_id, digest, r), way in zip(own, ways):
            text = r[1]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = leaf(doc_id, r[3], r[2], r[4], text)
            for left, right in [*way, *top]:
                node = H(left + node + right)
            out.append((doc_id, digest, subroot, root, H("".join(a + b for a, b in [*way, *top])), node))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in rows), key=repr)


def manifest(df):
    return queries.signed(df)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "x") for r in rows], SCHEMA)


def test_edge_rows(spark):
    rows = [
        (5, "Abc", "en", "b", 3), (5, "Abc", "en", "b", 3), (5, "abc", "en", "b", 3), (None, "X", None, None, None), (None, None, "en", "b", 1),
        (10, "É Ü ß 漢字 \x00", "de", "ü", 9), (0, "", "en", "", 0), (19, "LONG " * 100_000, "en", "a", 500_000), (-3, "Neg", "en", "Z", 3),
    ]
    assert found(manifest(frame(spark, rows))) == plain(rows)
    assert found(manifest(frame(spark, rows[:1]))) == plain(rows[:1])
    assert manifest(frame(spark, [])).collect() == []


def test_one_source_over_several_blocks_and_many_small_ones(spark, monkeypatch):
    """A block of one level, so that trees of a few hundred leaves have several layers; versions in chunks of 8 leaves."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(merkle, "CHUNK", 8)
    monkeypatch.setattr(merkle, "RANGE", 50)
    rng = random.Random(4)
    rows = [(i, f"Text {rng.random()}", "en", "hot" if i % 3 == 0 else f"s{rng.randrange(40)}", 5) for i in range(900)]
    assert found(manifest(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("n", [15, 16, 17, 256, 257])
def test_run_borders(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, f"T{i}", "en", "one", 2) for i in range(n)]
    assert found(manifest(frame(spark, rows))) == plain(rows)


def test_a_third_of_equal_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 300)
    rows = [(7, "Same", "en", "s", 4)] * 2000 + [(i, f"Text {i}", "en", "s", 6) for i in range(4000)]
    df = frame(spark, rows)
    assert found(manifest(df)) == plain(rows)
    leaves = merkle._numbered(df.select(F.lit("=s").alias("key"), "doc_id", merkle.leaf_of(F.col("text")).alias("leaf"), F.lit(None).cast("string").alias("changed"), F.monotonically_increasing_id().alias("salt")))
    assert sorted(r.pos for r in leaves.collect()) == list(range(6000))


def test_versions_share_what_is_not_above_the_leaf():
    leaves = [H(str(i)) for i in range(300)]
    tree = merkle.Tree(leaves, alone=True)
    path = tree.version(77, H("other"))
    assert len(path) == len(tree.levels) and tree.levels[0] == leaves
    changed = [*leaves[:77], H("other"), *leaves[78:]]
    assert path[-1] == merkle.Tree(changed, alone=True).root != tree.root


def test_whole_proofs_fold_to_the_root(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 3}", 2) for i in range(40)]
    out = merkle.manifest(table(spark, [(r[0], r[1]) for r in rows]), F.col("text"), whole_proofs=True).collect()
    assert all(r.verified and len(r.proof) % 64 == 0 for r in out) and len(out) == 40
