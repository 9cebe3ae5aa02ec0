import zlib

from pyspark.sql import functions as F

from marketladder.llm import shards
from tests.llm.helpers import table


def placed(spark, tree, n=8000):
    rows = spark.range(n).select("id", shards.shard_of(F.col("id"), tree).alias("s")).collect()
    return {r.id: r.s for r in rows}


def test_growth_takes_rows_only_into_the_new_shard(spark):
    before, after = placed(spark, shards.EIGHT), placed(spark, shards.grown(shards.EIGHT))
    moved = [i for i in before if before[i] != after[i]]
    assert {after[i] for i in moved} == {8}
    assert 8000 / 9 * 0.85 < len(moved) < 8000 / 9 * 1.15


def test_shares_follow_the_weights(spark):
    tree = [("a", "a1", 0, 1.0), ("a", "a2", 1, 2.0), ("b", "b1", 2, 4.0), ("b", "b2", 3, 1.0), ("b", "b2", 4, 0.0)]
    found = list(placed(spark, tree).values())
    for shard, weight in ((0, 1), (1, 2), (2, 4), (3, 1)):
        assert abs(found.count(shard) / 8000 - weight / 8) < 0.02
    assert 4 not in found


def test_a_changed_weight_moves_rows_only_through_its_subtree(spark):
    tree = [("a", "a1", 0, 1.0), ("a", "a2", 1, 1.0), ("b", "b1", 2, 1.0), ("b", "b2", 3, 1.0)]
    less = [*tree[:3], ("b", "b2", 3, 0.5)]
    before, after = placed(spark, tree), placed(spark, less)
    region = {0: "a", 1: "a", 2: "b", 3: "b"}
    assert all(before[i] == after[i] for i in before if before[i] in (0, 1))  # nothing leaves or changes in region a
    assert all(region[after[i]] == "a" or after[i] == 2 for i in before if before[i] == 3 and after[i] != 3)


def test_documents(spark):
    rows = [(i, "é" * (i % 7)) for i in range(500)] + [(3, "x"), (3, "x"), (None, "y"), (7, None), (9, "z" * 100_000)]
    got = shards.assign(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        by_id.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    assert shards.assign(table(spark, [])).count() == 0


def test_a_hot_id_is_dealt_to_many_blocks(spark):
    """A third of the rows has one id: its shard is numbered block by block, without gaps."""
    rows = [(i, f"text {i}") for i in range(1000)] + [(5, "again")] * 600 + [(None, None)] * 300
    docs = table(spark, rows)
    got = shards.assign(docs, block_rows=100).collect()
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((d, len(t) + 1) for d, t in rows if d is not None)
    assert sum(r.doc_id is None for r in got) == 300
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
