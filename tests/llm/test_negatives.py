import random

import numpy as np
from pyspark.sql import functions as F

from marketladder.llm import negatives
from marketladder.llm.negatives import Mining

SCHEMA = "id bigint, label int, vector array<bigint>, copy string, size int, block int, anchor string"


def frame(spark, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def plain(rows, rule=Mining(), anchor=lambda i: i is not None and i % 5 == 0):
    rows = [(i, label, list(v)) for i, label, v in {(i, label, tuple(v)) for i, label, v in rows if label is not None and v is not None and None not in v}]
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for i, label, v in rows:
        if not anchor(i):
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), other) for j, other, w in rows if j != i and len(w) == len(v)]
        for p, score, _ in sorted((x for x in scored if x[2] == label), key=order)[: rule.positives]:
            near = [x for x in scored if x[2] != label and rule.low * score <= 100 * x[1] <= rule.high * score]
            out += [(i, p, rank + 1, n, score, s) for rank, (n, s, _) in enumerate(sorted(near, key=order)[: rule.negatives])]
    return sorted(out, key=repr)


def found(spark, rows, rule=Mining()):
    got = negatives.mine(frame(spark, rows), F.col("id") % 5 == 0, rule)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made(seed, n, size, labels, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, size))
    label = np.where(rng.random(n) < 0.35, 0, rng.integers(0, labels, n))
    vectors = np.floor(40 * (centres[label] + spread * rng.standard_normal((n, size)))).astype(int)
    return [(i, int(x), [int(y) for y in v]) for i, (x, v) in enumerate(zip(label, vectors))]


def test_agrees_with_the_plain_join(spark):
    small = Mining(slice=70, block=20, chunk=3)
    for seed, n, size, labels, spread in [(1, 300, 16, 4, 1.0), (2, 200, 7, 6, 1.5), (3, 150, 20, 30, 3.0)]:
        rows = made(seed, n, size, labels, spread)
        assert plain(rows) and found(spark, rows, small) == plain(rows)


def test_edge_rows(spark):
    rows = [
        (0, 1, [3, 4]), (0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [3, 3]), (2, 2, [3, 2]), (3, 1, [0, 0]), (4, 2, [0, 0]), (5, 1, [0, 0]),
        (6, None, [3, 4]), (7, 1, None), (8, 1, [1, None]), (None, 1, [3, 4]), (None, 2, [2, 3]), (None, 2, [2, 3]), (10, 1, []), (11, 1, []), (12, 2, []),
        (15, 3, [-1, -1]), (16, 3, [5, 5]), (20, 1, [1, 2, 3]), (25, 9, [10**12, 10**12]), (26, 9, [10**12, 3]), (27, 8, [10**12, 10**10]), (10, 5, [3, 4]),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, rows[:1]) == []


def test_ties_and_windows_at_their_borders(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.choice([0, 10, 20, 19, 95, 50, 100])]) for i in range(200)]
    assert found(spark, rows, Mining(slice=30, chunk=1)) == plain(rows)


def test_the_index_leaves_out_what_norms_cover():
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((500, 32)) * np.linspace(200, 1, 32)).astype(np.int64)
    own = negatives.Slice(np.arange(500), np.zeros(500, np.int64), vectors, 4)
    turned = vectors[3:5][:, own.turn].astype(float)
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    scores = vectors @ vectors[3:5].T / own.largest / np.linalg.norm(vectors[3:5], axis=1)
    reach = lambda share: own.posted(share, np.arange(500)).reaching(turned.astype(np.float32), own.norms(turned), np.full(2, share))
    for share in (0.7, 0.2, 0.0):
        for i, got in enumerate(reach(share)):
            assert set(np.flatnonzero(scores[:, i] >= share)) <= set(got) and len(set(got)) == len(got)
    posted = lambda share: sum(len(c) for c in own.posted(share, np.arange(500)).chunks)
    assert posted(0.7) < posted(0.2) < posted(0.0) == 500 * 8
    assert len(reach(0.7)[0]) < 100


def test_quantising_takes_the_floor_in_double_precision(spark):
    df = spark.createDataFrame([([0.1, -0.1, 1.0],), ([float("nan")],), ([float("inf")],), ([None],), (None,)], "e array<float>")
    rows = df.filter(negatives.usable(F.col("e"))).select(negatives.quantised(F.col("e"))).collect()
    assert [r[0] for r in rows] == [[25, -26, 256]]
