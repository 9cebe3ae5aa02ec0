import random

import numpy as np

from marketladder.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, copy int, slice int"


def brute(rows, queries, k):
    fine = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for qi, q in fine:
        if queries(qi):
            found = []
            for i, v in fine:
                if i != qi and len(v) == len(q):
                    total = 0.0
                    for a, b in zip(q, v):
                        total += a * b
                    found.append((-total, i))
            out += [(qi, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def vectors(n=700, size=24):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, size))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.4 * rng.normal(size=size)]) for i in range(n)]
    rows += [(n + i, rows[20][1]) for i in range(60)]  # one vector often
    rows += [rows[5], rows[40]]  # repeated rows
    rows += [(2000, None), (2001, [0.0] * size), (2020, [float("nan")] + [1.0] * (size - 1)), (2040, [None] + [1.0] * (size - 1))]
    rows += [(2060, [float("inf")] * size), (None, rows[1][1]), (2080, [1.0, 2.0]), (2100, [2.0, 1.0]), (2120, [1.0])]
    random.Random(1).shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)


def search(spark, rows, index):
    table = frame(spark, rows)
    return sorted(map(tuple, neighbours.search(table, table.filter("vec_id % 20 = 0"), 20, index).collect()))


def test_recall_against_brute_force(spark):
    rows = vectors()
    want = brute(rows, lambda i: i % 20 == 0, 20)
    for index in (neighbours.Index(), neighbours.Index(slice=100, block=16)):
        got = search(spark, rows, index)
        assert len(got) == len(want)
        assert len(set(got) & set(want)) >= 0.98 * len(want)


def test_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 50)]
    got = search(spark, rows, neighbours.Index(slice=7))
    assert got == brute(rows, lambda i: i % 20 == 0, 20)
    assert search(spark, rows[:3], neighbours.Index()) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert search(spark, [(0, [1.0])], neighbours.Index()) == []
    assert search(spark, [], neighbours.Index()) == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    data, asked = rng.normal(size=(400, 64)), rng.normal(size=(50, 64))
    for bits, size in ((64, 8), (256, 32)):
        codes = neighbours.Codes.of(data, neighbours.Index(bits=bits))
        estimate, error = codes.bounds(asked, 3.0)
        assert codes.bits.shape == (400, size)
        assert (np.abs(estimate - asked @ data.T) <= error).mean() > 0.99
    turn = neighbours.rotation(64, 256, 11)
    assert np.allclose(turn @ turn.T, np.eye(64))
