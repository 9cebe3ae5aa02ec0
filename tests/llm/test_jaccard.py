import random

import numpy as np
import pytest

from marketladder.llm import jaccard
from marketladder.llm.components import components
from marketladder.llm.words import shingle_hashes, word_hashes
from tests.llm.helpers import linked_groups, shingles, table


def documents(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.choice([5, 8, 12, 40, 120, 300]))] for _ in range(10)]
    rows = []
    for i in range(220):
        r = rng.random()
        found = list(rng.choice(bases[:3] if r < 0.4 else bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, len(found) // 60, len(found) // 30])):
            found[rng.randrange(len(found))] = rng.choice(words) + rng.choice(["", "x", "Y"])
        text = " ".join(found + common if r > 0.8 else found)
        if rng.random() < 0.05:
            text = rng.choice([None, "", " \n", "one", "two words", "A b c"])
        rows.append((rng.choice([i] * 7 + [None]) if rng.random() > 0.02 else i // 2, text.upper() if text and rng.random() < 0.1 else text))
    return rows + rows[:5]


def wanted(rows, words, share):
    sets, group = linked_groups(rows, words, share)
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return [(doc, len(s), least.get(g) if s else doc) for (doc, _), s, g in zip(rows, sets, group)], sets, group


@pytest.mark.parametrize("block_bytes, words, share, options", [(8 << 20, 4, 85, {}), (6000, 5, 80, {"frequent": 2, "tile": 5, "spread": 2})])
def test_equals_brute_force(spark, monkeypatch, block_bytes, words, share, options):
    whole = jaccard.block_count
    monkeypatch.setattr(jaccard, "block_count", lambda docs: whole(docs, block_bytes))
    rows = documents(share)
    rule = jaccard.Join(words=words, share=share, **options)
    got = jaccard.join_documents(table(spark, rows), rule).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(wanted(rows, words, share)[0], key=repr)


def test_one_row_of_each_group_stays(spark):
    rows = documents(1)
    docs = table(spark, rows)
    got = jaccard.keep_first(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    _, sets, group = wanted(rows, 5, 80)
    assert len(kept) == len({g for s, g in zip(sets, group) if s}) + sum(not s for s in sets)
    least = {}
    for (doc, _), s, g in zip(rows, sets, group):
        least[g] = min((doc is None, doc or 0), least.get(g, (True, 0)))
    named = sorted(d for d, t in kept if d is not None and shingles(t, 5))
    assert named == sorted(d for g, (unnamed, d) in least.items() if not unnamed and any(s and h == g for s, h in zip(sets, group)))


def test_empty_table(spark):
    assert jaccard.join_documents(table(spark, [])).count() == 0
    assert jaccard.keep_first(table(spark, [])).count() == 0


@pytest.mark.parametrize("options", [{}, {"frequent": 2}, {"frequent": 0, "spread": 1}])
def test_similar_sets_share_an_entry(options):
    """The property that no link is lost: whatever the totals, linked sets share an entry that both may use."""
    rng = np.random.default_rng(5)
    for share in (85, 80):
        rule = jaccard.Join(share=share, **options)
        for _ in range(300):
            n = int(rng.integers(4, 200))
            both = np.unique(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
            x, y = both[:n], both[int(rng.integers(0, max(1, n // 6))) :][:n]
            if rng.random() < 0.5:
                y = y[: len(y) - int(rng.integers(0, max(1, n // 8)))]
            same = len(np.intersect1d(x, y))
            if 100 * same < share * (len(x) + len(y) - same) or (len(x) == len(y) == same):
                continue
            total = {int(t): int(rng.integers(1, 6)) for t in np.union1d(x, y)}
            total |= {int(t): max(2, total[int(t)]) for t in np.intersect1d(x, y)}
            entries = [dict(zip(*map(list, jaccard.index_entries(s, np.array([total[int(t)] for t in s]), rule)))) for s in (x, y)]
            small, large = entries if len(x) <= len(y) else entries[::-1]
            assert any(early and e in large for e, early in small.items()) or (len(x) == len(y) and any(early and e in small for e, early in large.items()))


def test_hashes_follow_words():
    text = "The  quick\tbrown FOX é\nthe quick brown fox É the quick"
    words = word_hashes(np.frombuffer(text.encode(), np.uint8))
    names = text.split()
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in names]
    assert len(words) == len(names)
    assert all((words[i] == words[j]) == (low[i] == low[j]) for i in range(len(low)) for j in range(len(low)))
    for length in (1, 2, 4, 20):
        assert len(shingle_hashes(words, length)) == len(shingles(text, length))
    assert not len(word_hashes(np.zeros(0, np.uint8))) and not len(shingle_hashes(words[:0], 4))


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    from marketladder.llm import words

    data = np.frombuffer(("some words " * 50 + "x" * 300 + " end").encode(), np.uint8)
    want = word_hashes(data)
    monkeypatch.setattr(words, "STRETCH", 64)
    assert (words.word_hashes(data) == want).all()


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 1999)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    parent = {n: n for link in links for n in link}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    alone = {n for n in parent if all(n not in link or link[0] == link[1] for link in links)}
    assert got == {n: c for n, c in parent.items() if n not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_third_of_equal_rows(spark, monkeypatch):
    """Rows that repeat id and text go through the blocks once: every row has its group, and one of each group stays."""
    from marketladder.llm import blocks

    monkeypatch.setattr(jaccard, "combined", lambda docs, name: blocks.combined(docs, name, 1))
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {'end' if i % 2 else 'stop'}") for i in range(5)] + [(20 + i, f"{i} own words of {i * i} its own {i}") for i in range(10)]
    rows += [(2, words)] * 400 + [(None, words)] * 100 + [(21, "four words of text here")] * 100 + [(40, None)] * 100 + [(41, " ")] * 3
    got = jaccard.join_documents(table(spark, rows)).collect()
    sets, group = linked_groups(rows, 4, 85)
    least = {g: min((d for (d, _), o in zip(rows, group) if o == g and d is not None), default=None) for g in group}
    expected = [(d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, group)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(table(spark, rows)).collect()]
    assert sum(d in (40, 41) for d, _ in kept) == 103
    assert sorted(d for d, _ in kept if d not in (40, 41)) == sorted([0, *range(20, 30), 21])
