import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from marketladder.llm import packing
from tests.llm.helpers import table

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
OWN = packing.tokenizer(PATH, P.PATTERN)


def test_same_ids_as_the_library():
    rng = random.Random(2)
    texts = ["", "Hello world's  end\n\n\tx", "日本語 🙂 ß", "<|endoftext|> 12 345", "a" * 3000, "\x00\x01"]
    texts += ["".join(rng.choice(["the ", "tion", "é", " 9", "\n", "'ll", "  ", "Ⅷ", "!?"]) for _ in range(80)) for _ in range(200)]
    for text in texts:
        assert OWN.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_no_token_is(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["word", " ", "  ", "\n", " x", "'s", "é", " 77"]) for _ in range(4000))
    want = OWN.encode(text)
    monkeypatch.setattr(packing, "STRETCH", 50)
    assert len(list(packing.stretches(text))) > 50 and "".join(packing.stretches(text)) == text
    assert (OWN.encode(text) == want).all()
    assert OWN.encode("q" * 400).tolist() == LIBRARY.encode("q" * 400, add_special_tokens=False).ids


def test_capacities():
    assert packing.capacities(2048 * 3 + 1029, 2048) == [2048, 2048, 2048, 1024, 4, 1]
    assert packing.capacities(0, 2048) == []


def test_windows_are_full_and_balanced():
    rng = random.Random(8)
    rule = packing.Packing(length=64)
    for _ in range(30):
        sizes = [rng.choice([1, 3, 20, 40, 64, 200]) for _ in range(rng.randint(1, 60))]
        pieces = packing.pack(sizes, rule)
        filled, covered = {}, {}
        for doc, start, length, sequence, offset in pieces:
            assert length > 0
            filled.setdefault(sequence, []).append((offset, length))
            covered.setdefault(doc, []).append((start, length))
        for parts in [*filled.values(), *covered.values()]:
            at = 0
            for begin, length in sorted(parts):
                assert begin == at
                at += length
        assert [sum(n for _, n in covered[d]) for d in range(len(sizes))] == sizes
        totals = [sum(n for _, n in parts) for parts in filled.values()]
        assert all(t == 64 or t & (t - 1) == 0 for t in totals)
    costs = {}
    for _, _, length, sequence, _ in packing.pack([48] * 8 + [16] * 8, rule):
        costs[sequence] = costs.get(sequence, 0) + length + length * length / 2048
    assert max(costs.values()) - min(costs.values()) < 1e-9


def test_each_piece_goes_to_the_cheapest_sequence_with_room():
    rng = random.Random(9)
    rule = packing.Packing(length=64)
    fixed = [[40] * 30 + [3] * 200 + [20] * 30, [64] * 3 + [63, 1], [200, 1, 1]]
    for sizes in fixed + [[rng.randint(1, 90) for _ in range(rng.randint(1, 200))] for _ in range(20)]:
        room = packing.capacities(sum(sizes), 64)
        left, costs, rest = list(room), [0.0] * len(room), {(d, 0): n for d, n in enumerate(sizes)}
        for doc, start, length, s, offset in packing.pack(sizes, rule):
            size = rest.pop((doc, start))
            fits = [i for i in range(len(room)) if left[i] >= size]
            among = fits or [i for i in range(len(room)) if left[i]]
            assert costs[s] == min(costs[i] for i in among) and s in among
            assert length == (size if fits else left[s]) and offset == room[s] - left[s]
            left[s] -= length
            costs[s] += length + length * length / 2048
            if length < size:
                rest[doc, start + length] = size - length
        assert not rest and not any(left)


def test_documents(spark):
    rows = [(i, "some words in a row " * (i * 7 % 90)) for i in range(60)] + [(1, "again"), (1, "again"), (2, None), (None, "no id"), (99, "long text, " * 30_000)]
    got = packing.pack_documents(table(spark, rows), PATH, P.PATTERN, packing.Packing(length=256, window=5000)).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in sequences.values():
        at = 0
        for begin, length in sorted(parts):
            assert begin == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    want = {}
    for doc, text in rows:
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault((doc, len(ids)), []).append(ids)
    assert want.keys() == pieces.keys()
    for key, texts in want.items():
        assert sum(r.length for r in pieces[key]) == sum(map(len, texts))
        if len(texts) == 1:
            assert all(r.ids_crc32 == zlib.crc32(texts[0][r.start : r.start + r.length].tobytes()) for r in pieces[key])
    assert packing.pack_documents(table(spark, []), PATH, P.PATTERN).count() == 0
