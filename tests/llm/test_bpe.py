import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from marketladder.llm import bpe
from tests.llm.helpers import table

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(PATH, P.PATTERN)
WANTED = tiktoken.Encoding("wanted", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
PIECES = st.lists(st.sampled_from(["ab", "a", "the ", "ion", " tion", "é", "ß", "日本", "🙂", "\n", "  ", "'s", "99", "\x00"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), PIECES.map("".join)))
def test_same_ids_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == WANTED.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, "xyzzy" * 4_000 + " " * 500, "é́" * 3_000])
def test_long_runs(text):
    assert CODEC.encode(text) == WANTED.encode_ordinary(text)


def test_every_token_is_made_by_one_merge():
    assert sum(h == (i, i) for i, h in enumerate(CODEC.halves)) == 256


def test_memos_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    small = bpe.BytePairCodec.from_file(PATH, P.PATTERN)
    for text in ("one two three four five six", "seven eight one two", "inconceivable thorreou ndernt"):
        assert small.encode(text) == WANTED.encode_ordinary(text)
    assert len(small.compatible) <= 5


def test_documents(spark):
    rows = [(1, "Some text.\nAnd more"), (1, "Some text.\nAnd more"), (2, ""), (3, None), (None, "no id"), (4, "w" * 50_000)]
    got = bpe.encode_documents(table(spark, rows), PATH, P.PATTERN).collect()
    want = []
    for doc, text in rows:
        ids = WANTED.encode_ordinary(text or "")
        joined = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((doc, len(ids), joined, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(table(spark, []), PATH, P.PATTERN).count() == 0
