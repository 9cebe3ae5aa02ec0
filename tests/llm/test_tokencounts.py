import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketladder.llm import tokencounts
from marketladder.llm.tokencounts import Counting, Vocabulary
from tests.llm.helpers import table

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)

AWKWARD = [
    None, "", " ", "\n\t ", "Hello  World", "hello world", " HELLO\nworld ", "it's  IT'S I'LL", "<|endoftext|>", "a <|startoftext|>b", "<|STARTOFTEXT|>",
    "x<|endoftext|><|endoftext|>y", "J̌ J̌ ǰ", "İstanbul ΑΣ ΑΣ. Σ", "é É ́ ạ́", " non breaking　", "漢字かな 한글", "😀😀 👩‍👩‍👧",
    "\x00\x1f\x85 x", "1234567 1 2", "--== ..,,!!", "ﬁ ½ ² Å", "A" * 5000, "word " * 20_000, "é" * 3000, "a\x0bb\x0cc",
]


def library(texts):
    return [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]


def counted(spark, rows, cache, vocabulary=None, **rule):
    out = tokencounts.count_tokens(table(spark, rows), vocabulary or Vocabulary.read(WORDS), cache, Counting(**rule))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_the_library_on_awkward_texts(spark, tmp_path):
    rows = list(enumerate(AWKWARD)) + [(None, "Hello world"), (3, "Hello  World"), (3, "Hello  World")]
    expected = [(d, len((t or "").encode()), n, n > 2048) for (d, t), n in zip(rows, library(t for _, t in rows))]
    assert counted(spark, rows, str(tmp_path / "c")) == sorted(expected, key=repr)
    assert counted(spark, [], str(tmp_path / "d")) == []


pieces = st.one_of(st.text(max_size=12), st.sampled_from([" ", "\n", "<|endoftext|>", "<|", "'S", "Σ", "́", "J̌", "İ", "A", "é", "̸", "="]))


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=12).map("".join))
def test_words_and_normalisation_keep_the_count(text):
    """The plain form of what the expression does; the next test holds the expression against it."""
    count = Vocabulary.read(WORDS).counter() if not hasattr(test_words_and_normalisation_keep_the_count, "count") else test_words_and_normalisation_keep_the_count.count
    test_words_and_normalisation_keep_the_count.count = count
    assert count([plain(text)]) == library([text])


def plain(text):
    import re

    parted = re.sub(r"[ \t\n\x0b\f\r]+", " ", text or "").strip(" ")
    return parted.lower() if parted.isascii() and "<|" not in parted else parted


def test_the_expression_normalises_like_the_plain_form(spark):
    rng = random.Random(2)
    texts = AWKWARD + ["".join(rng.choice(["A", "b", " ", "\n", "<|", "é", "́", "\t", "\x00"]) for _ in range(12)) for _ in range(300)]
    df = table(spark, list(enumerate(texts))).select("doc_id", tokencounts.normalised(F.col("text"), True).alias("t"))
    assert {r.doc_id: r.t for r in df.collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    cache, vocabulary = str(tmp_path / "cache"), Vocabulary.read(WORDS)
    rows = [(i, f"Text {i % 40}" if i % 3 else "the  SAME text") for i in range(600)]
    first = counted(spark, rows, cache)
    files = lambda: sum(r.n for r in [spark.read.parquet(f"{cache}/tokenizer={vocabulary.digest}").agg(F.count(F.lit(1)).alias("n")).first()])
    assert files() == len({plain(t) for _, t in rows})
    assert counted(spark, rows, cache) == first and files() == len({plain(t) for _, t in rows})
    more = [*rows, (900, "NEW text"), (901, "new  text")]
    assert [r for r in counted(spark, more, cache) if r[0] < 900] == first and files() == len({plain(t) for _, t in more})


def test_stored_counts_are_used(spark, tmp_path):
    cache, vocabulary = str(tmp_path / "cache"), Vocabulary.read(WORDS)
    spark.sql("SELECT unhex(sha2('known text', 256)) AS digest, 4711L AS n_tokens").write.parquet(f"{cache}/tokenizer={vocabulary.digest}")
    assert counted(spark, [(1, "Known\ttext ")], cache) == [(1, 11, 4711, True)]


def test_frequent_digests_are_joined_apart(spark, tmp_path):
    rows = [(i, "same words" if i % 3 else f"text {i}") for i in range(300)]
    assert counted(spark, rows, str(tmp_path / "a"), frequent=50) == counted(spark, rows, str(tmp_path / "b"))
    assert counted(spark, rows, str(tmp_path / "c"), frequent=50, rare=0) == counted(spark, rows, str(tmp_path / "b"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_take_texts_as_they_are(spark, tmp_path, name):
    vocabulary = Vocabulary.read(public_tokenizers.path(name))
    assert not vocabulary.words and vocabulary.digest != Vocabulary.read(WORDS).digest
    texts = [t for t in AWKWARD if t is None or "\x00" not in t]
    if name.endswith("json"):
        encoder = Tokenizer.from_file(public_tokenizers.path(name))
        expected = [len(encoder.encode(t or "", add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        expected = [len(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(t or "")) for t in texts]
    got = counted(spark, list(enumerate(texts)), str(tmp_path / "c"), vocabulary)
    assert [r[2] for r in sorted(got)] == expected


def test_a_long_text_without_spaces(spark, tmp_path):
    text = "".join(random.Random(1).choices("abcdefgh漢字", k=400_000))
    assert counted(spark, [(1, text)], str(tmp_path / "c"))[0][2] == library([text])[0]
