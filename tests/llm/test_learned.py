"""Quality and toxicity: learned on planted labels, judged on rows kept back."""

import random
import zlib

import numpy as np
import pytest

from marketladder.llm import quality, toxicity
from marketladder.llm.training import held_out, training_rows
from tests.llm.helpers import table

RNG = random.Random(3)
STEMS = ["tion", "the", "and", "er", "on", "st", "re", "ou", "ha", "ing"]
CURSES = ["grobniak", "splorf"]


def prose(n):
    return " ".join("".join(RNG.choice(STEMS) for _ in range(RNG.randint(1, 3))) for _ in range(n))


def corpus():
    rows, labels = [], []
    for i in range(400):
        words = prose(RNG.randint(20, 120)).split()
        good, toxic = i % 4 != 0, i % 5 == 0
        if not good:
            words = [w + RNG.choice(["&&&", "$$$"]) for w in words] if i % 8 else [w for w in words for _ in range(6)]
        if toxic:
            words[RNG.randrange(len(words))] = RNG.choice(CURSES) + RNG.choice(STEMS)
            words[RNG.randrange(len(words))] = RNG.choice(["Gr0bniak", "grоbniakon", "SPLORFST", "spl0rfing"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = corpus()
    return rows, labels, table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_training_rows_are_never_held_out(spark, learned):
    rows, labels, docs, marks = learned
    got = training_rows(docs, marks, "toxic").collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    flags = {r.doc_id: r.h for r in docs.select("doc_id", held_out(docs.doc_id).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}


def test_quality_on_held_out_rows(spark, learned):
    rows, labels, docs, marks = learned
    weight = quality.train(training_rows(docs, marks, "quality"), quality.Fit(sample=200))
    got = quality.score_documents(docs, weight).collect()
    kept = [r for r in got if r.held_out]
    assert len(kept) > 80 and len(got) == len(rows)
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in kept]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = quality.score_documents(table(spark, [(1, None), (1, ""), (None, "x"), (2, "a " * 40_000)]), weight).collect()
    assert len(odd) == 4 and odd[0].score == odd[1].score and not odd[2].held_out


def test_quality_without_a_class(spark):
    rows = table(spark, [(i, "text") for i in range(9)])
    marks = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    weight = quality.train(training_rows(rows, marks, "quality"))
    assert {r.score for r in quality.score_documents(rows, weight).collect()} == {0.5}


def test_counts_cover_all_rows(spark, learned):
    _, _, docs, marks = learned
    rows = training_rows(docs, marks, "quality")
    found = {r.feature: (r.n0, r.n1) for r in quality.class_counts(rows).collect()}
    want = np.zeros((2, quality.SIZE), int)
    for r in rows.collect():
        want[r.label, quality.features(r.text)] += 1
    assert found == {int(f): tuple(want[:, f]) for f in np.flatnonzero(want.any(axis=0))}


def test_dual_descent_separates():
    rows = [(np.array([0, 1], np.uint32), 1), (np.array([0, 2], np.uint32), 0)] * 10
    weight = quality.dual_descent(rows, np.array([0.1, 1.0, -1.0]), quality.Fit())
    assert weight[1] > 0 > -weight[2] and not quality.dual_descent(rows[:1], np.ones(3), quality.Fit()).any()


def test_toxicity_on_held_out_rows(spark, learned):
    rows, labels, docs, marks = learned
    lexicon = toxicity.learn(training_rows(docs, marks, "toxic"))
    got = toxicity.score_documents(docs, lexicon).collect()
    kept = [r for r in got if r.held_out]
    assert [r for r in kept if r.predicted and not labels[r.doc_id][2]] == []
    assert np.mean([r.predicted for r in kept if labels[r.doc_id][2]]) >= 0.95
    clean = toxicity.keep_clean(docs, lexicon)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in got if r.score < 0.7}
    odd = toxicity.score_documents(table(spark, [(1, None), (1, ""), (None, "GR0BNIAK"), (2, "fine " * 40_000 + "splorfen")]), lexicon).collect()
    assert [r.score for r in odd[:2]] == [0.0, 0.0] and odd[2].predicted == 1 and 0 < odd[3].score < odd[2].score


def test_toxicity_without_toxic_rows(spark):
    rows = table(spark, [(i, "text") for i in range(9)])
    marks = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    lexicon = toxicity.learn(training_rows(rows, marks, "toxic"))
    assert lexicon.weights == {} and {r.score for r in toxicity.score_documents(rows, lexicon).collect()} == {0.0}
    empty = table(spark, [])
    assert toxicity.keep_clean(empty, lexicon).count() == toxicity.score_documents(empty, lexicon).count() == 0


def test_words_of_copied_toxic_texts_are_not_terms(spark):
    """Rare words of a toxic text with many copies explain nothing that its curse does not."""
    rows, marks = [], []
    for i in range(240):
        words = prose(30).split()
        toxic = i % 4 == 0
        if toxic:
            words += ["splorf"] + (["quibbelzan", "vintropel"] if i % 8 == 0 else [])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    found = toxicity.learn(training_rows(table(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"), "toxic"))
    assert list(found.weights) == ["splorf "]


def test_folding():
    assert toxicity.folded("Ａbс раth3t1c 1d​iot, café $cum_x") == ["abc", "pathetic", "idiot", "café", "scum", "x"]


def test_exception_phrases_and_length():
    rule = toxicity.Rule()
    lexicon = toxicity.Lexicon({"trash ": 5.0, "moro": 6.0}, {"trash can"})
    found = lexicon.automaton()
    of = lambda text: toxicity.score(toxicity.folded(text), found, rule)
    assert of("a trash can") == 0 and of("trashy") == 0 and of("such trash") > 0.9 and of("moronic") > 0.9
    assert of("trash can and trash") == of("a dog and trash")
    assert of("trash " + "word " * 5000) < of("trash " + "word " * 50)


def test_each_substitution_on_every_word():
    """Every sign of the table, at every place it can stand for, in every word of a lexicon."""
    words = ["clown", "loser", "worthless", "idiot", "imbecil", "lowlife", "bigbag", "scumball", "grobniak", "splorf", "zany"]
    found = toxicity.Lexicon({f"{w} ": 5.0 for w in words}).automaton()
    hit = lambda text: toxicity.score(toxicity.folded(text), found, toxicity.Rule()) > 0.9
    signs = dict(toxicity.LOOK_ALIKES, l=toxicity.LOOK_ALIKES["l"] + "1|!iI", i=toxicity.LOOK_ALIKES["i"] + "lL", b=toxicity.LOOK_ALIKES["b"] + "6\u042c")
    for word in words:
        for at, letter in enumerate(word):
            marked = [letter + "\u0301", letter + "\u0336", chr(0x1D400 + ord(letter.upper()) - 65), chr(0xFF41 + ord(letter) - 97)]
            for sign in [*signs.get(letter, ""), *marked]:
                for text in (word[:at] + sign + word[at + 1 :], "a " + word[:at] + sign + word[at + 1 :] + ", b"):
                    assert hit(text), text
        for text in (word + "!", word + "!!!", f"|{word}|", f"x|{word}|y", f"({word})", word.upper() + "!"):
            assert hit(text), text
    assert hit("\u00eddiot") and hit("c!own") and hit("w0rth1e55") and not hit("clowns | ! owl 6 16")


def learned_from(spark, texts):
    """Lexicon of (text, toxic) pairs."""
    return toxicity.learn(spark.createDataFrame(texts, "text string, label int"))


def test_rare_terms_count_at_any_size(spark):
    """A curse in under one hundredth of the toxic rows, beside a frequent one and copies."""
    texts = [(prose(8) + " splorf " + prose(8), 1) for _ in range(900)] + [(prose(8) + " grobniak " + prose(8), 1) for _ in range(8)]
    texts += [("one text splorf with zzquib", 1)] * 1500 + [(prose(16), 0) for _ in range(4000)]
    found = learned_from(spark, texts).automaton()
    assert all(toxicity.score(["such", w], found, toxicity.Rule()) > 0.7 for w in CURSES) and not toxicity.score(["zzquib"], found, toxicity.Rule())
    chance = learned_from(spark, [(prose(30), int(i % 10 == 0)) for i in range(600)])
    assert len(chance.weights) <= 1


def test_benign_phrases_and_label_noise(spark):
    """A term with benign uses gets exceptions; a few wrong labels neither empty nor fill the lexicon."""
    texts = [(f"{prose(8)} {w} {prose(8)}", 1) for w in ("splorf", "trash") for _ in range(100)]
    texts += [(f"{prose(8)} trash can {prose(8)}", 0) for _ in range(90)] + [(prose(16), 0) for _ in range(1900)]
    texts += [(f"{prose(8)} splorf {prose(8)}", 0) for _ in range(2)] + [(prose(16), 1) for _ in range(4)]
    lexicon = learned_from(spark, texts)
    found = lexicon.automaton()
    of = lambda text: toxicity.score(toxicity.folded(text), found, toxicity.Rule())
    assert "trash can" in lexicon.exceptions and of("a trash can") == 0
    assert of("such trash") > 0.7 and of("a splorf") > 0.7
    assert sum(of(text) > 0.7 for text, label in texts if not label) <= 10


def test_hits_inside_exception_phrases():
    rng = random.Random(4)
    for _ in range(300):
        stretches = [(s, s + rng.randint(1, 15), None) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        safe = toxicity.reach(stretches)
        for start in range(60):
            end = start + rng.randint(1, 8)
            assert toxicity.inside(start, end, safe) == any(a <= start and end <= b for a, b, _ in stretches)
