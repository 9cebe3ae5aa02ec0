"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick.

Texts are folded first: compatibility forms to plain ones, lower case,
look-alike letters of other scripts to Latin ones, digits and signs that stand
for letters to those letters, accents, marks and invisible characters removed;
then only the words are kept, one space apart.  A lexicon
term is a whole word or the start of a word.  One pass of an automaton finds
all terms and all exception phrases; a term inside an exception phrase does not
count.  The sum of the weights is divided by a slowly growing function of the
text's length.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marketladder.llm.memory import frugal_stream
from marketladder.llm.training import held_out
from marketladder.session import stored

# Look-alikes: letters of other scripts, and signs, by the Latin letter they stand for.
LOOK_ALIKES = {
    "a": "аαɑ4@", "b": "ьвβ8", "c": "сϲ", "d": "ԁđ", "e": "еєε3", "g": "ɡ69", "h": "һнħ", "i": "іιı1!|", "j": "ј", "k": "кκ",
    "l": "ӏł", "m": "м", "n": "ո", "o": "оοօø0", "p": "рρ", "r": "г", "s": "ѕ5$", "t": "тτŧ7", "u": "υս", "v": "ν", "w": "ѡ",
    "x": "хχ", "y": "уγ", "z": "ᴢ2",
}
_MARKS = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn"}
_FOLD = {ord(c): latin for latin, chars in LOOK_ALIKES.items() for c in chars}
_FOLD |= _MARKS | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_SCRIPTS = {c: latin for c, latin in _FOLD.items() if c > 127}  # before NFKC, which changes some of them
#: Characters that neither look like others nor have another form: ASCII and the accented letters of Latin.
_LATIN = {chr(c) for c in range(0x180) if c < 128 or (chr(c).isalpha() and unicodedata.normalize("NFKC", chr(c)) == chr(c))} - set(map(chr, _SCRIPTS))
_WORD = re.compile(r"[^\W_]+")
_SIGNED = re.compile(r"(?<![^\W_])(?<![!|])[^\W_!|6]*+[!|6](?:[^\W_]|[!|])*")
_ALIKE = str.maketrans("i", "l")  # i, l, 1, ! and | are one letter


def _readings(found: re.Match[str]) -> str:
    """Words that a run with signs may be: signs as punctuation, as letters; 6 as g or b."""
    run = found[0]
    plain = run.replace("!", " ").replace("|", " ")
    words = [plain] if plain == run or not plain.strip() else [plain, run]
    return " ".join([*words, *(w.replace("6", "b") for w in words if "6" in w and not w.isdigit())])


def folded(text: str | None) -> list[str]:
    """The folded words of a text; letters keep their accents, see ``matched``.

    ``!``, ``|`` and ``6`` are ambiguous: a word with them is given in each reading.
    """
    text = (text or "").lower()
    if not (text.isascii() or _LATIN.issuperset(text)):
        text = unicodedata.normalize("NFKC", text.translate(_SCRIPTS)).lower().translate(_MARKS)
    if "!" in text or "|" in text or "6" in text:
        text = _SIGNED.sub(_readings, text)
    return _WORD.findall(_replaced(text, _FOLD))


def _replaced(text: str, table: dict[int, str | None]) -> str:
    """``text.translate(table)``; by replacing where a text that is not ASCII has few kinds of characters."""
    found = [] if text.isascii() else [c for c in set(text) if ord(c) in table]
    if text.isascii() or len(found) > 24:
        return text.translate(table)
    for c in found:
        text = text.replace(c, table[ord(c)] or "")
    return text


class _Bare(dict):
    """Letters without their accents, filled as they occur."""

    def __missing__(self, c: int) -> str:
        self[c] = "".join(filter(str.isalnum, unicodedata.normalize("NFKD", chr(c)).translate(_FOLD))) if c > 127 else chr(c)
        return self[c]


_BARE = _Bare()


def matched(words: list[str]) -> list[str]:
    """Folded words as they are compared: without accents, with ``l`` for ``i``."""
    text = " ".join(words)
    if not text.isascii():
        odd = [c for c in set(text) if c > "\x7f"]
        if len(odd) > 24:
            text = text.translate(_BARE)
        else:
            for c in odd:
                text = text.replace(c, _BARE[ord(c)])
    return text.translate(_ALIKE).split(" ") if text else []


@dataclass(frozen=True)
class Rule:
    """How terms are learned and texts are scored."""

    stems: tuple[int, ...] = (4, 5, 6)  # lengths of word starts that may become terms
    least: int = 3  # distinct toxic texts a term explains at least
    doubt: float = 3.0  # log odds against chance, and log ratio, from which a term that clean rows hold
    lean: float = 0.7  # is tried with exceptions
    weight: float = 3.5  # least log ratio of a term
    together: float = 0.8  # terms taken in one round have at least this share of the largest count
    scale: float = 200.0  # words up to which the length hardly counts


@dataclass
class Lexicon:
    """Weights by term: a whole word ends in a space, the start of a word does not."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            key = " ".join([*matched(term.split()), ""]) if term.endswith(" ") else matched([term])[0]
            found.add_word(f" {key}", (len(key) + 1, weight))
        for phrase in self.exceptions:
            key = " ".join(matched(phrase.split()))
            found.add_word(f" {key} ", (len(key) + 2, None))
        found.make_automaton()
        return found


def _terms(word: str, rule: Rule) -> list[str]:
    """A word and its starts as terms."""
    return [f"{word} "] * (len(word) > 2) + [word[:n] for n in rule.stems if len(word) > n]


def terms_of(words: list[str], rule: Rule) -> set[str]:
    """Whole words and word starts of a text."""
    return {t for w in set(words) for t in _terms(w, rule)}


def _bits(terms: DataFrame) -> bytes:
    """A bitmap of the terms' hashes: half a megabyte at any number of terms."""
    code = F.crc32(F.col("term").cast("binary"))
    place, bucket = F.pmod(code, F.lit(1 << 15)), F.pmod(F.shiftright(code, 15), F.lit(128))
    bitmap = bytearray(128 * 4096)
    for r in terms.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits")).collect():
        bitmap[4096 * r.bucket : 4096 * (r.bucket + 1)] = r.bits
    return bytes(bitmap)


def _in(bits: bytes, term: str) -> int:
    """Not 0 for all terms of the bitmap, and for few others; a join tells them apart."""
    code = zlib.crc32(term.encode())
    return bits[code >> 3 & 0x7FFFF] >> (code & 7) & 1


def _term_counts(rows: DataFrame, rule: Rule, bits: bytes | None = None) -> DataFrame:
    """``term, n``: rows that hold the term; counted in the task before the shuffle."""

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                terms = terms_of(matched(folded(text.as_py())), rule)
                counts.update(terms if bits is None else [t for t in terms if _in(bits, t)])
                if len(counts) > 300_000:
                    yield out()
        yield out()

    return rows.select("text").mapInArrow(work, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _hits(rows: DataFrame, terms: DataFrame, rule: Rule) -> DataFrame:
    """``row, terms``: the terms that each text holds, of those in ``terms``."""
    bits = _bits(terms)

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [t for t in terms_of(matched(folded(text.as_py())), rule) if _in(bits, t)]
                if found:
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(found), pa.int64()), "term": pa.array(found, pa.string())})

    held = rows.select(F.xxhash64("text").alias("row"), "text").mapInArrow(work, "row bigint, term string")
    return held.join(terms.select("term"), "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("terms"))


def _explained(hits: DataFrame, known: frozenset[str]) -> DataFrame:
    """``term, n``: rows of ``hits`` that hold the term and no ``known`` one."""

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                if known.isdisjoint(terms):
                    counts.update(terms)
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return hits.select("terms").mapInArrow(work, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


#: Rows that a task gathers before it hands them on.
CHUNK = 50_000


def _occurrences(words: list[str], bits: bytes, rule: Rule) -> Iterator[tuple[int, str, list[str]]]:
    """Place, term, and the phrases with the word before and the one behind, of each occurrence."""
    held: dict[str, list[str]] = {}
    for at, word in enumerate(words):
        if word not in held:
            held[word] = [t for t in _terms(word, rule) if _in(bits, t)]
        if held[word]:
            phrases = [" ".join(words[i:j]) for i, j in ((at - 1, at + 1), (at, at + 2)) if i >= 0 and j <= len(words)]
            for term in held[word]:
                yield at, term, phrases


def _phrase_counts(rows: DataFrame, terms: DataFrame, rule: Rule) -> DataFrame:
    """``term, phrase, n0, n1``: texts that hold a term's phrase, by class; counted in the task before the shuffle."""
    bits = _bits(terms)

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({
                "term": pa.array([t for t, _ in counts], pa.string()), "phrase": pa.array([p for _, p in counts], pa.string()),
                "n0": pa.array([n[0] for n in counts.values()], pa.int64()), "n1": pa.array([n[1] for n in counts.values()], pa.int64()),
            })
            counts.clear()
            return batch

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _occurrences(matched(folded(text.as_py())), bits, rule)
                for key in {(term, phrase) for _, term, phrases in found for phrase in phrases}:
                    counts.setdefault(key, [0, 0])[label] += 1
                if len(counts) > CHUNK:
                    yield out()
        yield out()

    found = rows.select("toxic", "text").mapInArrow(work, "term string, phrase string, n0 bigint, n1 bigint")
    counted = found.groupBy("term", "phrase").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return counted.join(terms.select("term"), "term", "left_semi")


def _places(rows: DataFrame, terms: DataFrame, rule: Rule) -> DataFrame:
    """``row, at, term, phrase``: every occurrence of a term with each of its phrases, or a null one."""
    bits = _bits(terms)

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, str, str | None]] = []

        def chunk() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            batch = pa.RecordBatch.from_pydict({
                "row": pa.array(columns[0], pa.int64()), "at": pa.array(columns[1], pa.int64()),
                "term": pa.array(columns[2], pa.string()), "phrase": pa.array(columns[3], pa.string()),
            })
            out.clear()
            return batch

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, term, phrases in _occurrences(matched(folded(text.as_py())), bits, rule):
                    out.extend((row, at, term, phrase) for phrase in phrases or [None])
                    if len(out) > CHUNK:
                        yield chunk()
        yield chunk()

    found = rows.select(F.xxhash64("text").alias("row"), "text").mapInArrow(work, "row bigint, at bigint, term string, phrase string")
    return found.join(terms.select("term"), "term", "left_semi")


def learn(rows: DataFrame, rule: Rule = Rule()) -> Lexicon:
    """Lexicon of ``rows`` (``text``, ``label``); equal texts of a label count once.

    Terms are counted over all toxic texts; those in ``least`` and more are
    counted over all others.  A term may be taken if its log ratio reaches
    ``weight`` and its counts are no chance: by the Chernoff bound less than one
    of all terms counted would lean that far.  Where clean texts hold a term,
    phrases with the word before or behind it that occur in at least two clean
    texts, and in toxic ones no more than in clean ones, are exceptions, and the
    clean texts are counted again without them.

    Terms are taken in rounds: those that explain the most texts first, then
    those that explain the most of the texts left, and so on.  So words that
    merely occur in many copies of one toxic text are not taken, as another term
    explains it.  Candidates stay in Spark; the driver gets the terms that a
    round may take and the exceptions of the terms taken.  Without toxic rows
    the lexicon is empty.
    """
    rows = stored(rows.select("text", (F.col("label") > 0).alias("toxic")).distinct())
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Lexicon({})
    bad, good = rows.filter("toxic"), rows.filter("NOT toxic")
    n0, n1, share = F.col("n0"), F.col("n1"), toxic / (toxic + clean)
    ratio = F.log((n1 + 0.5) / F.lit(toxic + 1.0)) - F.log((n0 + 0.5) / F.lit(clean + 1.0))
    odds = n1 * F.log(n1 / ((n0 + n1) * share)) + F.when(n0 > 0, n0 * F.log(n0 / ((n0 + n1) * (1 - share)))).otherwise(0.0)
    leans = F.when(n1 > (n0 + n1) * share, odds).otherwise(0.0)  # log odds against chance

    inside = stored(_term_counts(bad, rule).filter(F.col("n") >= rule.least).withColumnRenamed("n", "n1"))
    outside = _term_counts(good, rule, _bits(inside)).withColumnRenamed("n", "n0")
    counts = stored(inside.join(outside, "term", "left").select("term", "n1", F.coalesce("n0", F.lit(0)).alias("n0")))
    sure = math.log(max(counts.count(), 1))
    counts, safe = _without_exceptions(rows, counts, counts.filter((n0 > 0) & (leans >= min(rule.doubt, sure)) & (ratio >= rule.lean)), ratio, rule)
    usable = stored(counts.filter((ratio >= rule.weight) & (leans >= sure)).select("term", ratio.alias("ratio")))
    hits = stored(_hits(bad, usable, rule))
    weights: dict[str, float] = {}
    while True:
        left = _explained(hits, frozenset(weights))
        most = left.agg(F.max("n").alias("n")).first().n or 0
        if most < rule.least:
            break
        best = {r.term: r for r in left.filter(F.col("n") >= max(rule.least, rule.together * most)).join(usable, "term").collect()}
        weights |= {t: best[t].ratio for t in _narrowest({t: r.n for t, r in best.items()}, rule)}
    lexicon = Lexicon(weights)
    if weights and safe is not None:
        lexicon.exceptions = {r.phrase for r in safe.filter(F.col("term").isin(list(weights))).select("phrase").distinct().collect()}
    return lexicon


def _without_exceptions(rows: DataFrame, counts: DataFrame, held: DataFrame, ratio: Column, rule: Rule) -> tuple[DataFrame, DataFrame | None]:
    """``counts`` with the clean texts of ``held`` terms counted outside exception phrases, and those phrases by term."""
    if held.isEmpty():
        return counts, None
    phrases = _phrase_counts(rows, held, rule)
    safe = stored(phrases.filter((F.col("n0") >= 2) & ((F.col("n1") == 0) | (ratio <= 0))))
    # the fewest clean texts that the phrases can leave of a term
    fewest = safe.groupBy("term").agg(F.sum("n0").alias("gone")).join(held, "term").select("term", "n1", F.greatest(F.col("n0") - F.col("gone"), F.lit(0)).alias("n0"))
    within = stored(fewest.filter(ratio >= rule.weight).select("term"))
    places = _places(rows.filter("NOT toxic"), within, rule).join(safe.select("term", "phrase", F.lit(1).alias("safe")), ["term", "phrase"], "left")
    outside = places.groupBy("term", "row", "at").agg(F.max(F.coalesce("safe", F.lit(0))).alias("safe")).filter("safe = 0")
    again = outside.groupBy("term").agg(F.count_distinct("row").alias("again"))
    fresh = within.join(again, "term", "left").select("term", F.coalesce("again", F.lit(0)).alias("again"))
    return stored(counts.join(fresh, "term", "left").select("term", "n1", F.coalesce("again", "n0").alias("n0"))), safe


def _narrowest(counts: dict[str, int], rule: Rule) -> list[str]:
    """Of nested terms (a start, a longer start, the word) the longest that keeps nine tenths of the rows."""
    def starts(term: str) -> list[str]:
        return [term[:n] for n in rule.stems if n < len(term.strip()) and term[:n] in counts]

    roots = [t for t in counts if not starts(t)]
    kept = []
    for root in roots:
        nested = [t for t in counts if t.startswith(root) and counts[t] >= 0.9 * counts[root]]
        kept.append(max(nested, key=lambda t: (len(t), t)))
    return kept


def reach(phrases: list[tuple[int, int, None]]) -> tuple[list[int], list[int]]:
    """Starts of stretches in order, and how far a stretch reaches that starts there or before."""
    ordered = sorted((s, e) for s, e, _ in phrases)
    return [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))


def inside(start: int, end: int, safe: tuple[list[int], list[int]]) -> bool:
    """Whether one of the stretches holds all of this one."""
    place = bisect_right(safe[0], start) - 1
    return place >= 0 and safe[1][place] >= end


def score(words: list[str], automaton: ahocorasick.Automaton, rule: Rule) -> float:
    """0 to 1 for the folded words of a text; 0 without a term."""
    if not words or not len(automaton):
        return 0.0
    hits, phrases = [], []
    for end, (length, weight) in automaton.iter(f" {' '.join(matched(words))} "):
        (phrases if weight is None else hits).append((end + 1 - length, end + 1, weight))
    safe = reach(phrases)
    total = sum(w for s, e, w in hits if not inside(s, e, safe))
    return 1.0 - math.exp(-total / (1.0 + math.log1p(len(words) / rule.scale)))


def score_documents(docs: DataFrame, lexicon: Lexicon, rule: Rule = Rule(), limit: float = 0.7) -> DataFrame:
    """Score of every text: one row per input row; null and empty texts score 0.

    Null ids stay null and are not held out; repeated rows give repeated results; other columns are ignored.
    """
    weights, exceptions = lexicon.weights, lexicon.exceptions

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(weights, exceptions).automaton()
        for batch in batches:
            scores = [score(folded(t.as_py()), automaton, rule) for t in batch.column(2)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= limit) for s in scores], pa.int32()),
            })

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, rule: Rule = Rule(), limit: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``limit``."""
    weights, exceptions = lexicon.weights, lexicon.exceptions
    place = docs.columns.index("text")

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(weights, exceptions).automaton()
        for batch in batches:
            kept = pa.array([score(folded(t.as_py()), automaton, rule) < limit for t in batch.column(place)], pa.bool_())
            yield batch.filter(kept)

    return docs.mapInArrow(work, docs.schema)
