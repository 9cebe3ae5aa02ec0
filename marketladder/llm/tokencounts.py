"""Token counts through a cache keyed by digests of content and tokenizer.

A text is normalised as far as its tokens allow and named by a digest of the
result; the tokenizer, its library's release and the normalisation are named by
another one.  Counts lie in a Parquet table partitioned by the tokenizer's
digest.  Digests that the cache doesn't know are encoded once each, however many
documents have them, and appended; then every document takes its count from the
cache.  Copies meet before the shuffle, and documents of very frequent digests
are joined without one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib.metadata import version
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketladder.session import checkpoint_folder, stored

CACHED = "digest binary, n_tokens bigint"
#: Words of a generation that a worker remembers, and the longest of them; texts counted at once; characters encoded at once.
MEMO, WORD, BATCH, JOINED = 1 << 18, 48, 64, 1 << 16


@dataclass(frozen=True)
class Counting:
    """limit: tokens from which on a text is over it; frequent: documents of a digest that is joined without a shuffle; rare: most such digests that are sent to all tasks."""

    limit: int = 2048
    frequent: int = 1 << 16
    rare: int = 1 << 18


# ---- tokenizers --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file: its bytes, its library, and whether white space only parts words and case is ignored."""

    data: bytes
    library: str
    words: bool

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """``.json`` for tokenizers, ``.model`` for sentencepiece; the driver reads the file, tasks get its bytes."""
        data = Path(path).read_bytes()
        library = {".json": "tokenizers", ".model": "sentencepiece"}[Path(path).suffix]
        return cls(data, library, library == "tokenizers" and drops_white_space(data))

    @property
    def digest(self) -> str:
        named = f"{self.library} {version(self.library)} words={self.words} ".encode()
        return hashlib.sha256(named + self.data).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        """How many ids each of some texts has, without begin, end or added special tokens."""
        if self.library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(self.data.decode())
        encoder.no_truncation()
        encoder.no_padding()
        if self.words:
            return by_words(lambda texts: [[start for start, _ in e.offsets] for e in encoder.encode_batch(texts, add_special_tokens=False)])
        return lambda texts: [len(e.ids) for e in encoder.encode_batch_fast(texts, add_special_tokens=False)]


def drops_white_space(data: bytes) -> bool:
    """Whether a ``tokenizers`` file lower-cases, and takes words by a pattern that no white space belongs to.

    Only one form is known to be safe: NFC, runs of white space as one space and
    lower case, then the pattern of words, digits and signs; anything else is
    encoded as it stands.
    """
    import json

    rules = json.loads(data)
    normal = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    before = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    # The words of this kind of vocabulary.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    parted = before.get("pattern") == {"Regex": pattern} and before.get("invert") is True and before.get("behavior") == "Removed"
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] and not any(c.isspace() for c in t["content"]) for t in rules["added_tokens"])
    return normal == ["NFC", "Replace", "Lowercase"] and parted and plain and rules.get("post_processor") is None


def by_words(starts: Callable[[list[str]], list[list[int]]]) -> Callable[[list[str]], list[int]]:
    """Counts of texts as sums over what spaces part; ``starts`` gives where each id of a text starts.

    Words that are not known are encoded as a text of such words, and an id
    belongs to the word it starts in.  Short words are remembered in two
    generations: words that come again move to the young one; when that is full
    it becomes the old one, which is dropped.
    """
    generations: list[dict[str, int]] = [{"": 0}, {}]

    def encode(words: list[str]) -> Iterator[tuple[str, int]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        part = (np.cumsum(sizes) - sizes) // JOINED  # a long word stands alone
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(words)]
        for a, b in zip(cuts, cuts[1:]):
            begin = np.cumsum(sizes[a:b]) - sizes[a:b]
            found = np.array(starts([" ".join(words[a:b])])[0], np.int64)
            yield from zip(words[a:b], np.bincount(np.searchsorted(begin, found, side="right") - 1, minlength=b - a).tolist())

    def count(texts: list[str]) -> list[int]:
        young, old = generations
        parted = [text.split(" ") for text in texts]
        fresh = set().union(*parted).difference(young)
        again = fresh & old.keys()
        young.update((w, old[w]) for w in again)
        new = list(fresh - again)
        young.update(encode(new) if new else ())
        out = [sum(map(young.__getitem__, words)) for words in parted]
        for word in new:
            if len(word) > WORD:
                del young[word]
        if len(young) > MEMO:
            generations[:] = {"": 0}, young
        return out

    return count


# ---- content -----------------------------------------------------------------------------------------------------


def normalised(text: Column, words: bool) -> Column:
    """The text with what can't change its tokens taken out; a null text is empty.

    With ``words``: ASCII white space at the ends goes, its runs become one
    space, and texts of ASCII only are lower-cased.  Texts with other letters
    aren't, since composition may depend on case, and texts that may hold a
    special token aren't either.
    """
    text = F.coalesce(text, F.lit(""))
    if not words:
        return text
    parted = F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    plain = (F.octet_length(parted) == F.char_length(parted)) & ~F.contains(parted, F.lit("<|"))
    return F.when(plain, F.lower(parted)).otherwise(parted)


# ---- the cache ---------------------------------------------------------------------------------------------------


def _place(cache: str, vocabulary: Vocabulary) -> str:
    return f"{cache.rstrip('/')}/tokenizer={vocabulary.digest}"


def cached(spark: SparkSession, cache: str, vocabulary: Vocabulary) -> DataFrame:
    """Digests and counts of a tokenizer; two runs may have appended the same digest, then with the same count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_place(cache, vocabulary))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHED)
    rows = spark.read.schema(CACHED).parquet(_place(cache, vocabulary))
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``CACHED`` rows of (digest, content)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or vocabulary.counter()
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                counts = pa.array(count(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts], names=["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(work, CACHED)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, cache: str, rule: Counting = Counting()) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; what the cache doesn't know is appended to it.

    Counts are those of the tokenizer's library for the whole text; special
    strings inside a text are handled as the library does.  A null text is
    empty, null ids stay, repeated rows each give a row, other columns are
    ignored, an empty table gives an empty result.  A run that fails before the
    append has changed nothing; one that fails later has filled the cache.
    """
    spark = docs.sparkSession
    content = normalised(F.col("text"), vocabulary.words)
    texts = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), content.alias("content"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("content", 256)))
    rows = stored(texts.select("doc_id", "n_bytes", "digest"))
    wanted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    known = cached(spark, cache, vocabulary)
    wanted = stored(wanted.join(known, "digest", "left"))
    misses = wanted.filter("n_tokens IS NULL").select("digest")
    if not misses.isEmpty():
        # one text of each digest a task, one in all, of those that miss; only these are encoded
        asked = texts.groupBy("digest").agg(F.first("content").alias("content")).join(misses, "digest", "left_semi")
        _encode(asked, vocabulary).write.mode("append").parquet(_place(cache, vocabulary))
    counts = wanted.select("digest", "copies").join(cached(spark, cache, vocabulary), "digest")
    frequent = stored(counts.filter(F.col("copies") >= rule.frequent))
    some = frequent.count()
    if some:
        hot = F.broadcast(frequent) if some <= rule.rare else frequent  # at most rows / ``frequent`` of them
        marked = rows.join(hot.select("digest", F.col("n_tokens").alias("hot_tokens")), "digest", "left")
        often = marked.filter("hot_tokens IS NOT NULL").select("doc_id", "n_bytes", F.col("hot_tokens").alias("n_tokens"))
        seldom = marked.filter("hot_tokens IS NULL").select("doc_id", "n_bytes", "digest")
        found = seldom.join(counts.filter(F.col("copies") < rule.frequent), "digest").select("doc_id", "n_bytes", "n_tokens").unionByName(often)
    else:
        found = rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > rule.limit).alias("over_limit"))


def new_cache(spark: SparkSession) -> str:
    """A cache folder of its own in the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/marketladder/token-counts-{uuid.uuid4().hex}"
