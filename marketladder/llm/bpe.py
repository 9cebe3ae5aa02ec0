"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

The vocabulary's byte strings are mapped one to one to Latin-1 characters, so
that a character automaton (Aho-Corasick) can list every token that occurs in a
piece of text in one pass.  Encoding then walks from left to right, always
trying the longest token first.  A token may follow another only if the pair is
compatible: merging the joined bytes by rank must stop at exactly that cut.
Where no token fits, the last one is given up and the place behind it is marked
as dead, so every place is left at most once and the work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bounds of the memos of one worker; a full memo is emptied.
PIECES, PAIRS = 400_000, 1_000_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class BytePairCodec:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        self.text_of = [str(i) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [self._longest_start(token) for token in self.bytes_of]
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.joined: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        for rank in range(size):
            self._learn_halves(rank)
        self.compatible.clear()  # answers given while merges were missing

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(table, pattern)

    def _longest_start(self, token: bytes) -> int:
        """The longest token that is a proper start of this one, or -1."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def _learn_halves(self, rank: int) -> None:
        """Find the one merge that makes this token; a token without one is only used as a whole piece."""
        token = self.bytes_of[rank]
        left = self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(token[len(self.bytes_of[left]) :], rank)
            if left < rank and right < rank and self._fits(left, right):
                self.halves[rank] = (left, right)
                self.joined[left, right] = rank
                return
            left = self.shorter[left]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ranked merging leaves a cut between the two tokens.

        The later-made token of the two is opened step by step; the cut falls
        if a pair across it could have merged before the opened token was made.
        """
        limit = len(self.halves)
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            opened = False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self.halves[left][1] != left:
                    limit, left, opened = left, self.halves[left][1], True
                elif side == "right" and self.halves[right][0] != right:
                    limit, right, opened = right + 1, self.halves[right][0], True
                if opened:
                    break
            if not opened:
                return True

    def fits(self, left: int, right: int) -> bool:
        """The memoised form of ``_fits``."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one match of the splitting pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size = len(piece)
        longest = [-1] * size
        reach = [0] * size
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            length = len(self.bytes_of[rank])
            if length > reach[end + 1 - length]:
                reach[end + 1 - length], longest[end + 1 - length] = length, rank
        alive = bytearray(b"\x01") * (size + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            length = len(self.bytes_of[token])
            if alive[at + length] and (not ids or self.fits(ids[-1], token)):
                ids.append(token)
                at += length
                token = longest[at] if at < size else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                alive[at] = 0
                token = ids.pop()
                at -= len(self.bytes_of[token])
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, each match of the pattern on its own; pieces are memoised."""
        pieces = self.pattern.findall(text)
        known = self.pieces
        missing = [piece for piece in set(pieces) if piece not in known]
        if len(known) + len(missing) > PIECES:
            known.clear()
            missing = set(pieces)
        for piece in missing:
            known[piece] = self.encode_piece(piece.encode())
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec per worker process and vocabulary."""
    return BytePairCodec.from_file(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode ``text`` and decode the ids again: one row per input row.

    Null and empty texts have no tokens and the digest of nothing.  A null
    ``doc_id`` stays null; repeated rows give repeated results; other columns
    are ignored.  ``ranks_path`` must exist on every worker.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)
