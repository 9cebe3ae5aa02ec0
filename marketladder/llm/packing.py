"""Cost-balanced packing of documents into sequences of one length.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``, as attention
within it does.  The documents of a window are taken from the longest to the
shortest; each goes to the sequence with the lowest cost so far among those
with room.  What does not fit anywhere is cut.  The capacities of a window add
up to its tokens: full sequences, and shorter ones at powers of two for the
rest, so nothing is padded.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marketladder.llm.bpe import BytePairCodec
from marketladder.llm.memory import frugal_stream

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
#: Characters tokenized at once; longer texts are cut where no token can span the cut.
STRETCH = 200_000


@dataclass(frozen=True)
class Packing:
    """window: tokens packed together at least."""

    length: int = 2048
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    window: int = 1 << 21
    end_id: int = 1


class Tokenizer:
    """Ids of a ``tokenizers`` byte-level BPE file without special tokens.

    The file's merges are in the order of their ids, so the ids are ranks and a
    rank-based encoder gives the same ids several times faster.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        shown = _byte_letters()
        ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if all(c in shown for c in token)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {token: i for token, i in ranks.items() if i < 256 + len(merges)}
        if [model["vocab"]["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("the merges are not in the order of their ids")
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks, self.pattern = ranks, pattern
        self.slow: BytePairCodec | None = None

    def encode(self, text: str) -> np.ndarray:
        parts = [self._part(p) for p in stretches(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])

    def _part(self, text: str) -> np.ndarray:
        if len(text) <= 2 * STRETCH:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        self.slow = self.slow or BytePairCodec(self.ranks, self.pattern)  # a run without any safe cut
        return np.array(self.slow.encode(text), np.uint32)


def _byte_letters() -> dict[str, int]:
    """The printable letter by which such files show each byte: printable bytes as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def stretches(text: str) -> Iterator[str]:
    """Parts of a long text, each but the first starting at a lone space between two non-spaces."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.find(" ", at + STRETCH // 2)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 < cut < len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence sizes that add up to ``tokens``: full ones, then the powers of two of the rest."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class _ByRoom:
    """Open sequences by room: a heap of (cost, sequence) for each room, and a tree of the lowest over rooms."""

    NONE = (math.inf, 0, 0)

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()  # rooms are below
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.lowest = [self.NONE] * (2 * self.size)

    def _update(self, room: int) -> None:
        heap, lowest = self.heaps[room], self.lowest
        node = room + self.size
        lowest[node] = (heap[0][0], -room, heap[0][1]) if heap else self.NONE
        while node > 1:
            node >>= 1
            lowest[node] = min(lowest[2 * node], lowest[2 * node + 1])

    def add(self, cost: float, room: int, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._update(room)

    def take(self, room: int) -> int | None:
        """Takes out the sequence of the lowest cost among those with at least ``room``; ties go to the most room."""
        found = self.NONE
        low, high = min(room, self.size) + self.size, 2 * self.size
        while low < high:
            if low & 1:
                found = min(found, self.lowest[low])
                low += 1
            low >>= 1
            high >>= 1
        if found is self.NONE:
            return None
        heapq.heappop(self.heaps[-found[1]])
        self._update(-found[1])
        return found[2]


def pack(sizes: list[int], rule: Packing) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one window."""
    room = capacities(sum(sizes), rule.length)
    filled = [0] * len(room)
    costs = [0.0] * len(room)
    pending = [(-size, doc, 0) for doc, size in enumerate(sizes) if size]
    heapq.heapify(pending)
    open_sequences = _ByRoom(rule.length)
    for s, n in enumerate(room):
        open_sequences.add(0.0, n, s)
    pieces = []
    while pending:
        size, doc, start = heapq.heappop(pending)
        size = -size
        s = open_sequences.take(size)
        if s is None:  # none has room: the lowest of all is filled, and the rest waits
            s = open_sequences.take(1)
        take = min(size, room[s] - filled[s])
        pieces.append((doc, start, take, s, filled[s]))
        filled[s] += take
        costs[s] += rule.linear * take + rule.quadratic * take * take
        if filled[s] < room[s]:
            open_sequences.add(costs[s], room[s] - filled[s], s)
        if take < size:
            heapq.heappush(pending, (take - size, doc, start + take))
    return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, rule: Packing = Packing()) -> DataFrame:
    """Pieces of all documents: each token, and the end id behind each document, is in one piece.

    A task packs its rows in windows of about ``rule.window`` tokens, so it
    holds one window at a time and nothing is shuffled.  A null text is empty
    and still has its end id; repeated rows are packed as often as they occur;
    a null id stays null; other columns are ignored; an empty table gives no
    piece.  Sequence ids are unique, not consecutive.
    """

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path, pattern)
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        next_sequence = TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            pieces = pack([len(t) for t in tokens], rule)
            columns = list(zip(*pieces))
            batch = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[d] for d in columns[0]], pa.int64()),
                "start": pa.array(columns[1], pa.int64()),
                "length": pa.array(columns[2], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(tokens[d][s : s + n]) for d, s, n, _, _ in pieces], pa.int64()),
                "doc_tokens": pa.array([len(tokens[d]) for d in columns[0]], pa.int64()),
                "sequence_id": pa.array([next_sequence + s for s in columns[3]], pa.int64()),
                "offset": pa.array(columns[4], pa.int64()),
            })
            next_sequence += max(columns[3]) + 1
            ids.clear()
            tokens.clear()
            return batch

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                tokens.append(np.append(encoder.encode(text.as_py() or ""), np.uint32(rule.end_id)).astype("<u4"))
                held += len(tokens[-1])
                if held >= rule.window:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)
