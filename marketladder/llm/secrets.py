"""Secret scan: fixed patterns, and sliding-window entropy over long runs.

A candidate is a long run of token characters.  Per character class (stretches
of hex digits, and the wider base-64 alphabet) a window slides over it; the
character counts and the sum of ``c * log2(c)`` are updated by one character in
and one out, so each step costs the same.  A window above the class's entropy
makes its whole run a span.  Runs on the allow-list (words, numbers, dates,
places in a file system, placeholders) are suppressed, and what a pattern has
already reported is subtracted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from marketladder.llm.memory import frugal_stream

Span = tuple[str, int, int]

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# Fixed patterns: their spans are part of the result's contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs of 24 and more are the runs that do not fail

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_STRETCH = re.compile(r"[0-9A-Fa-f]+")
LABEL = re.compile(r"(?:[A-Za-z0-9+/_-]+=+)+(?=[^=])")
SEPARATORS = "+/_=-"
PARTS = re.compile(r"[+/_=-]+")
WORD = re.compile(r"[a-z]*(?:[A-Z]+[a-z]{2,})*[A-Z]*")  # humps as in names, not letters of random case
NUMBERED = re.compile(WORD.pattern + r"[0-9]{0,4}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PLACEHOLDER = re.compile(r"(?i:example|sample|placeholder|dummy|changeme)|x{4}|X{4}")


@dataclass(frozen=True)
class Entropy:
    """Window length, and the bits a character that a window needs, by class.

    A random window of 20 has 3.36 bits of hex digits and 4.04 of base 64 on
    average; the limits are three and a half standard deviations below.
    """

    window: int = 20
    hex_bits: float = 2.7
    base64_bits: float = 3.5


def high_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows whose Shannon entropy is at least ``bits``."""
    logs = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for end, char in enumerate(run):
        c = counts.get(char, 0)
        total += logs[c + 1] - logs[c]
        counts[char] = c + 1
        start = end + 1 - window
        if start > 0:
            gone = run[start - 1]
            c = counts[gone]
            total += logs[c - 1] - logs[c]
            counts[gone] = c - 1
        if start >= 0 and math.log2(window) - total / window >= bits:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end + 1)
            else:
                spans.append((start, end + 1))
    return spans


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def allowed(run: str) -> bool:
    """Words, names, numbers, dates and paths: every part between separators is a word or a number."""
    if UUID.fullmatch(run):
        return True
    parts = [p for p in PARTS.split(run) if p]
    shape = NUMBERED if len(parts) > 1 else WORD
    return all(p.isdigit() or shape.fullmatch(p) for p in parts)


def _left(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted intervals leave of one."""
    left = []
    for s, e in covered:
        if s < end and start < e:
            if start < s:
                left.append((start, s))
            start = max(start, e)
    return left + [(start, end)] if start < end else left


def _by_end(spans: list[Span]) -> list[tuple[int, int, int]]:
    """Spans by end: end, start, and the smallest start from here on."""
    ordered, least, out = sorted((e, s) for _, s, e in spans), 1 << 62, []
    for e, s in reversed(ordered):
        least = min(least, s)
        out.append((e, s, least))
    return out[::-1]


def _touching(by_end: list[tuple[int, int, int]], first: int, start: int, end: int) -> list[tuple[int, int]]:
    """The spans, sorted, that overlap a stretch; those before ``first`` end too early."""
    found = []
    while first < len(by_end) and by_end[first][2] < end:
        e, s, _ = by_end[first]
        if s < end and start < e:
            found.append((s, e))
        first += 1
    return sorted(found)


def entropy_spans(text: str, base: list[Span], rule: Entropy) -> list[Span]:
    """Spans that the entropy windows add to the base ones.

    A hit counts for its whole run: a hex one for the stretch of hex digits, a
    base-64 one for the candidate behind its label (``name=``).  What other
    spans cover is subtracted; names that a separator divides from them go too.
    """
    found: list[Span] = []
    by_end, first = _by_end(base), 0
    for m in CANDIDATE.finditer(text):
        while first < len(by_end) and by_end[first][0] <= m.start():
            first += 1
        if PLACEHOLDER.search(m[0]):
            continue
        label = LABEL.match(m[0])
        at = m.start() + (label.end() if label and allowed(label[0]) else 0)
        run, stop = text[at : m.end()], m.end()
        if allowed(run):
            continue
        covered = _touching(by_end, first, at, stop)
        for h in HEX_STRETCH.finditer(run):
            if len(h[0]) >= rule.window and not allowed(h[0]) and high_windows(h[0], rule.window, rule.hex_bits):
                found += [("entropy_hex", s, e) for s, e in _left(at + h.start(), at + h.end(), covered)]
                covered = sorted([*covered, (at + h.start(), at + h.end())])
        hits = high_windows(run, rule.window, rule.base64_bits)
        if not any(_left(at + s, at + e, covered) for s, e in hits):
            continue
        edges = {s for s, _ in covered} | {e for _, e in covered}
        for s, e in _left(at, stop, covered):
            divided = (s in edges and text[s] in SEPARATORS) or (e in edges and text[e - 1] in SEPARATORS)
            if not (divided and allowed(text[s:e])):
                found.append(("entropy_base64", s, e))
    return found


def scan(text: str, rule: Entropy = Entropy()) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text; places are code points, ends exclusive."""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base, rule), key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_documents(docs: DataFrame, rule: Entropy = Entropy()) -> DataFrame:
    """Spans of every text: one row per input row; null and empty texts have none.

    Null ids stay null, repeated rows give repeated results, other columns are ignored.
    """

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS[:3]}
            digests, spans = [], []
            for text in batch.column(1):
                base, every = scan(text.as_py() or "", rule)
                for kind, column in counts.items():
                    column.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    **{f"n_{kind}": pa.array(column, pa.int64()) for kind, column in counts.items()},
                    "base_sha256": pa.array(digests, pa.string()),
                    "spans": pa.array(spans, pa.string()),
                }
            )

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def redact(docs: DataFrame, rule: Entropy = Entropy(), mark: str = "[secret]") -> DataFrame:
    """The same rows with every span replaced by ``mark``; ``n_chars`` follows the text."""
    schema = docs.schema
    place, counted = schema.names.index("text"), "n_chars" in schema.names

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for _, start, end in scan(text, rule)[1]:
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    @frugal_stream
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t.as_py()) for t in batch.column(place)]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(texts, pa.string())
            if counted:
                columns["n_chars"] = pa.array([t if new is None else len(new) for t, new in zip(columns["n_chars"].to_pylist(), texts)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(work, schema)
