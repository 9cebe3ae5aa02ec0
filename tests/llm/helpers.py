"""Small tables with the awkward cases every operator must take, and plain versions to compare with."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, node long, kept string"


def table(spark, rows, schema=SCHEMA):
    """Documents with extra columns whose names the operators use inside; ``rows`` are (id, text)."""
    full = [(d, t, "en", "src0", None if t is None else len(t), 7, 8, "x") for d, t in rows]
    return spark.createDataFrame(full, schema)


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))} if found else set()


def linked_groups(rows, words, share):
    """The group number of every row: linked directly or through others; rows without words are alone."""
    sets = [shingles(t, words) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= share * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return sets, group


def without_repeats(rows, length=50):
    """(id, bytes, removed, runs, kept) of every row."""
    first = {}
    data = [((1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], d), d)
    out = []
    for (d, b), (shown, _) in zip(data, rows):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((shown, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out
