"""Reading one page in Python: its text, price mentions, cards, sections and cadence.

Each function takes one page's values and is called from the Arrow batches of
``prices``, so that a page is read in one pass and not by a chain of interpreted
array expressions.  Patterns mean what they do in Spark's regular expressions:
blanks and digits are ASCII, tag names ignore case in ASCII only.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

Mention = tuple[int, int, int, str, str]
BLANKS, DIGITS = r" \t\n\x0b\f\r", "0-9"
# What ``(?U)\s`` and the byte order mark are.
UNICODE_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


@cache
def compiled(pattern: str) -> re.Pattern:
    """A pattern of Spark's as one of Python's; ``(?iu)`` alone ignores case."""
    plain = pattern.replace("(?iu)", "")
    parts, inside = [], False
    for part in re.findall(r"\\.|.", plain, re.DOTALL):
        inside = (inside or part == "[") and part != "]"
        chars = {r"\s": BLANKS, r"\d": DIGITS}.get(part)
        parts.append(part if chars is None else chars if inside else f"[{chars}]")
    return re.compile("".join(parts), re.IGNORECASE if plain != pattern else 0)


# Letters that ignoring case finds equal to one that is not their own lower case, as the dotless i.
ODD_LETTERS = frozenset(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) != 1 or len(c.lower()) != 1 or c.upper().lower() != c.lower())


def folded(text: str) -> str | None:
    """The text in lower case, if each letter is one there and equal to all that ignoring case finds equal."""
    return text.lower() if text.isascii() or (ODD_LETTERS.isdisjoint(text) and max(text) < "\U00010000") else None


class Words:
    """Words in any case: looked for in lower case where a text has one, as that is several times faster."""

    def __init__(self, pattern: str):
        self.exact = compiled(pattern)
        plain = pattern.replace("(?iu)", "").lower()
        for odd, letter in (("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
            plain = plain.replace(odd, letter)
        self.lower = compiled(plain)

    def spans(self, text: str, low: str | None) -> list[tuple[int, int]]:
        return [m.span() for m in (self.exact.finditer(text) if low is None else self.lower.finditer(low))]

    def within(self, text: str, low: str | None, start: int, end: int) -> bool:
        """Whether the stretch of the text, read by itself, has one."""
        return (self.exact.search(text[start:end]) if low is None else self.lower.search(low[start:end])) is not None


@cache
def words(pattern: str) -> Words:
    return Words(pattern)


_ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def ascii_lower(html: str) -> str:
    """Lower case of the ASCII letters; places stay."""
    return html.lower() if html.isascii() else html.translate(_ASCII_LOWER) if html.lower() != html else html


def any_case(word: str) -> str:
    """A word in any case of its ASCII letters."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word)


def mentions_of(text: str, prefix: str, patterns: list[re.Pattern]) -> list[Mention]:
    """Prices of a text in order: (start, form, end, amount, price)."""
    found = []
    for form, pattern in enumerate(patterns):
        for match in pattern.finditer(text):
            raw = match[1]
            kept = raw.rstrip(".,")
            if kept:  # a digit is left
                found.append((match.start(), form, match.end() - len(raw) + len(kept), kept, prefix + kept))
    if len(patterns) > 1:  # two patterns can find one amount at one place; sorted, they are neighbours
        found.sort()
        found = [m for i, m in enumerate(found) if i == 0 or (found[i - 1][0], found[i - 1][4]) != (m[0], m[4])]
    return found


_SCRIPT, _STYLE = (re.compile(rf"<{any_case(t)}\b[\s\S]*?</{any_case(t)}>") for t in ("script", "style"))
_BREAK, _TAG = re.compile(rf"<{any_case('br')}[{BLANKS}]*/?>"), re.compile("<[^>]+>")
_NUMBERED = [(re.compile(r"&#[xX]([0-9a-fA-F]+);"), 16), (re.compile("&#([0-9]+);"), 10)]


def _decoded(text: str, pattern: re.Pattern, base: int) -> str:
    for match in {m[0]: m for m in pattern.finditer(text)}.values():
        point = int(match[1], base) if len(match[1].lstrip("0")) < 9 else 0x110000
        if point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF:
            text = text.replace(match[0], chr(point))
    return text


@cache
def _named(names: tuple[tuple[str, str], ...]) -> list[tuple[re.Pattern, str]]:
    """Entities, the ampersand last, so that a decoded one does not start another."""
    return [(re.compile(f"&{any_case(name)};"), sign) for name, sign in sorted(names, key=lambda pair: pair[0] == "amp")]


def plain_text(html: str, names: tuple[tuple[str, str], ...], drop_scripts: bool) -> str:
    """What ``prices.html_to_text`` makes of a page."""
    text = html
    if "<" in text:
        if drop_scripts and "</s" in text.lower():
            text = _STYLE.sub(" ", _SCRIPT.sub(" ", text))
        text = _TAG.sub(" ", _BREAK.sub(" ", text))
    if "&" in text:
        for pattern, base in _NUMBERED:
            text = _decoded(text, pattern, base)
        for entity, sign in _named(names):
            text = entity.sub(sign, text)
    if not text.isprintable() or "  " in text:  # else the only blanks are single spaces
        text = UNICODE_BLANKS.sub(" ", text)
    return text.strip(" ")


_CLASS = re.compile(r"""class=(?<!\wclass=)("[^"]*"|'[^']*')""")


@cache
def _tag_start(tag: str) -> re.Pattern:
    return re.compile(rf"<{tag}\b")


@cache
def _word(word: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(word)}\b")


def _opening(low: str, start: int, end: int) -> str:
    """The opening tag at a place; it ends before the next tag of its name."""
    return low[start : low.find(">", start, end) + 1]


def tags(low: str, tag: str, start: int, end: int) -> list[tuple[int, str]]:
    """Place and class attribute of each tag between two places; ``low``: the page in ASCII lower case."""
    starts = [m.start() for m in _tag_start(tag).finditer(low, start, end)]
    found = []
    for first, last in zip(starts, [*starts[1:], end]):
        names = _CLASS.search(_opening(low, first, last))
        found.append((first, names[1] if names else ""))
    return found


def elements(found: list[tuple[int, str]], word: str, end: int) -> list[tuple[int, int]]:
    """From each tag with the class up to the next such tag."""
    starts = [start for start, names in found if word in names and _word(word).search(names)]
    return list(zip(starts, [*starts[1:], end]))


@cache
def _stop(ends: str) -> re.Pattern:
    return re.compile(ends)


def first_inside(html: str, low: str, parts: list[tuple[int, int]], ends: str) -> str | None:
    """Text behind the opening tag up to the first of the ends, of the first element that has one."""
    for start, end in parts:
        begin = low.find(">", start, end) + 1
        stop = _stop(ends).search(low, begin, end) if begin else None
        if stop:
            return html[begin : stop.start()]
    return None


@cache
def _identity(plans: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"""id=(?<!\wid=)["']({"|".join(map(re.escape, plans))})["']""")


def card_plan(low: str, start: int, end: int, plans: tuple[str, ...]) -> str | None:
    """The plan a card's id names; of several the last."""
    return max(_identity(plans).findall(_opening(low, start, end)), key=plans.index, default=None)


def first_between(mentions: list[Mention], after: int, before: int) -> str | None:
    return next((m[4] for m in mentions if after < m[0] < before), None)


def section_starts(text: str, country: str) -> list[int]:
    """Where the country is named; an empty name is found behind every character."""
    if country == "":
        return [*range(1, len(text) + 1), len(text)]
    starts, at = [], text.find(country)
    while at >= 0:
        starts.append(at)
        at = text.find(country, at + len(country))
    return starts


def tier_prices(section: str, mentions: list[Mention], tiers: tuple[str, ...]) -> list[str] | None:
    """A price for each tier of a section, or nothing."""
    prices = []
    for i, tier in enumerate(tiers):
        here = section.find(tier)
        until = len(section) if i + 1 == len(tiers) else section.find(tiers[i + 1], here + len(tier))
        price = first_between(mentions, here, until) if here >= 0 else None
        if price is None:
            return None
        prices.append(price)
    return prices


def near_word(
    text: str, low: str | None, mentions: list[Mention], places: list[tuple[int, int]], gap: int, crossing: Words
) -> str | None:
    """Price next to a word: no alternative between them, then nearest, then first.

    Words do not overlap, so those near a price are neighbours in their list.
    """
    ends, best = [w[1] for w in places], None
    for start, form, end, _, price in mentions:
        for k in range(bisect_left(ends, start - gap), len(places)):
            first, last = places[k]
            if first > end + gap:
                break
            between = first - end if first >= end else start - last if start >= last else None
            if between is not None:
                rank = (crossing.within(text, low, min(end, last), max(start, first)), between, start, form, price)
                best = rank if best is None or rank < best else best
    return best and best[4]


def behind_word(mentions: list[Mention], places: list[tuple[int, int]], gap: int) -> str | None:
    """First price shortly behind a word."""
    starts, best = [m[0] for m in mentions], None
    for first, last in places:
        k = bisect_left(starts, last)
        if k < len(starts) and starts[k] - first < gap:
            rank = (starts[k] - first, first, mentions[k][4])
            best = rank if best is None or rank < best else best
    return best and best[2]


def best_scored(
    text: str, low: str | None, mentions: list[Mention], word: Words, near: int, around: int, spoken: str | None, trial: tuple[Words, int] | None
) -> str | None:
    """Best price by distance to a word, names and trial wording around it."""
    rated: dict[str, list[float]] = {}
    for start, _, end, _, price in mentions:
        left = max(0, start - near)
        centre = start - left + (end - start) / 2
        context = word.spans(text[left : end + near], low and low[left : end + near])
        points = 320 - min([*(abs((a + b) / 2 - centre) for a, b in context), 180.0]) * 3
        first, last = max(0, start - around), end + around
        if spoken is not None and spoken in text[first:last].lower():
            points += 30
        if trial and trial[0].within(text, low, first, last):
            points += trial[1]
        known = rated.setdefault(price, [points, 0])
        known[0], known[1] = max(known[0], points), known[1] + 1
    # of equal totals the price mentioned first, which max keeps
    return max(rated, key=lambda price: rated[price][0] + min(rated[price][1], 8), default=None)
