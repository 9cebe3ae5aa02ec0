"""Prices out of page text: mentions, cadence, plan cards, storage tiers.

A page is one row and is read whole, in one pass on Arrow batches
(``page_text``); grouping and the rules between pages are native.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketladder.functions.amounts import numeric_amount
from marketladder.functions.arrays import kept_apart, once
from marketladder.functions.text import lookup
from marketladder.sources import page_text

# Canonical prefix and the one or two patterns of each currency.
PRICE_PATTERNS = {
    "CNY": ("RMB ", r"(?iu)(?:RMB|¥|￥)\s*([\d.,]+)", None),
    "USD": ("$", r"\$\s*([\d.,]+)", None),
    "HKD": ("HK$", r"(?iu)HK\$\s*([\d.,]+)", None),
    "TWD": ("NT$", r"(?iu)NT\$\s*([\d.,]+)", None),
    "VND": ("₫", r"₫\s*([\d.,]+)", r"(?iu)([\d.,]+)\s*(?:₫|đ)"),
    "SGD": ("S$", r"(?iu)S\$\s*([\d.,]+)", None),
    "JPY": ("¥", r"¥\s*([\d.,]+)", r"([\d.,]+)\s*円"),
    "KRW": ("₩", r"₩\s*([\d.,]+)", r"([\d.,]+)\s*원"),
    "THB": ("฿", r"฿\s*([\d.,]+)", None),
    "GBP": ("£", r"£\s*([\d.,]+)", None),
    "EUR": ("€", r"€\s*([\d.,]+)", r"([\d.,]+)\s*€"),
    "CAD": ("$", r"(?iu)(?:CA)?\$\s*([\d.,]+)", None),
    "TRY": ("₺", r"₺\s*([\d.,]+)", r"(?iu)([\d.,]+)\s*TL"),
    "AUD": ("$", r"(?iu)(?:A)?\$\s*([\d.,]+)", None),
    "PHP": ("₱", r"₱\s*([\d.,]+)", None),
    "NGN": ("₦", r"₦\s*([\d.,]+)", None),
    "INR": ("₹", r"₹\s*([\d.,]+)", r"(?iu)\bRs\.?\s*([\d.,]+)"),
    "BRL": ("R$", r"(?iu)R\$\s*([\d.,]+)", None),
    "IDR": ("Rp", r"(?iu)Rp\s*([\d.,]+)", None),
    "MXN": ("$", r"(?iu)(?:MX)?\$\s*([\d.,]+)", None),
    "NZD": ("$", r"(?iu)(?:NZ)?\$\s*([\d.,]+)", None),
    "AED": ("AED ", r"(?iu)(?:AED|د\.?إ\.?)\s*([\d.,]+)", None),
    "SAR": ("SAR ", r"(?iu)(?:SAR|ر\.?س\.?)\s*([\d.,]+)", r"([\d.,]+)\s*﷼"),
}

# Words that tell how often a price is paid.
CADENCE_WORDS = {
    "monthly": (
        r"(?iu)per\s+month|\/\s*month|\/\s*mo\.?|monthly|month|(?:por|al)\s+mes|mensual|月額|每月|月費|\/月|ayda"
        r"|aylık|tháng|매월|\/월|เดือน|monat|mois|mês|mensal|bulan"
    ),
    "annual": (
        r"(?iu)per\s+year|annually|annual|year|年間|年額|每年|年費|yıllık|senelik|năm|연간|\/년|ปี|jahr|jährlich"
        r"|annuel|par\s+an|al\s+año|ano|anual|tahun"
    ),
}
ALTERNATIVE_WORDS = r"(?iu)\b(?:or|ou|oder|atau|veya)\b|或|或者"
# Distances in characters and scores.
DIRECT_GAP, FOLLOWING_GAP, NEAR, AROUND, TIER_SECTION = 48, 45, 90, 130, 720
FOLLOWING_REGIONS = ["cn", "jp", "hk", "tw", "tr"]
# Words of trials and promotions.
TV_TRIAL = r"(?iu)free (?:7|seven)[-\s]?day|new subscriber|7日|7 天|7 gün"
NEWS_TRIAL = r"(?iu)free 1[-\s]?month|new subscriber|trial"
# Trial wording of a service, and its points.
TRIALS = {"apple-tv-plus": (TV_TRIAL, 80), "apple-news-plus": (NEWS_TRIAL, 60)}
ANNUAL_SERVICES = ["apple-arcade", "apple-fitness-plus"]
SERVICE_LABELS = {
    "apple-arcade": "Apple Arcade",
    "apple-fitness-plus": "Apple Fitness+",
    "apple-tv-plus": "Apple TV+",
    "apple-news-plus": "Apple News+",
}
# Fixed value: words of a promotion.
PROMOTION_WORDS = (
    r"(?iu)\b(?:free|trial|offer|new subscriber)s?\b|oferta|prueba|essai|gratuit|kostenlos|aktion|新規|無料|限时|限時"
    r"|優惠|优惠|\b\d+\s*(?:months?|meses|mois|monate)\b"
)
MUSIC_PLANS = {
    "individual": "Apple Music Individual",
    "family": "Apple Music Family",
    "student": "Apple Music Student",
}
STUDENT_IN_TEXT = ["cn"]
BUNDLE_PLANS = {
    "individual": "Apple One Individual",
    "family": "Apple One Family",
    "premier": "Apple One Premier",
}
STORAGE_TIERS = ["50 GB", "200 GB", "2 TB", "6 TB", "12 TB"]
# Named entities; the card form knows the first six only.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
MORE_ENTITIES = {"euro": "€", "pound": "£", "yen": "¥", "uuml": "ü"}
ALL_ENTITIES = tuple({**ENTITIES, **MORE_ENTITIES}.items())


def _decode_numeric(text: Column, pattern: str, base: int) -> Column:
    """Replace numeric character references by their characters."""

    def decoded(text: Column) -> Column:
        entities = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.aggregate(entities, text, lambda acc, entity: F.replace(acc, entity, character(entity)))

    def character(entity: Column) -> Column:
        digits = F.regexp_extract(entity, pattern, 1)
        point = F.conv(digits, base, 10).cast("decimal(20,0)")
        valid = (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        coded = F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0"))
        return F.when(valid, F.decode(coded, "UTF-32")).otherwise(entity)

    return once(text, decoded)


def html_to_text(html: Column, drop_scripts: bool = True) -> Column:
    """Readable text of a page; the plan-card form keeps script content."""
    text = html
    if drop_scripts:
        text = F.regexp_replace(text, r"(?i)<script\b[\s\S]*?</script>", " ")
        text = F.regexp_replace(text, r"(?i)<style\b[\s\S]*?</style>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", " ")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    text = _decode_numeric(text, r"(?i)&#x([0-9a-f]+);", 16)
    text = _decode_numeric(text, r"&#([0-9]+);", 10)
    names = {**ENTITIES, **MORE_ENTITIES} if drop_scripts else ENTITIES
    # "&" last, so that a decoded ampersand does not start another entity.
    for name, sign in sorted(names.items(), key=lambda pair: pair[0] == "amp"):
        text = F.regexp_replace(text, f"(?i)&{name};", sign)
    return F.trim(F.regexp_replace(text, r"(?U)[\s\uFEFF]+", " "))


MENTION = T.StructType([T.StructField(f, T.IntegerType()) for f in ("start", "form", "end")] + [T.StructField(f, T.StringType()) for f in ("amount", "price")])

_READERS: dict[str, list[re.Pattern]] = {}


def _mentions_of(text: str | None, currency: str | None) -> list[page_text.Mention]:
    if text is None or currency not in PRICE_PATTERNS:
        return []
    if currency not in _READERS:
        _READERS[currency] = [page_text.compiled(p) for p in PRICE_PATTERNS[currency][1:] if p]
    return page_text.mentions_of(text, PRICE_PATTERNS[currency][0], _READERS[currency])


def _structs(rows: list[tuple | None], kinds: dict[str, pa.DataType]) -> pa.StructArray:
    none = (None,) * len(kinds)
    columns = zip(*[none if row is None else row for row in rows]) if rows else [()] * len(kinds)
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds.values())]
    return pa.StructArray.from_arrays(arrays, list(kinds), mask=pa.array([row is None for row in rows], pa.bool_()))


def _lists(parts: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    ends = [0, *accumulate(len(part) for part in parts)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _structs(list(chain.from_iterable(parts)), kinds))


@F.arrow_udf(T.ArrayType(MENTION))
def _read_mentions(texts: pa.Array, currencies: pa.Array) -> pa.Array:
    kinds = {"start": pa.int32(), "form": pa.int32(), "end": pa.int32(), "amount": pa.string(), "price": pa.string()}
    return _lists([_mentions_of(*page) for page in zip(texts.to_pylist(), currencies.to_pylist())], kinds)


def price_mentions(text: Column, currency: Column) -> Column:
    """Prices of a text in order: array of (start, form, end, amount, price); empty without a text or a known currency.

    Read on Arrow batches, with each pattern made once a worker.
    """
    return _read_mentions(text, currency)


def extract_price_mentions(pages: DataFrame, keys: list[str], text: str = "text", currency: str = "currency") -> DataFrame:
    """One row per price mention of a page.

    A text of a currency is read once, however many pages show it; the shuffle
    that finds the distinct texts also spreads the reading over the tasks.
    Pages are joined back by digest, so their texts do not travel again.
    """
    distinct = pages.select(F.col(text).alias("__text"), F.col(currency).alias("__currency")).distinct()
    mentions = distinct.select(
        F.sha2("__text", 256).alias("__digest"), "__currency",
        F.posexplode(price_mentions(F.col("__text"), F.col("__currency"))).alias("seq", "m"),
    )
    shown = pages.select(*keys, F.sha2(text, 256).alias("__digest"), F.col(currency).alias("__currency"))
    return shown.join(mentions, ["__digest", "__currency"]).select(
        *keys, F.col("seq").cast("bigint").alias("seq"), F.col("m.start").cast("bigint").alias("start_at"),
        F.col("m.end").cast("bigint").alias("end_at"), F.col("m.amount").alias("amount"), F.col("m.price").alias("price"),
    )


def _cadence_of(
    cadence: str, text: str | None, mentions: list[page_text.Mention], region: str | None, service: str | None
) -> str | None:
    if text is None or not mentions:
        return None
    low, word = page_text.folded(text), page_text.words(CADENCE_WORDS[cadence])
    places = word.spans(text, low)
    price = page_text.near_word(text, low, mentions, places, DIRECT_GAP, page_text.words(ALTERNATIVE_WORDS))
    if price is None and cadence == "annual" and region in FOLLOWING_REGIONS:
        price = page_text.behind_word(mentions, places, FOLLOWING_GAP)
    if price is None:
        spoken = None if service is None else service.lower().replace("-plus", "+").replace("-", " ")
        trial = TRIALS.get(service)
        known = trial and (page_text.words(trial[0]), trial[1])
        price = page_text.best_scored(text, low, mentions, word, NEAR, AROUND, spoken, known)
    return price


def _cadence_reader(cadence: str):
    @F.arrow_udf(T.StringType())
    def read(texts: pa.Array, mentions: pa.Array, regions: pa.Array, services: pa.Array) -> pa.Array:
        ends = mentions.offsets.to_pylist()
        found = list(zip(*[mentions.values.field(f).to_pylist() for f in MENTION.names]))
        rows = zip(texts.to_pylist(), ends, ends[1:], regions.to_pylist(), services.to_pylist())
        return pa.array([_cadence_of(cadence, t, found[a:b], r, s) for t, a, b, r, s in rows], pa.string())

    return read


def assign_cadence(pages: DataFrame, cadence: str) -> DataFrame:
    """Add the price of one cadence (column named like it): next to a word, shortly behind one, else by score.

    pages: text, mentions, region, service.
    """
    return pages.withColumn(cadence, _cadence_reader(cadence)("text", "mentions", "region", "service"))


def service_prices(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly and annual price rows of service pages.

    pages: keys, text, currency, region, service.
    """
    read = kept_apart(pages, mentions=price_mentions(F.col("text"), F.col("currency")))
    both = assign_cadence(assign_cadence(read, "monthly"), "annual")
    annual = F.when(
        F.col("service").isin(ANNUAL_SERVICES) & ~F.coalesce(F.col("annual") == F.col("monthly"), F.lit(False)),
        F.col("annual"),
    )
    label = lookup(F.col("service"), SERVICE_LABELS)
    rows = F.array(
        F.struct(F.concat(label, F.lit(" Monthly")).alias("name"), F.col("monthly").alias("price")),
        F.struct(F.concat(label, F.lit(" Annual")).alias("name"), annual.alias("price")),
    )
    return (
        both.select(*keys, F.posexplode(rows).alias("pos", "r"))
        .select(*keys, F.col("pos").cast("bigint").alias("pos"), "r.name", "r.price")
        .filter(F.col("price").isNotNull())
    )


def extract_plan_cards(pages: DataFrame, keys: list[str], html: str = "html", currency: str = "currency") -> DataFrame:
    """Recurring price per plan from the cards of a page.

    A card with several amounts wins (its last amount is the recurring price),
    else the first that is no promotion, else the only card with a price.
    """
    return _card_prices(pages, keys, html, currency).drop("amount")


OPTION = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("card_no", T.IntegerType()), T.StructField("price", T.StringType()),
    T.StructField("amount", T.StringType()), T.StructField("cards", T.IntegerType()),
])


def _plan_options(html: str | None, currency: str | None) -> dict[str, tuple]:
    """Each plan's best card of a page, and how many of its cards have a price.

    Kind 0 has several amounts, 1 is no promotion, 2 is a promotion.
    """
    if html is None or currency not in PRICE_PATTERNS:
        return {}
    # Class names of a card and its headline, and what ends a headline.
    card_class, headline_class, headline_ends = "gallery-item", "tile-headline", r"</p>|<ul\b|</div>"
    best: dict[str, tuple] = {}
    low = page_text.ascii_lower(html)
    cards = page_text.elements(page_text.tags(low, "li", 0, len(low)), card_class, len(low))
    for card_no, (start, end) in enumerate(cards):
        plan = page_text.card_plan(low, start, end, tuple(MUSIC_PLANS))
        if plan is None:
            continue
        headlines = page_text.elements(page_text.tags(low, "p", start, end), headline_class, end)
        headline = page_text.first_inside(html, low, headlines, headline_ends)
        text = None if headline is None else page_text.plain_text(headline, tuple(ENTITIES.items()), False)
        mentions = _mentions_of(text, currency)
        if mentions:
            kind = 0 if len(mentions) > 1 else 2 if page_text.words(PROMOTION_WORDS).within(text, page_text.folded(text), 0, len(text)) else 1
            option = (kind, card_no, mentions[-1][4], mentions[-1][3])
            before = best.get(plan)
            best[plan] = (*min(option, before[:4] if before else option), (before[4] if before else 0) + 1)
    return best


@F.arrow_udf(T.StructType([T.StructField(plan, OPTION) for plan in MUSIC_PLANS]))
def _read_plans(pages: pa.Array, currencies: pa.Array) -> pa.Array:
    kinds = {"kind": pa.int32(), "card_no": pa.int32(), "price": pa.string(), "amount": pa.string(), "cards": pa.int32()}
    read = [_plan_options(*page) for page in zip(pages.to_pylist(), currencies.to_pylist())]
    return pa.StructArray.from_arrays([_structs([page.get(plan) for page in read], kinds) for plan in MUSIC_PLANS], list(MUSIC_PLANS))


def _card_prices(pages: DataFrame, keys: list[str], html: str, currency: str) -> DataFrame:
    """Plan, name, price and its canonical amount text.

    One row a page is grouped, with the best card of each plan; cards of pages
    with equal keys count as cards of one page.
    """
    read = kept_apart(pages.select(*keys, F.col(html).alias("__html"), F.col(currency).alias("__currency")), __read=_read_plans("__html", "__currency"))
    options = read.select(*keys, *[F.col(f"__read.{plan}").alias(f"__{plan}") for plan in MUSIC_PLANS])
    priced = options.filter(reduce(Column.__or__, [F.col(f"__{plan}").isNotNull() for plan in MUSIC_PLANS]))
    picked = priced.groupBy(*keys).agg(
        *[F.min(f"__{plan}").alias(f"__{plan}") for plan in MUSIC_PLANS],
        *[F.sum(f"__{plan}.cards").alias(f"__{plan}_cards") for plan in MUSIC_PLANS],
    )

    def row(plan: str, name: str) -> Column:
        best = F.col(f"__{plan}")
        counts = (best["kind"] < 2) | (F.col(f"__{plan}_cards") == 1)
        return F.struct(
            F.lit(plan).alias("plan"), F.lit(name).alias("name"), F.when(counts, best["price"]).alias("price"), best["amount"].alias("amount")
        )

    rows = F.inline(F.array(*[row(*pair) for pair in MUSIC_PLANS.items()]))
    return picked.select(*keys, rows).filter(F.col("price").isNotNull())


def plan_prices(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Prices of plan cards, and the student plan where a market prints it in the text only.

    pages: keys, html, currency, region; the keys tell pages apart.  In the
    markets of ``STUDENT_IN_TEXT`` a page with an individual card and no student
    card has as student price the highest one below the individual plan's.
    """
    cards = _card_prices(pages, keys, "html", "currency").drop("amount")
    asked = pages.filter(F.col("region").isin(STUDENT_IN_TEXT)).select(*keys, "html", "currency")
    amount = F.max(F.when(F.col("plan") == "individual", F.col("amount")))
    student = F.max(F.col("plan") == "student")
    known = _card_prices(asked, keys, "html", "currency").groupBy(*keys).agg(amount.alias("anchor_amount"), student.alias("student"))
    missing = known.filter("anchor_amount IS NOT NULL AND NOT student").drop("student")
    found = fallback_below_anchor(kept_apart(asked.join(missing, keys), text=html_to_text(F.col("html"))), keys)
    return cards.unionByName(
        found.select(*keys, F.lit("student").alias("plan"), F.lit(MUSIC_PLANS["student"]).alias("name"), "price")
    )


def page_prices(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Named prices of official pages, each read in the way of its service.

    pages: keys, html, service, region, country, currency; the keys tell pages
    apart.  Storage pages are read by section, bundle and music pages by card,
    all others by the cadence of their prices; a service without a reader gives
    no rows, as does a page without prices.
    """
    own = lambda *services: pages.filter(F.col("service").isin(*services))
    with_text = lambda df: kept_apart(df, text=html_to_text(F.col("html")))
    parts = [
        extract_tier_section(with_text(own("icloud-plus")), keys),
        extract_bundle_cards(own("apple-one"), keys),
        plan_prices(own("apple-music"), keys),
        service_prices(with_text(own(*SERVICE_LABELS)), keys),
    ]
    return reduce(DataFrame.unionByName, [part.select(*keys, "name", "price") for part in parts])


def _bundle_prices(html: str | None, currency: str | None) -> list[tuple[str, str, str]]:
    if html is None or currency not in PRICE_PATTERNS:
        return []
    low, found = page_text.ascii_lower(html), []
    paragraphs = page_text.tags(low, "p", 0, len(low))
    for plan, name in BUNDLE_PLANS.items():
        paragraph = page_text.first_inside(html, low, page_text.elements(paragraphs, f"plan-{plan}", len(low)), "</p>")
        if paragraph is not None:
            mentions = _mentions_of(page_text.plain_text(paragraph, ALL_ENTITIES, True), currency)
            if mentions:
                found.append((plan, name, mentions[0][4]))
    return found


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("plan", "name", "price")])))
def _read_bundles(pages: pa.Array, currencies: pa.Array) -> pa.Array:
    kinds = dict.fromkeys(("plan", "name", "price"), pa.string())
    return _lists([_bundle_prices(*page) for page in zip(pages.to_pylist(), currencies.to_pylist())], kinds)


def extract_bundle_cards(pages: DataFrame, keys: list[str], html: str = "html", currency: str = "currency") -> DataFrame:
    """First price of each bundle plan's paragraph."""
    return pages.select(*keys, F.inline(_read_bundles(html, currency)))


def _first_section(text: str | None, country: str | None, currency: str | None) -> tuple[int, list[str]] | None:
    """Number and prices of a page's first section that prices all tiers."""
    if text is None or country is None or currency not in PRICE_PATTERNS:
        return None
    for number, start in enumerate(page_text.section_starts(text, country)):
        section = text[start : start + TIER_SECTION]
        if all(tier in section for tier in STORAGE_TIERS):
            prices = page_text.tier_prices(section, _mentions_of(section, currency), tuple(STORAGE_TIERS))
            if prices is not None:
                return number, prices
    return None


@F.arrow_udf(T.StructType([T.StructField("section_no", T.IntegerType()), T.StructField("prices", T.ArrayType(T.StringType()))]))
def _read_section(texts: pa.Array, countries: pa.Array, currencies: pa.Array) -> pa.Array:
    pages = zip(texts.to_pylist(), countries.to_pylist(), currencies.to_pylist())
    return _structs([_first_section(*page) for page in pages], {"section_no": pa.int32(), "prices": pa.list_(pa.string())})


def extract_tier_section(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Storage tiers of a market: the first section that prices all of them.

    pages: keys, text, country, currency.  A section is the text behind one
    mention of the country.
    """
    read = kept_apart(pages, __best=_read_section("text", "country", "currency")).select(*keys, "__best")
    complete = read.filter(F.col("__best").isNotNull()).groupBy(*keys).agg(F.min("__best").alias("best"))
    names = F.array(*[F.lit(f"iCloud+ {tier}") for tier in STORAGE_TIERS])
    return complete.select(*keys, F.posexplode("best.prices").alias("pos", "price")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.element_at(names, F.col("pos") + 1).alias("name"), "price"
    )


def fallback_below_anchor(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Highest price of a page strictly below the individual plan.

    pages: keys, text, currency, anchor_amount (canonical text of the plan).
    """
    anchor = numeric_amount(F.col("anchor_amount"), F.col("currency"))
    rows = extract_price_mentions(kept_apart(pages, anchor=anchor), [*keys, "currency", "anchor"])
    amount = numeric_amount(F.col("amount"), F.col("currency"))
    below = kept_apart(rows, value=amount).filter((F.col("value") > 0) & (F.col("value") < F.col("anchor")))
    best = F.max(F.struct("value", (-F.col("seq")).alias("earliest"), "price"))
    return below.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.price").alias("price"))
