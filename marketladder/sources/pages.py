"""Tables of fetched pages and payloads to item rows.

Slicing, classification and structured payloads are native expressions.  Only
the walk through JSON of unknown depth runs in Python, one page at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketladder.functions.arrays import kept_apart, once
from marketladder.functions.status import NOT_FOUND, is_transient_error
from marketladder.functions.text import icon_address, strip

# The marker around the page data, and the section title.
START = '<script type="application/json" id="serialized-server-data">'
END = "</script>"
SECTION = "In-App Purchases"


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


PAGE = _texts("status", "matched_name", "developer", "icon").add("items", T.ArrayType(_texts("name", "price")))
SEARCH_HITS = T.ArrayType(_texts("app_id", "app_name", "developer", "icon"))


def marked_json(html: Column) -> Column:
    """Text between the marker and the end of its script (null if either is missing)."""
    first = F.locate(START, html)
    tail = F.substr(html, first + F.lit(len(START)))
    end = F.instr(tail, END)
    return F.when((first > 0) & (end > 0), F.substr(tail, F.lit(1), end - 1))


def marker_status(html: Column) -> Column:
    first = F.locate(START, html)
    tail = F.substr(html, first + F.lit(len(START)))
    return F.when(first == 0, "marker-missing").when(F.instr(tail, END) == 0, "marker-unclosed")


def _depth_first(root: Any) -> Iterator[dict]:
    """Objects of a document, later children before earlier ones."""
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, dict):
            yield node
            open_nodes.extend(v for v in node.values() if isinstance(v, (dict, list)))
        elif isinstance(node, list):
            open_nodes.extend(v for v in node if isinstance(v, (dict, list)))


def _section(node: dict) -> tuple[str, list] | None:
    """Status and (name, price) pairs if the node is the purchase section."""
    if node.get("title") != SECTION:
        return None
    items = node.get("items")
    head = items[0] if isinstance(items, list) and items else None
    pairs = head.get("textPairs") if isinstance(head, dict) else None
    if pairs:
        return "ok-textPairs", [(pair[0], pair[1]) for pair in pairs]
    rows = node.get("items_V3")
    if isinstance(rows, list):
        texts = [r for r in rows if isinstance(r, dict) and r.get("$kind") == "textPair"]
        return "ok-itemsV3", [(r.get("leadingText"), r.get("trailingText")) for r in texts]
    return None


def _metadata(node: dict) -> tuple[str, str, str | None] | None:
    lockup, action = node.get("lockup"), node.get("developerAction")
    if not isinstance(node.get("title"), str) or not isinstance(lockup, dict) or not isinstance(action, dict):
        return None
    developer = action.get("title")
    icon = lockup.get("icon")
    template = icon.get("template") if isinstance(icon, dict) else None
    return node["title"], developer if isinstance(developer, str) else "", template if isinstance(template, str) else None


def _read_page(text: str | None, first_wins: bool) -> tuple:
    if text is None:
        return None, None, None, None, []
    section = metadata = None
    try:
        root = json.loads(text)
    except ValueError:
        return "error:invalid-json", None, None, None, []
    for node in _depth_first(root):
        metadata = metadata or _metadata(node)
        found = _section(node)
        if found:
            section = found
            if first_wins:
                break
    status, pairs = section or ("iap-section-missing", [])
    items = [{"name": "" if n is None else str(n), "price": "" if p is None else str(p)} for n, p in pairs]
    return status, *(metadata or (None, None, None)), items


def _page_reader(first_wins: bool):
    @F.pandas_udf(PAGE)
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([_read_page(text, first_wins) for text in part], columns=PAGE.names)

    return read


def extract_embedded_json(pages: DataFrame, html: str = "html", first_wins: bool = True) -> DataFrame:
    """status, metadata and clean items of store pages with embedded JSON.

    ``first_wins`` stops at the first purchase section (the batch form);
    otherwise the last one visited counts (the form of the request API).
    """
    page = _page_reader(first_wins)(marked_json(F.col(html)))
    kept = [c for c in pages.columns if c != html]
    read = pages.select(*kept, marker_status(F.col(html)).alias("__marker"), page.alias("p"))
    return read.select(
        *kept,
        F.coalesce("__marker", "p.status").alias("status"),
        F.col("p.matched_name").alias("matched_name"),
        F.col("p.developer").alias("developer"),
        icon_address(F.col("p.icon")).alias("icon"),
        clean_items(F.col("p.items")).alias("items"),
    )


def clean_items(items: Column) -> Column:
    """Trim names and prices, drop blanks, keep the first of each pair, in place."""
    trimmed = F.transform(items, lambda i: F.struct(strip(i["name"]).alias("name"), strip(i["price"]).alias("price")))
    return F.array_distinct(F.filter(trimmed, lambda i: (i["name"] != "") & (i["price"] != "")))


def page_items(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Item rows (keys, pos, name, price) of extracted pages."""
    return extracted.select(*keys, F.posexplode("items").alias("pos", "i")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), "i.name", "i.price"
    )


def _read_hits(text: str | None) -> list[dict]:
    if text is None:
        return []
    try:
        queue = [json.loads(text)]
    except ValueError:
        return []
    hits, seen = [], set()
    for node in queue:  # the list grows while it is read: breadth first
        children = node.values() if isinstance(node, dict) else node
        lockup = node.get("lockup") if isinstance(node, dict) else None
        if isinstance(lockup, dict) and node.get("resultType") != "bundle":
            app, title, maker = str(lockup.get("adamId") or ""), lockup.get("title"), lockup.get("subtitle")
            known = app.isascii() and app.isdigit() and 6 <= len(app) <= 12
            if known and isinstance(title, str) and app not in seen:
                seen.add(app)
                icon = lockup.get("icon")
                template = icon.get("template") if isinstance(icon, dict) else None
                hits.append(
                    {
                        "app_id": app,
                        "app_name": title.strip(),
                        "developer": maker.strip() if isinstance(maker, str) else "",
                        "icon": template if isinstance(template, str) else None,
                    }
                )
        queue.extend(child for child in children if isinstance(child, (dict, list)))
    return hits


@F.pandas_udf(SEARCH_HITS)
def _search_hits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(_read_hits)


def extract_search_results(pages: DataFrame, keys: list[str], region: Column, html: str = "html") -> DataFrame:
    """Apps listed on search pages, in page order, bundles left out."""
    hits = pages.select(*keys, region.alias("source_region"), _search_hits(marked_json(F.col(html))).alias("h"))
    rows = hits.select(*keys, "source_region", F.posexplode("h").alias("pos", "a"))
    return rows.select(
        *keys, "source_region", F.col("pos").cast("bigint").alias("pos"), "a.app_id", "a.app_name", "a.developer",
        icon_address(F.col("a.icon")).alias("icon"),
        F.concat(F.lit("https://apps.apple.com/"), "source_region", F.lit("/app/id"), "a.app_id").alias("store_url"),
    )


OFFER = "struct<type:string,priceFormatted:string,recurringSubscriptionPeriod:string>"
PRODUCT = (
    f"struct<id:string,attributes:struct<name:string,offerName:string,subscriptionFamilyId:string,"
    f"isSubscription:boolean,offers:array<{OFFER}>>>"
)
PAYLOAD = (
    "data array<struct<id:string,attributes:struct<name:string,artistName:string,url:string>,"
    f"views:struct<`top-in-app-purchasables`:struct<data:array<{PRODUCT}>>>>>"
)


def _text(column: Column) -> Column:
    """Trimmed text, null when blank."""
    return F.when(strip(column) != "", strip(column))


def read_structured_catalog(payloads: DataFrame, payload: str, app_id: str) -> DataFrame:
    """The expected app of each payload: status, metadata and complete products."""
    expected = F.filter(F.from_json(payload, PAYLOAD)["data"], lambda a: a["id"] == F.col(app_id))
    parsed = kept_apart(payloads, __app=F.get(expected, F.lit(0)))
    raw = F.col("__app.views.`top-in-app-purchasables`.data")

    # In steps, as an array expression works out again what it names twice.
    def with_offer(entry: Column, pos: Column) -> Column:
        offers = entry["attributes"]["offers"]
        offer = F.coalesce(F.get(F.filter(offers, lambda o: o["type"] == "buy"), F.lit(0)), F.get(offers, F.lit(0)))
        return F.struct(pos.cast("bigint").alias("pos"), entry["id"].alias("id"), entry["attributes"].alias("a"), offer.alias("offer"))

    def trimmed(entry: Column) -> Column:
        return F.struct(
            entry["pos"].alias("pos"),
            strip(entry["a"]["name"]).alias("name"),
            strip(entry["offer"]["priceFormatted"]).alias("price"),
            strip(entry["id"]).alias("product_id"),
            strip(entry["a"]["offerName"]).alias("offer_name"),
            strip(entry["offer"]["recurringSubscriptionPeriod"]).alias("billing_period"),
            strip(entry["a"]["subscriptionFamilyId"]).alias("family_id"),
            entry["a"]["isSubscription"].alias("is_subscription"),
        )

    def product(entry: Column) -> Column:
        texts = ["name", "price", "product_id", "offer_name", "billing_period", "family_id"]
        return F.struct(
            entry["pos"].alias("pos"), *[F.when(entry[t] != "", entry[t]).alias(t) for t in texts], entry["is_subscription"].alias("is_subscription")
        )

    complete = F.filter(
        F.transform(F.transform(F.transform(raw, with_offer), trimmed), product),
        lambda p: p["name"].isNotNull() & p["price"].isNotNull() & p["product_id"].isNotNull(),
    )
    status = (
        F.when(F.col("__app").isNull(), "catalog-app-missing")
        .when(raw.isNull(), "catalog-iap-view-missing")
        .when(F.size("products") == 0, "catalog-iap-empty")
        .otherwise("ok-structured")
    )
    kept = [c for c in payloads.columns if c != payload]
    return (
        kept_apart(parsed, products=complete)
        .withColumn("status", status)
        .select(
            *kept, "status",
            _text(F.col("__app.attributes.name")).alias("matched_name"),
            F.when(F.col("__app").isNotNull(), F.coalesce(_text(F.col("__app.attributes.artistName")), F.lit("")))
            .alias("developer"),
            _text(F.col("__app.attributes.url")).alias("store_url"),
            "products",
        )
    )


def structured_items(catalogs: DataFrame, keys: list[str], outer: bool = False) -> DataFrame:
    """Product rows of read payloads, the first row of each product; ``outer``: and a row for a payload without any.

    A payload is one bounded document, so repeats are dropped inside its list
    and nothing is shuffled.
    """
    def first_of_each(ids: Column) -> Column:
        return F.filter("products", lambda p, i: F.array_position(ids, p["product_id"]) == i + 1)

    first = once(F.transform("products", lambda p: p["product_id"]), first_of_each)
    rows = F.explode_outer(first) if outer else F.explode(first)
    return catalogs.select(*keys, "status", rows.alias("p")).select(*keys, "status", "p.*")


def prefer_structured(structured: DataFrame, web: DataFrame, anchor: Column) -> DataFrame:
    """Per (app, market): the structured result if ok, else the web result.

    Both: app_id, region, status, item_count.  The web row then carries the
    structured failure as identity_status.  In the anchor market a definite
    absence on the web page ends the search.
    """
    s = structured.select("app_id", "region", F.struct("status", "item_count").alias("s"))
    w = web.select("app_id", "region", F.struct("status", "item_count").alias("w"))
    joined = s.join(w, ["app_id", "region"], "full")
    final_absence = anchor & F.coalesce(F.col("w.status").isin("iap-section-missing", NOT_FOUND), F.lit(False))
    take = (
        F.when(final_absence, "web")
        .when(F.coalesce(F.col("s.status") == "ok-structured", F.lit(False)), "structured")
        .otherwise("web")
    )
    from_web = F.col("source") == "web"
    missing_page = F.coalesce(F.col("w.status") == NOT_FOUND, F.lit(False))
    return joined.withColumn("source", take).select(
        "app_id", "region", "source",
        F.when(from_web, F.col("w.status")).otherwise(F.col("s.status")).alias("status"),
        F.coalesce(F.when(from_web, F.col("w.item_count")).otherwise(F.col("s.item_count")), F.lit(0).cast("bigint"))
        .alias("item_count"),
        F.when(from_web & ~final_absence & ~missing_page, F.col("s.status")).alias("identity_status"),
    )


def needs_second_fetch(rows: DataFrame) -> DataFrame:
    """Anchor rows whose web page failed for a passing reason."""
    return rows.filter(is_transient_error(F.col("status")))
