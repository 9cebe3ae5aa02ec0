"""Queries for documents, fetched pages and the prices in their text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketladder.functions import status
from marketladder.plans import fixtures as fx
from marketladder.plans.oracle_base import OBS, RATE_ROWS
from marketladder.plans.q_functions import STORE, STORE_VALUES
from marketladder.plans.registry import n_rows, query
from marketladder.session import checkpoint_folder
from marketladder.sources import pages, prices, snapshot, split_json

# Documents: one small snapshot per observation.


@query(
    "scan_snapshot",
    "O01",
    f"""WITH {OBS}, d AS (SELECT *, status LIKE 'ok-%' AS ok FROM raw),
    i AS (SELECT app_id, region, ord, status, identity_status, 0::BIGINT AS pos, name, price, product_id, billing_period FROM d WHERE ok
      UNION ALL SELECT app_id, region, ord, status, identity_status, 1, name || ' Extra', '$1.99', NULL, NULL FROM d WHERE ok
      UNION ALL SELECT app_id, region, ord, status, identity_status, NULL, NULL, NULL, NULL, NULL FROM d WHERE NOT ok)
    SELECT '2026-07-14' AS generated_at, app_id, 'App ' || app_id AS app_name, region, 0::BIGINT AS region_place, status, identity_status,
      CASE WHEN pos IS NULL THEN 0 ELSE 2 END::BIGINT AS item_count, pos, name, price, product_id, billing_period, count(*) AS rows FROM i GROUP BY ALL""",
)
def _scan(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("status").startswith("ok-")
    first = F.struct(
        "name", "price", F.col("product_id").alias("productId"), F.col("billing_period").alias("billingPeriod")
    )
    none = F.lit(None).cast("string")
    second = F.struct(
        F.concat("name", F.lit(" Extra")).alias("name"), F.lit("$1.99").alias("price"), none.alias("productId"),
        none.alias("billingPeriod"),
    )
    region = F.struct(
        "region", "status", F.col("identity_status").alias("identityStatus"), F.when(ok, 2).otherwise(0).alias("itemCount"),
        F.when(ok, F.array(first, second)).otherwise(F.array()).alias("items"),
    )
    app = F.struct(
        F.col("app_id").alias("id"), F.concat(F.lit("App "), "app_id").alias("matchedName"), F.array(region).alias("regions")
    )
    document = F.to_json(F.struct(F.lit("2026-07-14").alias("generatedAt"), F.array(app).alias("apps")))
    rows = snapshot.parse_snapshot(fx.raw_rows(spark, sf).select(document.alias("document")), "document")
    columns = [
        "generated_at", "app_id", "app_name", "region", F.col("ord").alias("region_place"), "status", "identity_status",
        "item_count", "pos", "name", "price", "product_id", "billing_period",
    ]
    return rows.groupBy(*columns).agg(n_rows())


# Files: one pretty-printed document for every 4,096 orders, with its apps, markets and items.
ORDERS_PER_FILE = 4096


def snapshot_files(spark: SparkSession, sf: str) -> str:
    """Write the documents; each is one row, and so one file in a folder of its own."""
    rows = fx.raw_rows(spark, sf).withColumn("doc", F.floor(F.col("pos") / F.lit(ORDERS_PER_FILE * 8 * 2**22)))
    listed = F.when(F.col("status").startswith("ok-"), F.struct("pos", "name", "price", F.col("product_id").alias("productId"), F.col("billing_period").alias("billingPeriod")))
    cell = F.array_sort(F.collect_list(listed))
    regions = rows.groupBy("doc", "app_id", "region", "status").agg(cell.alias("items")).select(
        "doc", "app_id", F.struct("region", "status", F.size("items").alias("itemCount"), F.transform("items", lambda i: i.dropFields("pos")).alias("items")).alias("r")
    )
    apps = regions.groupBy("doc", "app_id").agg(F.array_sort(F.collect_list("r")).alias("regions"))
    app = F.struct(F.col("app_id").alias("id"), F.concat(F.lit("App {"), "app_id").alias("matchedName"), F.lit("t1").alias("verifiedAt"), "regions")
    documents = apps.groupBy("doc").agg(F.array_sort(F.collect_list(app)).alias("apps"))
    whole = F.to_json(F.struct(F.concat(F.lit("t"), F.col("doc").cast("string")).alias("generatedAt"), "apps"), {"pretty": "true"})
    folder = f"{checkpoint_folder(spark).rstrip('/')}/marketladder/snapshots-{uuid.uuid4().hex}"
    documents.select("doc", whole.alias("value")).write.partitionBy("doc").text(folder)
    return folder


@query(
    "scan_snapshot_files",
    "O01",
    f"""WITH {OBS}, d AS (SELECT pos // {ORDERS_PER_FILE * 8 * 2**22} AS doc, * FROM raw),
    c AS (SELECT doc, app_id, region, status, count(*) FILTER (status LIKE 'ok-%') AS item_count FROM d GROUP BY ALL),
    o AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY app_id) - 1 AS app_ord,
        row_number() OVER (PARTITION BY doc, app_id ORDER BY region, status) - 1 AS ord FROM c),
    i AS (SELECT doc, app_id, region, status, name, price, product_id, billing_period,
        row_number() OVER (PARTITION BY doc, app_id, region, status ORDER BY pos, name, price, product_id, billing_period) - 1 AS pos FROM d WHERE status LIKE 'ok-%')
    SELECT 't' || doc AS generated_at, 't1' AS verified_at, app_ord, app_id, 'App {{' || app_id AS app_name, ord AS region_place, region, status, item_count,
      pos, name, price, product_id, billing_period FROM o LEFT JOIN i USING (doc, app_id, region, status)""",
)
def _scan_files(spark: SparkSession, sf: str) -> DataFrame:
    # The text source lists the folders of the documents; a file is split like any text file.
    return split_json.scan_snapshot(spark, f"{snapshot_files(spark, sf)}/doc=*").select(
        "generated_at", "verified_at", "app_ord", "app_id", "app_name", F.col("ord").alias("region_place"), "region", "status",
        "item_count", "pos", "name", "price", "product_id", "billing_period",
    )


@query(
    "scan_fx",
    "O02",
    f"""WITH {STORE}, q AS (SELECT s_suppkey, 'USD' AS currency, (s_suppkey % 100) / 1000.0 + 0.1 AS units FROM supplier
      UNION ALL SELECT s_suppkey, 'EUR', 0.125 FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'JPY', 23.5 FROM supplier WHERE s_suppkey % 3 <> 0)
    SELECT s_suppkey, currency, units::DOUBLE AS units, FALSE AS missing FROM q
    UNION ALL SELECT s.s_suppkey, c.currency, NULL, TRUE FROM supplier s CROSS JOIN (SELECT DISTINCT currency FROM store) c
      WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.s_suppkey = s.s_suppkey AND q.currency = c.currency)""",
)
def _scan_fx(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    quoted = F.map_from_entries(
        F.array_compact(
            F.array(
                F.struct(F.lit("USD").alias("c"), ((key % 100) / 1000.0 + 0.1).alias("u")),
                F.struct(F.lit("EUR").alias("c"), F.when(key % 5 != 0, F.lit(0.125)).alias("u")),
                F.when(key % 3 != 0, F.struct(F.lit("JPY").alias("c"), F.lit(23.5).alias("u"))),
            )
        )
    )
    document = F.to_json(F.struct(F.lit("success").alias("result"), F.lit("CNY").alias("base"), quoted.alias("rates")))
    documents = fx.table(spark, sf, "supplier").select("s_suppkey", document.alias("document"))
    rates = snapshot.scan_fx(documents, "document", ["s_suppkey"])
    missing = snapshot.missing_currencies(rates, documents, snapshot.storefronts(spark), ["s_suppkey"])
    return rates.withColumn("missing", F.lit(False)).unionByName(
        missing.select("s_suppkey", "currency", F.lit(None).cast("double").alias("units"), F.lit(True).alias("missing"))
    )


@query(
    "scan_dimensions",
    "O03",
    f"""WITH {STORE}, fx(currency, units) AS (VALUES {RATE_ROWS})
    SELECT s.region, s.name, s.currency, s.storefront_id::BIGINT AS storefront_id, s.host, s.country, s.ord::BIGINT AS place, f.units, count(*) AS rows
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN store s ON s.ord = s_nationkey % 18 JOIN fx f ON f.currency = s.currency GROUP BY ALL""",
)
def _dimensions(spark: SparkSession, sf: str) -> DataFrame:
    stores = snapshot.storefronts(spark)
    rates = snapshot.require_rates(fx.rates(spark), stores)
    line, supplier = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "supplier")
    used = line.join(supplier, line.l_suppkey == supplier.s_suppkey).groupBy(
        (F.col("s_nationkey") % 18).cast("bigint").alias("place")
    ).agg(n_rows())
    return used.join(stores.withColumnRenamed("ord", "place"), "place").join(rates, "currency")


ENTRY = """CASE p_partkey % 10 WHEN 0 THEN '"' || id || '"' WHEN 1 THEN '{"id":" ' || id || ' ","group":" G ","query":" "}'
  WHEN 2 THEN '{"id":""}' WHEN 3 THEN '{"id":"abc' || id || '"}' WHEN 4 THEN '{"id":"abc' || id || '","metadata":{"matchedName":"x"}}'
  WHEN 5 THEN '{"id":"' || id || '","regionalAppIds":[1]}' WHEN 6 THEN '{"id":"' || id || '","regionalAppIds":{" US ":" 12 ","jp":"34"},"excludeItemNames":[" a ","","b"]}'
  WHEN 7 THEN '{"id":"' || id || '","regionalAppIds":{"usa":"12"}}' WHEN 8 THEN '{"id":"' || id || '","regionalAppIds":{"us":"x1"}}'
  ELSE '{"id":"' || id || '","excludeItemNames":"a"}' END"""


def catalog_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Raw catalog entries, most of them broken in one way each."""
    n = (F.col("p_partkey") % 1500 + 100000).cast("string")
    kind = F.col("p_partkey") % 10
    forms = [
        ('"', n, '"'),
        ('{"id":" ', n, ' ","group":" G ","query":" "}'),
        ('{"id":""}', F.lit(""), ""),
        ('{"id":"abc', n, '"}'),
        ('{"id":"abc', n, '","metadata":{"matchedName":"x"}}'),
        ('{"id":"', n, '","regionalAppIds":[1]}'),
        ('{"id":"', n, '","regionalAppIds":{" US ":" 12 ","jp":"34"},"excludeItemNames":[" a ","","b"]}'),
        ('{"id":"', n, '","regionalAppIds":{"usa":"12"}}'),
        ('{"id":"', n, '","regionalAppIds":{"us":"x1"}}'),
        ('{"id":"', n, '","excludeItemNames":"a"}'),
    ]
    texts = F.array(*[F.concat(F.lit(a), b, F.lit(c)) for a, b, c in forms])
    return fx.table(spark, sf, "part").select("p_partkey", F.get(texts, kind.cast("int")).alias("entry"))


@query(
    "normalize_catalog",
    "O04",
    """WITH e AS (SELECT p_partkey, (100000 + p_partkey % 1500)::VARCHAR AS id, p_partkey % 10 AS k FROM part),
      n AS (SELECT p_partkey, k, CASE k WHEN 2 THEN '' WHEN 3 THEN 'abc' || id WHEN 4 THEN 'abc' || id ELSE id END AS app_id FROM e),
      d AS (SELECT app_id, count(*) AS c FROM n GROUP BY ALL)
    SELECT p_partkey, n.app_id, CASE WHEN k = 1 THEN 'G' END AS catalog_group, CASE k WHEN 2 THEN 'missing-id' WHEN 3 THEN 'id-not-numeric' WHEN 5 THEN 'regional-ids-not-an-object'
      WHEN 7 THEN 'invalid-region-code' WHEN 8 THEN 'invalid-regional-id' WHEN 9 THEN 'exclusions-not-a-list' END AS problem,
      CASE k WHEN 6 THEN 'us=12 jp=34' WHEN 7 THEN 'usa=12' WHEN 8 THEN 'us=x1' END AS regional, CASE WHEN k = 6 THEN 'a,b' END AS excluded, d.c > 1 AS duplicate
    FROM n JOIN d USING (app_id)""",
)
def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    rows = snapshot.normalize_catalog(catalog_entries(spark, sf), "entry")
    twice = snapshot.duplicate_ids(rows).select("app_id", F.lit(True).alias("duplicate"))
    entry = F.transform(F.map_entries("regional_ids"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.join(twice, "app_id", "left").select(
        "p_partkey", "app_id", "catalog_group", "problem",
        F.when(F.size(entry) > 0, F.array_join(entry, " ")).alias("regional"),
        F.array_join("excluded", ",").alias("excluded"), F.coalesce("duplicate", F.lit(False)).alias("duplicate"),
    )


# Store pages: every fetched page gets page data in one of six forms.


def store_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id").cast("string")

    def pairs(*names: str) -> str:
        return ",".join(f'["{name}","$#.99"]' for name in names)

    section = '{"title":"In-App Purchases",'
    meta = '"title":"Name #","developerAction":{"title":"Maker #"},"lockup":{"icon":{"template":"https://i.test/{w}x{h}.{f}"}}'
    texts = section + '"items":[{"textPairs":[' + pairs(" One ", "Two", "Two", "") + "]}]}"
    rows = section + '"items_V3":[{"$kind":"textPair","leadingText":"V3 #","trailingText":"€1,99"},{"$kind":"other"}]}'
    last = section + '"items":[{"textPairs":[' + pairs("Late") + "]}]}"
    bodies = [
        "", pages.START + '[{"a":1}', pages.START + '[{"data":{' + meta + ',"shelves":[' + texts + "]}}]" + pages.END,
        pages.START + '{"x":[1,{"y":' + rows + "}]}" + pages.END, pages.START + '{"title":"Other"}' + pages.END,
        pages.START + "[" + texts + "," + last + "]" + pages.END,
    ]
    filled = F.array(*[F.replace(F.lit(b), F.lit("#"), n) for b in bodies])
    body = F.get(filled, (F.col("page_id") % 6).cast("int"))
    return fx.table(spark, sf, "pages").select("page_id", F.concat("html", body).alias("html"))


PAGE_ROWS = """p AS (SELECT page_id, page_id % 6 AS k, page_id::VARCHAR AS n FROM pages),
items AS (SELECT page_id, unnest(CASE k WHEN 2 THEN ['One', 'Two'] WHEN 3 THEN ['V3 ' || n] WHEN 5 THEN {} ELSE [] END) AS name, k, n FROM p)
SELECT p.page_id, CASE p.k WHEN 0 THEN 'marker-missing' WHEN 1 THEN 'marker-unclosed' WHEN 2 THEN 'ok-textPairs' WHEN 3 THEN 'ok-itemsV3' WHEN 4 THEN 'iap-section-missing' ELSE 'ok-textPairs' END AS status,
  CASE WHEN p.k = 2 THEN 'Name ' || p.n END AS matched_name, CASE WHEN p.k = 2 THEN 'Maker ' || p.n END AS developer, CASE WHEN p.k = 2 THEN 'https://i.test/512x512.jpg' END AS icon,
  i.name, CASE WHEN p.k = 3 THEN '€1,99' WHEN i.name IS NOT NULL THEN '$' || p.n || '.99' END AS price FROM p LEFT JOIN items i USING (page_id)"""


def page_rows(extracted: DataFrame) -> DataFrame:
    header = ["page_id", "status", "matched_name", "developer", "icon"]
    return extracted.select(*header, F.explode_outer("items").alias("i")).select(*header, "i.name", "i.price")


@query(
    "extract_embedded_json",
    "O05",
    f"SELECT page_id, status, name, price FROM (WITH {PAGE_ROWS.format("['Late']")})",
)
def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form: the walk ends at the first purchase section, without metadata."""
    found = pages.extract_embedded_json(store_pages(spark, sf))
    return page_rows(found).select("page_id", "status", "name", "price")


@query("extract_embedded_json_last", "O05", f"WITH {PAGE_ROWS.format("['One', 'Two']")}")
def _embedded_last(spark: SparkSession, sf: str) -> DataFrame:
    """The form of the request API: the last section visited counts."""
    return page_rows(pages.extract_embedded_json(store_pages(spark, sf), first_wins=False))


# Catalog payloads, one per line item.


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    key, line = F.col("l_partkey"), F.col("l_linenumber")
    none = F.lit(None).cast("string")
    price = F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"), F.lit(".99"))

    def offer(kind: Column, text: Column, period: Column) -> Column:
        return F.struct(kind.alias("type"), text.alias("priceFormatted"), period.alias("recurringSubscriptionPeriod"))

    def product(number: Column, name: Column, offers: Column, offer_name: Column) -> Column:
        attributes = F.struct(
            name.alias("name"), offer_name.alias("offerName"), F.lit("fam").alias("subscriptionFamilyId"),
            F.lit(True).alias("isSubscription"), offers.alias("offers"),
        )
        return F.struct(number.alias("id"), attributes.alias("attributes"))

    own = (key + 600000).cast("string")
    both = F.array(offer(F.lit("rent"), F.lit("$0.99"), none), offer(F.lit("buy"), price, F.lit("P1M")))
    only = F.array(offer(F.lit("rent"), F.lit("$0.50"), none))
    products = F.array(
        product(own, F.lit(" Pro "), both, F.lit("com.pro")),
        product(own, F.lit("Again"), both, none),
        product(F.lit("777777"), F.lit("Basic"), only, F.lit(" ")),
        product(F.lit("888888"), F.lit(" "), only, none),
        product(none, F.lit("No id"), only, none),
    )
    shown = F.when(line == 3, F.slice(products, 4, 2)).otherwise(products)
    view = F.when(line != 2, F.struct(F.struct(shown.alias("data")).alias("top-in-app-purchasables")))
    app = F.struct(
        F.when(line == 1, F.lit("other")).otherwise(key.cast("string")).alias("id"),
        F.struct(F.lit(" App ").alias("name"), none.alias("artistName"), F.lit("u").alias("url")).alias("attributes"),
        view.alias("views"),
    )
    return fx.facts(spark, sf).select(
        "l_orderkey", "l_linenumber", key.cast("string").alias("app_id"), F.to_json(F.struct(F.array(app).alias("data"))).alias("payload")
    )


@query(
    "extract_structured_catalog",
    "O06",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS k, l_partkey, l_quantity::INTEGER AS q FROM lineitem),
    i AS (SELECT *, 0::BIGINT AS pos, 'Pro' AS name, '$' || q || '.99' AS price, (600000 + l_partkey)::VARCHAR AS product_id, 'com.pro' AS offer_name, 'P1M' AS billing_period FROM l WHERE k > 3
      UNION ALL SELECT *, 2, 'Basic', '$0.50', '777777', NULL, NULL FROM l WHERE k > 3),
    a AS (SELECT l_orderkey, k, l_partkey, q, CASE k WHEN 1 THEN 'catalog-app-missing' WHEN 2 THEN 'catalog-iap-view-missing' WHEN 3 THEN 'catalog-iap-empty' ELSE 'ok-structured' END AS status FROM l)
    SELECT l_orderkey, status, CASE WHEN k <> 1 THEN 'App' END AS matched_name, NULL::BIGINT AS pos, NULL AS name, NULL AS price, NULL AS product_id, NULL AS offer_name, NULL AS billing_period, count(*) AS rows FROM a WHERE k <= 3 GROUP BY ALL
    UNION ALL SELECT l_orderkey, 'ok-structured', 'App', pos, name, price, product_id, offer_name, billing_period, count(*) FROM i GROUP BY ALL""",
)
def _structured(spark: SparkSession, sf: str) -> DataFrame:
    read = pages.read_structured_catalog(payloads(spark, sf), "payload", "app_id")
    header = ["l_orderkey", "status", "matched_name"]
    fields = ["pos", "name", "price", "product_id", "offer_name", "billing_period"]
    # One pass: a payload without products is a row with its status alone.
    rows = pages.structured_items(read, ["l_orderkey", "matched_name"], outer=True).select(*header, *fields)
    return rows.groupBy(*header, *fields).agg(n_rows())


@query(
    "extract_search_results",
    "O07",
    """WITH p AS (SELECT *, (100000 + p_partkey)::VARCHAR AS id FROM part)
    SELECT p_partkey, 'us' AS source_region, 0::BIGINT AS pos, id AS app_id, p_name AS app_name, p_brand AS developer, 'https://i.test/512.jpg' AS icon, 'https://apps.apple.com/us/app/id' || id AS store_url FROM p
    UNION ALL SELECT p_partkey, 'us', 1, '9' || id, 'Deep', '', NULL, 'https://apps.apple.com/us/app/id9' || id FROM p""",
)
def _hits(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("p_partkey") + 100000).cast("string")
    none = F.lit(None).cast("string")

    def lockup(number: Column, title: Column, maker: Column, icon: Column) -> Column:
        return F.struct(
            number.alias("adamId"), title.alias("title"), maker.alias("subtitle"),
            F.struct(icon.alias("template")).alias("icon"),
        )

    first = lockup(n, F.concat(F.lit(" "), "p_name"), F.col("p_brand"), F.lit("https://i.test/{w}.{f}"))
    deep = lockup(F.concat(F.lit("9"), n), F.lit("Deep"), none, none)
    again = lockup(n, F.lit("Again"), none, none)
    bundle = lockup(F.concat(F.lit("8"), n), F.lit("Bundle"), none, none)
    short = lockup(F.lit("123"), F.lit("Short"), none, none)

    def result(kind: str, item: Column, inner: Column | None = None) -> Column:
        rows = F.array() if inner is None else inner
        return F.struct(F.lit(kind).alias("resultType"), item.alias("lockup"), rows.alias("more"))

    nested = F.struct(F.struct(F.struct(deep.alias("lockup")).alias("inside")).alias("outside"))
    tree = F.struct(
        nested.alias("later"),
        F.array(result("content", first), result("bundle", bundle), result("content", again), result("content", short)).alias("results"),
    )
    html = F.concat(F.lit("<html>" + pages.START), F.to_json(tree), F.lit(pages.END + "</html>"))
    found = fx.table(spark, sf, "part").select("p_partkey", html.alias("html"))
    return pages.extract_search_results(found, ["p_partkey"], F.lit("us"))


@query(
    "classify_page_outcome",
    "O08",
    """WITH f AS (SELECT l_orderkey, l_linenumber AS n, l_partkey % 9 AS k, l_partkey::VARCHAR AS app, l_suppkey % 7 AS plans,
        CASE l_suppkey % 4 WHEN 0 THEN 'icloud-plus' WHEN 1 THEN 'apple-one' WHEN 2 THEN 'apple-music' ELSE 'apple-arcade' END AS service FROM lineitem)
    SELECT l_orderkey, service, plans, k, CASE WHEN k = 0 THEN 'error:timeout' WHEN k = 1 OR k = 2 THEN 'error:HTTP 404' ELSE 'ok-textPairs' END AS store_status,
      CASE WHEN k = 0 THEN 'error:timeout' WHEN k IN (1, 2, 3) THEN 'official-price-page-missing'
        WHEN plans >= CASE service WHEN 'icloud-plus' THEN 5 WHEN 'apple-arcade' THEN 1 ELSE 2 END THEN 'ok-' || service || '-page' ELSE 'error:' || service || '-plans-missing' END AS service_status,
      count(*) AS rows FROM f GROUP BY ALL""",
)
def _outcome(spark: SparkSession, sf: str) -> DataFrame:
    k, app = F.col("l_partkey") % 9, F.col("l_partkey").cast("string")
    names = F.array(*[F.lit(s) for s in ("icloud-plus", "apple-one", "apple-music", "apple-arcade")])
    service = F.get(names, (F.col("l_suppkey") % 4).cast("int"))
    asked = F.concat(F.lit("https://x.test/page/id"), app)
    final = F.when(k == 2, F.lit("https://x.test/")).otherwise(F.concat(asked, F.lit("/?l=en")))
    html = F.when(k == 3, "<TITLE> Apple - Redirect </title>").otherwise("<title>Prices</title>")
    code, error = F.when(k == 1, 404).otherwise(200), F.when(k == 0, "timeout")
    plans = F.col("l_suppkey") % 7
    return (
        fx.table(spark, sf, "lineitem")
        .select(
            "l_orderkey", service.alias("service"), plans.alias("plans"), k.alias("k"),
            status.store_page_status(code, final, app, F.lit("ok-textPairs"), error).alias("store_status"),
            status.service_page_status(service, code, asked, final, html, plans, error).alias("service_status"),
        )
        .groupBy("l_orderkey", "service", "plans", "k", "store_status", "service_status")
        .agg(n_rows())
    )


@query(
    "prefer_structured",
    "O09",
    f"""WITH {OBS}, s AS (SELECT app_id, region, CASE WHEN status = 'ok-structured' THEN status WHEN ord % 2 = 0 THEN 'catalog-iap-empty' ELSE 'error:HTTP 429' END AS status, item_count FROM cell WHERE snap = 'after'),
      w AS (SELECT app_id, region, status, item_count FROM cell WHERE snap = 'before'),
      j AS (SELECT coalesce(s.app_id, w.app_id) AS app_id, coalesce(s.region, w.region) AS region, s.status AS ss, s.item_count AS sc, w.status AS ws, w.item_count AS wc FROM s FULL JOIN w ON s.app_id = w.app_id AND s.region = w.region),
      f AS (SELECT *, region = (SELECT 'm' || lpad(max(s_nationkey)::VARCHAR, 2, '0') FROM supplier) AND coalesce(ws IN ('iap-section-missing', 'error:HTTP 404'), FALSE) AS final, coalesce(ss = 'ok-structured', FALSE) AS good FROM j)
    SELECT app_id, region, CASE WHEN good AND NOT final THEN 'structured' ELSE 'web' END AS source, CASE WHEN good AND NOT final THEN ss ELSE ws END AS status,
      coalesce(CASE WHEN good AND NOT final THEN sc ELSE wc END, 0) AS item_count,
      CASE WHEN NOT (good AND NOT final) AND NOT final AND coalesce(ws, '') <> 'error:HTTP 404' THEN ss END AS identity_status FROM f""",
)
def _prefer(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.cells(spark, sf)
    failed = F.when(F.col("ord") % 2 == 0, "catalog-iap-empty").otherwise("error:HTTP 429")
    structured = cells.filter("snap = 'after'").select(
        "app_id", "region", F.when(F.col("status") == "ok-structured", F.col("status")).otherwise(failed).alias("status"), "item_count"
    )
    web = cells.filter("snap = 'before'").select("app_id", "region", "status", "item_count")
    # the last market stands for the anchor here, as the fixture's anchor never fails
    last = fx.table(spark, sf, "supplier").agg(F.max("s_nationkey").alias("k")).select(fx.region_code(F.col("k"))).scalar()
    return pages.prefer_structured(structured, web, F.col("region") == last)


SPACE = r"[\s\p{Z}\x{000B}\x{0085}\x{FEFF}]+"
NAMED_SQL = "h"
for _name, _sign in sorted({**prices.ENTITIES, **prices.MORE_ENTITIES}.items(), key=lambda pair: pair[0] == "amp"):
    NAMED_SQL = f"regexp_replace({NAMED_SQL}, '(?i)&{_name};', '{_sign if _sign != chr(39) else chr(39) * 2}', 'g')"
STRIP_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script\b[\s\S]*?</script>', ' ', 'g'), '(?i)<style\b[\s\S]*?</style>', ' ', 'g'), '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g')"""


@query(
    "html_to_text",
    "O10",
    f"""WITH p AS (SELECT page_id, '<p>caf&#233; &#x1F600; &amp;lt;</p>' || html AS html FROM pages), s AS (SELECT page_id, replace(replace({STRIP_SQL}, '&#233;', 'é'), '&#x1F600;', '😀') AS h FROM p),
    t AS (SELECT page_id, trim(regexp_replace({NAMED_SQL}, '{SPACE}', ' ', 'g')) AS t FROM s)
    SELECT page_id, length(t)::BIGINT AS length, md5(t) AS digest FROM t""",
)
def _text(spark: SparkSession, sf: str) -> DataFrame:
    html = F.concat(F.lit("<p>caf&#233; &#x1F600; &amp;lt;</p>"), "html")
    read = fx.table(spark, sf, "pages").select("page_id", prices.html_to_text(html).alias("t"))
    return read.select("page_id", F.length("t").cast("bigint").alias("length"), F.md5("t").alias("digest"))


# Price texts: a page sentence per line item, with two prices of its market.


def page_price(currency: Column, amount: Column) -> Column:
    """A price as an official page of the market writes it."""
    text = amount.cast("string")
    forms = {
        "CNY": ("RMB ", ".99", ""), "HKD": ("HK$", ".99", ""), "TWD": ("NT$", "", ""), "VND": ("", ".000", "đ"), "JPY": ("", ",000", "円"),
        "GBP": ("£", ".99", ""), "EUR": ("", ",99", " €"), "TRY": ("₺", ",99", ""), "INR": ("Rs.", ".99", ""),
        "BRL": ("R$ ", ",99", ""), "IDR": ("Rp ", ".000", ""), "AED": ("AED ", ".99", ""), "SAR": ("", ".99", "﷼"),
    }
    result = F.concat(F.lit("$"), text, F.lit(".99"))
    for code, (before, middle, behind) in forms.items():
        result = F.when(currency == code, F.concat(F.lit(before), text, F.lit(middle + behind))).otherwise(result)
    return result


FORMS_SQL = """CASE currency WHEN 'CNY' THEN {{'b': 'RMB ', 'm': '.99', 'e': '', 'p': 'RMB '}} WHEN 'HKD' THEN {{'b': 'HK$', 'm': '.99', 'e': '', 'p': 'HK$'}}
  WHEN 'TWD' THEN {{'b': 'NT$', 'm': '', 'e': '', 'p': 'NT$'}} WHEN 'VND' THEN {{'b': '', 'm': '.000', 'e': 'đ', 'p': '₫'}} WHEN 'JPY' THEN {{'b': '', 'm': ',000', 'e': '円', 'p': '¥'}}
  WHEN 'GBP' THEN {{'b': '£', 'm': '.99', 'e': '', 'p': '£'}} WHEN 'EUR' THEN {{'b': '', 'm': ',99', 'e': ' €', 'p': '€'}} WHEN 'TRY' THEN {{'b': '₺', 'm': ',99', 'e': '', 'p': '₺'}}
  WHEN 'INR' THEN {{'b': 'Rs.', 'm': '.99', 'e': '', 'p': '₹'}} WHEN 'BRL' THEN {{'b': 'R$ ', 'm': ',99', 'e': '', 'p': 'R$'}} WHEN 'IDR' THEN {{'b': 'Rp ', 'm': '.000', 'e': '', 'p': 'Rp'}}
  WHEN 'AED' THEN {{'b': 'AED ', 'm': '.99', 'e': '', 'p': 'AED '}} WHEN 'SAR' THEN {{'b': '', 'm': '.99', 'e': '﷼', 'p': 'SAR '}} ELSE {{'b': '$', 'm': '.99', 'e': '', 'p': '$'}} END""".replace("{{", "{").replace("}}", "}")

# One row per line item: place, the amount texts a1 and a2, the price texts as
# written (w1, w2) and in canonical form (c1, c2).
SENTENCES = f"""s0 AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice, s_nationkey % 18 AS ord, l_quantity::INTEGER AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
s1 AS (SELECT s0.*, st.region, st.currency, st.country, {FORMS_SQL.replace('currency WHEN', 'st.currency WHEN')} AS f FROM s0 JOIN store st USING (ord)),
s AS (SELECT *, q || f.m AS a1, (q + 60) || f.m AS a2, f.b || q || f.m || f.e AS w1, f.b || (q + 60) || f.m || f.e AS w2, f.p || q || f.m AS c1, f.p || (q + 60) || f.m AS c2,
    length(f.b || q || f.m || f.e) AS n1, length(f.b || (q + 60) || f.m || f.e) AS n2 FROM s1)"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    line, supplier = fx.facts(spark, sf), fx.table(spark, sf, "supplier")
    amount = F.col("l_quantity").cast("int")
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .withColumn("ord", (F.col("s_nationkey") % 18).cast("bigint"))
        .join(snapshot.storefronts(spark), "ord")
        .select(
            "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey",
            "l_extendedprice", "region", "currency", "country", page_price(F.col("currency"), amount).alias("w1"),
            page_price(F.col("currency"), amount + 60).alias("w2"),
        )
    )


# A line item is told apart by these columns at every scale.
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEYS_SQL = ", ".join(KEYS)


@query(
    "extract_price_mentions",
    "O11",
    f"""WITH {STORE}, {SENTENCES},
    m AS (SELECT {KEYS_SQL}, 0::BIGINT AS seq, 6 AS start_at, 6 + n1 AS end_at, a1 AS amount, c1 AS price FROM s
      UNION ALL SELECT {KEYS_SQL}, 1, 6 + n1 + 17, 6 + n1 + 17 + n2, a2, c2 FROM s)
    SELECT {KEYS_SQL}, seq, start_at::BIGINT AS start_at, end_at::BIGINT AS end_at, amount, price, count(*) AS rows FROM m GROUP BY ALL""",
)
def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Costs "), "w1", F.lit(" a month, or for "), "w2", F.lit(", today."))
    found = prices.extract_price_mentions(sentences(spark, sf).withColumn("text", text), KEYS)
    return found.groupBy(*found.columns).agg(n_rows())


@query(
    "assign_cadence",
    "O12",
    f"""WITH {STORE}, {SENTENCES}, c AS (SELECT {KEYS_SQL}, 'Apple Arcade Monthly' AS name, 0::BIGINT AS pos, CASE WHEN l_partkey % 3 = 2 THEN c2 ELSE c1 END AS price FROM s
      UNION ALL SELECT {KEYS_SQL}, 'Apple Arcade Annual', 1, CASE WHEN l_partkey % 3 = 2 THEN c1 ELSE c2 END FROM s WHERE l_partkey % 3 <> 1)
    SELECT *, count(*) AS rows FROM c GROUP BY ALL""",
)
def _cadence(spark: SparkSession, sf: str) -> DataFrame:
    """Three sentences: both cadences, a far keyword, and the annual price first."""
    kind = F.col("l_partkey") % 3
    filler = "x" * 55
    text = (
        F.when(kind == 0, F.concat(F.lit("Arcade is "), "w1", F.lit(" per month or "), "w2", F.lit(" per year.")))
        .when(kind == 1, F.concat(F.lit("Arcade is "), "w1", F.lit(f" {filler} month.")))
        .otherwise(F.concat(F.lit("Pay "), "w1", F.lit(" per year; else it costs "), "w2", F.lit(" monthly.")))
    )
    read = sentences(spark, sf).withColumn("text", text).withColumn("service", F.lit("apple-arcade"))
    found = prices.service_prices(read, KEYS)
    return found.groupBy(*found.columns).agg(n_rows())


def card(plan: str, *headline: Column | str) -> Column:
    texts = [F.lit(h) if isinstance(h, str) else h for h in headline]
    return F.concat(
        F.lit(f'<li class="tile gallery-item" id="{plan}"><p class="tile-headline">'), *texts, F.lit("</p></li>")
    )


@query(
    "extract_plan_cards",
    "O13",
    f"""WITH {STORE}, {SENTENCES}, c AS (SELECT {KEYS_SQL}, 'individual' AS plan, 'Apple Music Individual' AS name, c2 AS price FROM s
      UNION ALL SELECT {KEYS_SQL}, 'family', 'Apple Music Family', c2 FROM s UNION ALL SELECT {KEYS_SQL}, 'student', 'Apple Music Student', c1 FROM s WHERE l_partkey % 2 = 0)
    SELECT *, count(*) AS rows FROM c GROUP BY ALL""",
)
def _cards(spark: SparkSession, sf: str) -> DataFrame:
    """A campaign in the same card, a campaign card beside the real one, an only card."""
    w1, w2 = F.col("w1"), F.col("w2")
    student = card("student", "first month free, then ", w1)
    html = F.concat(
        F.lit('<html><li class="other">'), card("individual", "three for ", w1, " and later ", w2),
        card("family", "trial at ", w1), card("family", "always ", w2),
        F.when(F.col("l_partkey") % 2 == 0, student).otherwise(F.concat(student, student)),
    )
    found = prices.extract_plan_cards(sentences(spark, sf).withColumn("html", html), KEYS)
    return found.groupBy(*found.columns).agg(n_rows())


@query(
    "extract_bundle_cards",
    "O13",
    f"""WITH {STORE}, {SENTENCES}, c AS (SELECT {KEYS_SQL}, 'individual' AS plan, 'Apple One Individual' AS name, c1 AS price FROM s
      UNION ALL SELECT {KEYS_SQL}, 'premier', 'Apple One Premier', c2 FROM s) SELECT *, count(*) AS rows FROM c GROUP BY ALL""",
)
def _bundles(spark: SparkSession, sf: str) -> DataFrame:
    html = F.concat(
        F.lit('<p class="head plan-individual">'), "w1", F.lit("<b>/mo.</b></p><p>Music "), "w2",
        F.lit('</p><p class="plan-family">soon</p><p class="x plan-premier y">'), "w2", F.lit(", was "), "w1", F.lit("</p>"),
    )
    found = prices.extract_bundle_cards(sentences(spark, sf).withColumn("html", html), KEYS)
    return found.groupBy(*found.columns).agg(n_rows())


@query(
    "extract_tier_section",
    "O14",
    f"""WITH {STORE}, {SENTENCES}, c AS (SELECT {KEYS_SQL}, t.pos::BIGINT AS pos, 'iCloud+ ' || t.name AS name, CASE WHEN t.pos % 2 = 0 THEN c1 ELSE c2 END AS price
      FROM s CROSS JOIN (VALUES (0, '50 GB'), (1, '200 GB'), (2, '2 TB'), (3, '6 TB'), (4, '12 TB')) t(pos, name) WHERE l_partkey % 4 <> 3)
    SELECT *, count(*) AS rows FROM c GROUP BY ALL""",
)
def _tiers(spark: SparkSession, sf: str) -> DataFrame:
    """A first section without prices; every fourth page misses a tier."""
    parts = [F.lit("See "), F.col("country"), F.lit(": 50 GB soon. " + "y" * 800 + " "), F.col("country")]
    for i, tier in enumerate(prices.STORAGE_TIERS):
        price = F.col("w1") if i % 2 == 0 else F.col("w2")
        if i == 3:
            price = F.when(F.col("l_partkey") % 4 == 3, F.lit("none")).otherwise(price)
        parts += [F.lit(f" {tier}: "), price]
    found = prices.extract_tier_section(sentences(spark, sf).withColumn("text", F.concat(*parts)), KEYS)
    return found.groupBy(*found.columns).agg(n_rows())


@query(
    "fallback_below_anchor",
    "O15",
    f"""WITH {STORE}, {SENTENCES} SELECT {KEYS_SQL}, c1 AS price, count(*) AS rows FROM s GROUP BY ALL""",
)
def _below(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("from "), "w1", F.lit(" up to "), "w2", F.lit(" and "), "w1")
    anchor = prices.price_mentions(F.col("w2"), F.col("currency"))
    read = sentences(spark, sf).withColumn("text", text).withColumn("anchor_amount", F.get(anchor, F.lit(0))["amount"])
    found = prices.fallback_below_anchor(read, KEYS)
    return found.groupBy(*found.columns).agg(n_rows())


@query(
    "page_prices",
    "O15",
    f"""WITH {STORE}, {SENTENCES}, p AS (SELECT *, l_partkey % 7 AS kind FROM s),
    c AS (SELECT {KEYS_SQL}, n.label || ' Monthly' AS name, c1 AS price FROM p JOIN (VALUES (0, 'Apple Arcade'), (1, 'Apple Fitness+'), (2, 'Apple TV+'), (3, 'Apple News+')) n(kind, label) USING (kind)
      UNION ALL SELECT {KEYS_SQL}, CASE kind WHEN 0 THEN 'Apple Arcade Annual' ELSE 'Apple Fitness+ Annual' END, c2 FROM p WHERE kind < 2
      UNION ALL SELECT {KEYS_SQL}, 'Apple One Family', c2 FROM p WHERE kind = 4
      UNION ALL SELECT {KEYS_SQL}, 'iCloud+ ' || t.name, c1 FROM p CROSS JOIN (VALUES ('50 GB'), ('200 GB'), ('2 TB'), ('6 TB'), ('12 TB')) t(name) WHERE kind = 5
      UNION ALL SELECT {KEYS_SQL}, 'Apple Music Individual', c2 FROM p WHERE kind = 6
      UNION ALL SELECT {KEYS_SQL}, 'Apple Music Student', c1 FROM p WHERE kind = 6 AND (region = 'cn' OR l_linenumber = 1))
    SELECT *, count(*) AS rows FROM c GROUP BY ALL""",
)
def _page_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of all services; music pages without a student card name its price in the text."""
    kind, w1, w2 = F.col("l_partkey") % 7, F.col("w1"), F.col("w2")
    names = [*prices.SERVICE_LABELS, "apple-one", "icloud-plus", "apple-music"]
    tiers = [part for tier in prices.STORAGE_TIERS for part in (F.lit(f" {tier}: "), w1)]
    student = F.when(F.col("l_linenumber") == 1, card("student", w1)).otherwise(F.lit(""))
    html = (
        F.when(kind < 4, F.concat(F.lit("<p>It is "), w1, F.lit(" per month or "), w2, F.lit(" per year.</p>")))
        .when(kind == 4, F.concat(F.lit('<p class="plan-family">'), w2, F.lit("</p>")))
        .when(kind == 5, F.concat(F.lit("<p>"), F.col("country"), *tiers, F.lit("</p>")))
        .otherwise(F.concat(card("individual", w2), student, F.lit("<p>For students "), w1, F.lit(" each month.</p>")))
    )
    service = F.element_at(F.array(*[F.lit(n) for n in names]), (kind + 1).cast("int"))
    found = prices.page_prices(sentences(spark, sf).withColumns({"html": html, "service": service}), KEYS)
    return found.groupBy(*found.columns).agg(n_rows())
