import json

import pytest
from pyspark.sql import functions as F

from marketladder.functions import text
from marketladder.sources import pages, prices, snapshot

CURRENCY = {code: currency for code, _, currency, *_ in snapshot.STOREFRONTS}
COUNTRY = {row[0]: row[5] for row in snapshot.STOREFRONTS}


def page(body):
    return f"<html>{pages.START}{json.dumps(body, ensure_ascii=False)}{pages.END}</html>"


SHELF = {"title": "In-App Purchases", "items": [{"textPairs": [["Monthly", "$9.99"], [" Yearly ", "$99.99"], ["Monthly", "$9.99"]]}]}
APP = [{"data": [{"data": {
    "title": "Example App", "developerAction": {"title": "Example Developer"},
    "lockup": {"icon": {"template": "https://example.test/icon/{w}x{h}.{f}"}}, "shelves": [SHELF],
}}]}]


def test_store_pages(spark):
    html = [page(APP), "<html>", "<html>" + pages.START + "{", page({"title": "x"}), pages.START + "{broken" + pages.END]
    df = spark.createDataFrame(list(enumerate(html)), "id int, html string")
    got = pages.extract_embedded_json(df, first_wins=False).orderBy("id").collect()
    assert [r.status for r in got] == ["ok-textPairs", "marker-missing", "marker-unclosed", "iap-section-missing", "error:invalid-json"]
    assert [tuple(i) for i in got[0]["items"]] == [("Monthly", "$9.99"), ("Yearly", "$99.99")]
    assert (got[0].matched_name, got[0].developer, got[0].icon) == ("Example App", "Example Developer", "https://example.test/icon/512x512.jpg")


def test_catalog_payload(spark):
    def item(number, price, period):
        offers = [{"type": "rent", "priceFormatted": "x"}, {"type": "buy", "priceFormatted": price, "recurringSubscriptionPeriod": period}]
        return {"id": number, "attributes": {"name": "Example Plus", "offerName": "o", "isSubscription": True, "subscriptionFamilyId": "f", "offers": offers}}

    app = {"id": "42", "attributes": {"name": "Example", "artistName": "Dev", "url": "u"}, "views": {"top-in-app-purchasables": {"data": [item("1", "$7.99", "P1M"), item("1", "$8.99", "P1M"), item("2", "$69.99", "P1Y")]}}}
    df = spark.createDataFrame([("42", json.dumps({"data": [app]})), ("43", json.dumps({"data": [app]}))], "app_id string, payload string")
    read = pages.read_structured_catalog(df, "payload", "app_id")
    assert {r.app_id: r.status for r in read.collect()} == {"42": "ok-structured", "43": "catalog-app-missing"}
    rows = pages.structured_items(read, ["app_id"]).orderBy("pos").collect()
    assert [(r.product_id, r.price, r.billing_period, r.family_id, r.is_subscription) for r in rows] == [
        ("1", "$7.99", "P1M", "f", True), ("2", "$69.99", "P1Y", "f", True)
    ]


def test_payloads_with_and_without_products_in_one_pass(spark):
    products = [{"id": " 1 ", "attributes": {"name": " A ", "offerName": " ", "offers": [{"priceFormatted": "$1 "}]}}, {"id": "2", "attributes": {"name": " "}}, {"id": "3"}]
    apps = [{"id": "1", "views": {"top-in-app-purchasables": {"data": products}}}, {"id": "2", "views": {"top-in-app-purchasables": {"data": products[1:]}}}, {"id": "3"}]
    df = spark.createDataFrame([(i, json.dumps({"data": apps})) for i in ("1", "2", "3", "4", None)], "app_id string, payload string")
    read = pages.read_structured_catalog(df, "payload", "app_id")
    rows = pages.structured_items(read, ["app_id"], outer=True)
    assert sorted((r.app_id or "", r.status, r.pos, r["name"], r.price, r.product_id, r.offer_name) for r in rows.collect()) == [
        ("", "catalog-app-missing", *[None] * 5), ("1", "ok-structured", 0, "A", "$1", "1", None), ("2", "catalog-iap-empty", *[None] * 5),
        ("3", "catalog-iap-view-missing", *[None] * 5), ("4", "catalog-app-missing", *[None] * 5),
    ]
    assert pages.structured_items(read, ["app_id"]).count() == 1


def test_snapshot_files(spark, tmp_path):
    document = {
        "generatedAt": "t0", "regions": ["us"], "apps": [
            {"id": "1", "matchedName": "A", "verifiedAt": "t1", "regions": [{"region": "us", "status": "ok-x", "itemCount": 2, "items": [{"name": "N", "price": "$1"}, {"name": "M", "price": "$2"}]}, {"region": "ph", "status": "error:HTTP 404", "itemCount": 0, "items": []}]},
            {"id": "2", "matchedName": "B", "regions": []},
        ],
    }
    (tmp_path / "s.json").write_text(json.dumps(document, indent=1))
    got = snapshot.scan_snapshot(spark, str(tmp_path / "s.json"), multi_line=True)
    assert sorted((r.app_id, r.verified_at, r.region or "", r.pos if r.pos is not None else -1, r.name or "") for r in got.collect()) == [
        ("1", "t1", "ph", -1, ""), ("1", "t1", "us", 0, "N"), ("1", "t1", "us", 1, "M"), ("2", "t0", "", -1, "")
    ]


def test_missing_rates_fail_by_name(spark):
    stores = snapshot.storefronts(spark)
    assert stores.count() == 18 and stores.select("region").distinct().count() == 18
    some = spark.createDataFrame([("USD", 1.0)], "currency string, units double")
    with pytest.raises(ValueError, match="AED, AUD"):
        snapshot.require_rates(some, stores)


def test_plan_definitions(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"7": [{"id": "a", "label": "A", "period": "月付", "aliases": ["A"]}, {"id": "b", "label": "B", "period": "年付", "aliases": ["B", "C"], "occurrence": 1}]}))
    got = snapshot.plan_definitions(spark, str(tmp_path / "p.json")).orderBy("curated_ord").collect()
    assert [(r.app_id, r.plan_id, r.aliases, r.occurrence) for r in got] == [("7", "a", ["A"], 0), ("7", "b", ["B", "C"], 1)]


def test_rate_time(spark):
    value = spark.range(1).select(snapshot.rate_time(F.lit("Sun, 06 Sep 2026 00:02:31 +0000")).cast("bigint")).first()[0]
    assert value == 1788652951


def service(spark, html, region, name):
    df = spark.createDataFrame([(html, region, name, CURRENCY[region], COUNTRY[region])], "html string, region string, service string, currency string, country string")
    df = df.withColumn("text", prices.html_to_text(F.col("html"))).withColumn("id", F.lit(1))
    if name == "icloud-plus":
        return [(r.name, r.price) for r in prices.extract_tier_section(df, ["id"]).orderBy("pos").collect()]
    if name == "apple-one":
        return [(r.name, r.price) for r in prices.extract_bundle_cards(df, ["id"]).collect()]
    return [(r.name, r.price) for r in prices.service_prices(df, ["id"]).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("html", "region", "name", "expected"),
    [
        ("Play everything in Apple Arcade for $5.49 per month. Prefer one bill? It is $55.40 per year.", "us", "apple-arcade", ["$5.49", "$55.40"]),
        ("Apple Fitness+ costs new subscribers $8.25 per month or $81.70 annually.", "us", "apple-fitness-plus", ["$8.25", "$81.70"]),
        ("Mit Apple Arcade spielst du für 7,25 € pro Monat oder für 72,40 € pro Jahr.", "de", "apple-arcade", ["€7,25", "€72,40"]),
        ("Latihan Apple Fitness+ seharga Rp 71.000 per bulan atau Rp 560.000 per tahun.", "id", "apple-fitness-plus", ["Rp71.000", "Rp560.000"]),
        ("Apple Fitness+ sai por R$ 31,40 por mês.", "br", "apple-fitness-plus", ["R$31,40"]),
        ("Entrena con Apple Fitness+ por MX$185 al mes", "mx", "apple-fitness-plus", ["$185"]),
        ("Apple Fitness+ is SAR 35.25 per month", "sa", "apple-fitness-plus", ["SAR 35.25"]),
        ('<p class="price plan-individual main">$17.25 <i>a month</i></p><p>Something else $3.10</p><p class=\'plan-family\'>$24.60</p>', "us", "apple-one", ["$17.25", "$24.60"]),
        ("<section>United Kingdom (GBP) 50 GB: &pound;0.89 200 GB: &pound;2.49 2 TB: &pound;7.99 6 TB: &pound;21.49 12 TB: &pound;49.89</section>", "gb", "icloud-plus", ["£0.89", "£2.49", "£7.99", "£21.49", "£49.89"]),
    ],
)
def test_service_pages(spark, html, region, name, expected):
    assert [price for _, price in service(spark, html, region, name)] == expected


def tile(plan, words, tail=""):
    """A card in the shape the extraction asks for: a list item, its id, a headline paragraph."""
    return f"<li id='{plan}' data-n=\"1\" class='wide gallery-item'><div><p class='big tile-headline'>{words}</p>{tail}</div></li>"


@pytest.mark.parametrize(
    ("tiles", "region", "expected"),
    [
        # of several amounts the last is the recurring one; a promotion loses to a plain price
        ([("individual", "Two months for $2.40, afterwards $10.25 a month"), ("family", "Special offer: $3.30 monthly"), ("family", "$16.80 monthly"), ("student", "Students pay $5.15 monthly")], "us", ["$10.25", "$16.80", "$5.15"]),
        # a promotion counts where it is the only card of its plan
        ([("individual", "First month free, ₹99 monthly"), ("student", "For students ₹49 monthly")], "in", ["₹99", "₹49"]),
        # a list within a headline ends it
        ([("individual", "月額950円"), ("family", "月額1,450円<ul><li>月額9円</li></ul>")], "jp", ["¥950", "¥1,450"]),
    ],
)
def test_plan_cards(spark, tiles, region, expected):
    html = "<ul><li class='other'>$1.11</li>" + "".join(tile(*t) for t in tiles) + "</ul>"
    df = spark.createDataFrame([(1, html, CURRENCY[region])], "id int, html string, currency string")
    got = {r.plan: r.price for r in prices.extract_plan_cards(df, ["id"]).collect()}
    assert [got[p] for p in ("individual", "family", "student") if p in got] == expected


@pytest.mark.parametrize(
    ("region", "tiles", "tail", "expected"),
    [
        ("cn", ["individual"], "FAQ: RMB 4.50, RMB 6.50, RMB 12.50 and RMB 19", {"individual": "RMB 12.50", "student": "RMB 6.50"}),
        ("cn", ["individual", "student"], "FAQ: RMB 4.50, RMB 6.50", {"individual": "RMB 12.50", "student": "RMB 12.50"}),
        ("cn", ["family"], "FAQ: RMB 4.50", {"family": "RMB 12.50"}),
        ("cn", ["individual"], "FAQ: RMB 19", {"individual": "RMB 12.50"}),
        ("us", ["individual"], "FAQ: $4.50", {"individual": "$12.50"}),
    ],
)
def test_student_plan_from_the_text(spark, region, tiles, tail, expected):
    amount = "RMB 12.50" if region == "cn" else "$12.50"
    html = "<ul>" + "".join(tile(t, f"{amount} monthly") for t in tiles) + f"</ul><p>{tail}</p>"
    df = spark.createDataFrame([(1, html, CURRENCY[region], region)], "id int, html string, currency string, region string")
    assert {r.plan: r.price for r in prices.plan_prices(df, ["id"]).collect()} == expected


def test_pages_are_read_by_service(spark):
    rows = [
        (1, "apple-arcade", "$5.49 per month, $55.40 per year"), (2, "apple-one", '<p class="plan-family">$24.60</p>'),
        (3, "apple-music", tile("individual", "$10.25 monthly")), (4, "other", "$1 per month"), (5, "apple-tv-plus", "no price"), (6, "apple-one", None),
        (7, "icloud-plus", "United States 50 GB: $1 200 GB: $3 2 TB: $10 6 TB: $30 12 TB: $60"),
    ]
    df = spark.createDataFrame([(*r, "us", CURRENCY["us"], "United States") for r in rows], "id int, service string, html string, region string, currency string, country string")
    got = {(r.id, r.name) for r in prices.page_prices(df, ["id"]).collect()}
    tiers = {(7, f"iCloud+ {t}") for t in prices.STORAGE_TIERS}
    assert got == {(1, "Apple Arcade Monthly"), (1, "Apple Arcade Annual"), (2, "Apple One Family"), (3, "Apple Music Individual")} | tiers


def test_long_search_pages_are_read_whole(spark):
    """More than 20,000 nodes before the last app."""
    filler = [{"n": [i]} for i in range(15_000)]
    app = {"lockup": {"adamId": "123456789", "title": " Last App ", "subtitle": "Maker"}}
    df = spark.createDataFrame([(1, page({"filler": filler, "deep": {"er": [app]}}))], "id int, html string")
    found = pages.extract_search_results(df, ["id"], F.lit("us")).collect()
    assert [(r.app_id, r.app_name, r.developer) for r in found] == [("123456789", "Last App", "Maker")]


def test_text_and_entities(spark):
    html = "<style>x</style><p>A&nbsp;&amp;lt;&#66;&#x1F600;<br/>B&unknown;&#55296;</p><script>no</script>"
    got = spark.createDataFrame([(html,)], "h string").select(prices.html_to_text(F.col("h"))).first()[0]
    assert got == "A &lt;B😀 B&unknown;&#55296;"


def test_fallback_below_the_anchor(spark):
    df = spark.createDataFrame([(1, "RMB 5 RMB 11 RMB 6.50 RMB 6.50", "CNY", "11")], "id int, text string, currency string, anchor_amount string")
    assert prices.fallback_below_anchor(df, ["id"]).first().price == "RMB 6.50"


def test_search_terms_are_cleaned(spark):
    df = spark.createDataFrame([("Pro-Max 2",)], "t string")
    assert df.select(text.search_key(F.col("t"))).first()[0] == "promax2"


def test_mentions_are_read_once_a_row_on_arrow_batches(spark):
    """Two forms of one amount, blanks, letter case, trailing signs; a missing text or an unknown currency gives none."""
    rows = [
        ("hk$\t1,5., HK$ .", "HKD"), ("¥ 9円 8 円", "JPY"), ("10.000đ ₫ 5", "VND"), ("rs.7 xRs 8 ₹9", "INR"), (None, "USD"), ("$1", None), ("$1", "XXX"),
    ]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id int, text string, currency string")
    read = df.select("id", prices.price_mentions(F.col("text"), F.col("currency")).alias("m")).collect()
    got = {r.id: [(m.start, m.form, m.end, m.price) for m in r.m] for r in read}
    assert got == {
        0: [(0, 0, 7, "HK$1,5")], 1: [(0, 0, 3, "¥9"), (2, 1, 4, "¥9"), (5, 1, 8, "¥8")], 2: [(0, 1, 7, "₫10.000"), (8, 0, 11, "₫5")],
        3: [(0, 1, 4, "₹7"), (11, 0, 13, "₹9")], 4: [], 5: [], 6: [],
    }
    pages = spark.createDataFrame([(1, '<p class="plan-family">$3 &amp; $4</p>', "USD")], "id int, html string, currency string")
    cards = prices.extract_bundle_cards(pages, ["id"])
    assert [tuple(r) for r in cards.collect()] == [(1, "family", "Apple One Family", "$3")]
    assert cards._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_pages_are_read_in_one_pass(spark):
    """No chain of interpreted array expressions: Arrow batches read a page, grouping is native."""
    columns = "id int, html string, text string, currency string, country string, region string, service string"
    df = spark.createDataFrame([(1, "", "", "USD", "Japan", "jp", "apple-tv-plus")], columns)
    reads = [prices.extract_plan_cards(df, ["id"]), prices.extract_bundle_cards(df, ["id"]), prices.extract_tier_section(df, ["id"]), prices.service_prices(df, ["id"])]
    for read in reads:
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "lambdafunction" not in plan


def test_cards_of_pages_with_equal_keys_count_as_one_page(spark):
    """An only card may be a promotion; a card with several amounts, then a plain one, wins over pages too."""
    pages_of = {
        1: [tile("student", "First month free, $5 monthly")] * 2, 2: [tile("student", "trial, $5"), tile("student", "$6")],
        3: [tile("family", "$7"), tile("family", "$8, later $9")], None: [tile("individual", "$3"), tile("individual", "$2")],
        4: [tile("family", "$1").replace("gallery-item", "gallery-items"), tile("student", "$4").replace("id=", "data-x=")],
        5: [tile("individual", "$1").upper().replace("$1", "a&#36;4&AMP;"), "<li class='gallery-item' id='student'", None],
    }
    df = spark.createDataFrame([(key, html, "USD") for key, parts in pages_of.items() for html in parts], "id int, html string, currency string")
    got = sorted((r.id or 0, r.plan, r.price) for r in prices.extract_plan_cards(df, ["id"]).collect())
    assert got == [(0, "individual", "$2"), (2, "student", "$6"), (3, "family", "$9"), (5, "individual", "$4")]


def test_cadence_of_a_page_with_many_prices(spark):
    """Letters that ignoring case finds equal, and more prices and words than pairs could be made of."""
    rows = [("$1 per year, " * 30_000 + "$2 monthly", "us"), ("$3 MENSUAL or ₺ $4 YILLIK", "tr"), ("$5 aylık, $6 yillik", "tr"), (None, "us")]
    df = spark.createDataFrame([(i, t, r, "USD", "apple-arcade") for i, (t, r) in enumerate(rows)], "id int, text string, region string, currency string, service string")
    got = {(r.id, r.pos): r.price for r in prices.service_prices(df, ["id"]).collect()}
    assert got == {(0, 0): "$2", (0, 1): "$1", (1, 0): "$3", (1, 1): "$4", (2, 0): "$5", (2, 1): "$6"}
