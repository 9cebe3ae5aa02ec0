from pyspark.sql import functions as F

from marketladder.operators import items, matching, plans

ITEM = "app_id string, region string, ord bigint, pos bigint, name string, price string, product_id string, offer_name string, billing_period string, family_id string"
CURATED = "app_id string, plan_id string, label string, period string, aliases array<string>, occurrence bigint, curated_ord bigint"
RATES = [("USD", 0.14), ("PHP", 8.0)]
MARKETS = [("us", 0, "USD"), ("ph", 1, "PHP")]


def us():
    return F.col("region") == "us"


def numbered(spark, *cells):
    """cells: (region, [(name, price, product, period, offer, family), ...])."""
    out = []
    for region, rows in cells:
        for pos, row in enumerate(rows):
            name, price, product, period, offer, family = (*row, None, None, None, None)[:6]
            out.append(("1", region, 0 if region == "us" else 1, pos, name, price, product, offer, period, family))
    return items.occurrence_number(spark.createDataFrame(out, ITEM))


def curated(spark, *rows):
    return spark.createDataFrame([("1", *r, i) for i, r in enumerate(rows)], CURATED)


def find(spark, found, *rows):
    return plans.discover_plans(found, curated(spark, *rows), us())


def test_every_item_gets_a_plan(spark):
    found = numbered(spark, ("us", [(f"Public Item {i}", f"${i}.99") for i in range(12)]))
    result = find(spark, found)
    assert result.count() == 12
    assert plans.uncovered_items(found, result).count() == 0


def test_new_products_appear_and_stale_plans_do_not(spark):
    found = numbered(spark, ("us", [("Known Plan", "$9.99"), ("Brand New Plan", "$19.99")]))
    result = find(spark, found, ("known", "Known", "月付", ["Known Plan"], 0), ("stale", "Stale", "月付", ["Stale Plan"], 0))
    assert {(r.label, r.discovered) for r in result.collect()} == {("Known", False), ("Brand New Plan", True)}


def test_groups(spark):
    rows = [("Premium Monthly", "$9.99"), ("Premium Annual", "$99.99"), ("1,000 Credits", "$4.99"), ("Sticker Pack", "$1.99")]
    result = find(spark, numbered(spark, ("us", rows)))
    assert {r.label: r.display_group for r in result.collect()} == {
        "Premium Monthly": "primary", "Premium Annual": "primary", "1,000 Credits": "other", "Sticker Pack": "other"
    }


def test_repeated_names_are_numbered(spark):
    result = find(spark, numbered(spark, ("us", [("SVIP", "$19.99"), ("SVIP", "$199.99"), ("SVIP", "$299.99")])))
    assert [r.label for r in result.orderBy("occurrence").collect()] == ["SVIP #1", "SVIP #2", "SVIP #3"]


def test_price_ratio_tells_the_year_only_for_curated_names(spark):
    found = numbered(spark, ("us", [("Plus", "$10.00"), ("Plus", "$100.00"), ("Other", "$1.00"), ("Other", "$10.00")]))
    result = find(spark, found, ("third", "Plus", "公开项目", ["Plus"], 2))
    periods = {(r.aliases[0], r.occurrence): r.period for r in result.collect()}
    assert periods == {("Plus", 0): "月付", ("Plus", 1): "年付", ("Other", 0): "公开项目", ("Other", 1): "公开项目"}


def strict(spark, found, listed, statuses):
    result = plans.discover_plans(found.filter(us()), listed, us())
    asked = plans.enrich_strict(result.select("app_id", "plan_id", "label", "aliases", "occurrence", "product_id", "billing_period", "display_group"), found.filter(us()))
    cells = found.groupBy("app_id", "region").agg(F.count(F.lit(1)).alias("item_count")).join(
        spark.createDataFrame(statuses, "region string, status string"), "region"
    )
    matches = matching.strict_match(asked, cells, found, F.lit("us"), us())
    priced = matching.price_fx(
        matches, spark.createDataFrame(MARKETS, "region string, ord bigint, currency string"),
        spark.createDataFrame(RATES, "currency string, units double"),
    )
    return asked, priced


BOTH_TEXT = [("us", "ok-textPairs"), ("ph", "ok-textPairs")]
BOTH_STRUCTURED = [("us", "ok-structured"), ("ph", "ok-structured")]
PLUS = [("monthly", "Example Plus", "月付", ["Example Plus"], 0), ("annual", "Example Plus", "年付", ["Example Plus"], 1)]


def test_duplicates_without_identity_are_never_paired(spark):
    found = numbered(
        spark, ("us", [("Example Plus", "$10.00"), ("Example Plus", "$100.00")]),
        ("ph", [("Example Plus", "₱4,000.00"), ("Example Plus", "₱400.00")]),
    )
    asked, priced = strict(spark, found, curated(spark, *PLUS), BOTH_TEXT)
    rolled = {r.plan_id: r for r in matching.plan_rollup(asked, priced).collect()}
    assert {k: (r.match_method, [p.region for p in r.prices], r.excluded, r.period) for k, r in rolled.items()} == {
        "monthly": ("us-anchor-only", ["us"], 1, "公开项目"), "annual": ("us-anchor-only", ["us"], 1, "公开项目")
    }
    assert rolled["annual"].prices[0].price == "$100.00"
    review = matching.match_review(priced).first()
    assert (review.excluded_matches, review.affected_regions, review.reasons) == (2, 1, "ambiguous-duplicate-name")


def test_product_ids_match_across_languages(spark):
    found = numbered(
        spark, ("us", [("Example Plus", "$10.00", "m", "P1M"), ("Example Plus", "$100.00", "y", "P1Y")]),
        ("ph", [("Taunang", "₱4,000.00", "y", "YEARLY"), ("Buwanang", "₱400.00", "m", "MONTHLY")]),
    )
    asked, priced = strict(spark, found, curated(spark, *PLUS), BOTH_STRUCTURED)
    rolled = {r.plan_id: r for r in matching.plan_rollup(asked, priced).collect()}
    assert (rolled["monthly"].match_method, rolled["monthly"].period, rolled["monthly"].product_id) == ("product-id", "月付", "m")
    assert [p.price for p in rolled["annual"].prices if p.region == "ph"] == ["₱4,000.00"]


def test_conflicting_metadata_is_an_issue_and_absence_is_not(spark):
    found = numbered(
        spark, ("us", [("A", "$1.00", "a", "P1M", "o1", "f1"), ("B", "$2.00", "b")]),
        ("ph", [("A", "₱1.00", "a", "P1Y", "o1", "f2")]),
    )
    asked, _ = strict(spark, found, curated(spark), BOTH_STRUCTURED)
    cells = spark.createDataFrame([("1", "us", "ok-structured", 2), ("1", "ph", "ok-structured", 1)], "app_id string, region string, status string, item_count bigint")
    got = matching.match_plan_by_product(asked, cells, found, us()).filter("region = 'ph'").collect()
    assert {r.outcome: (r.reason, r.fields) for r in got} == {
        "issue": ("product-metadata-mismatch", "billing-period,subscription-family"), "not-listed": (None, None)
    }


def test_unparseable_price_is_an_issue(spark):
    found = numbered(spark, ("us", [("A", "$1.00", "a")]), ("ph", [("A", "Rs.13.99", "a")]))
    asked, priced = strict(spark, found, curated(spark), BOTH_STRUCTURED)
    assert matching.match_review(priced).first().reasons == "price-parse-failed"
    assert matching.plan_rollup(asked, priced).first().excluded == 1


def test_spread_and_ladder(spark):
    rows = [("1", "p", "a", 0, 10.0), ("1", "p", "b", 1, 5.0), ("1", "p", "c", 2, 20.0), ("1", "p", "d", 3, None)]
    priced = spark.createDataFrame(rows, "app_id string, plan_id string, region string, ord bigint, cny double")
    r = matching.price_spread(priced).first()
    assert (r.low_region, r.high_region, r.saving_percent, r.comparable) == ("b", "c", 75, 3)
    assert [x.region for x in matching.cheapest_k(priced, 2).orderBy("rank").collect()] == ["b", "a"]


def test_markets_that_are_not_configured_are_left_out(spark):
    rows = spark.createDataFrame([("us", "$1.00"), ("zz", "$1.00"), ("ph", "₱5.00")], "region string, price string")
    markets = spark.createDataFrame(MARKETS, "region string, ord bigint, currency string")
    rates = spark.createDataFrame([("USD", 0.5)], "currency string, units double")
    got = {r.region: (r.cny, r.issue) for r in matching.price_fx(rows, markets, rates).collect()}
    assert got == {"us": (2.0, None), "ph": (None, "price-parse-failed")}


def test_a_plan_without_a_row_has_no_method(spark):
    """Names A (2 rows) and B (3 rows), number 2: A counts and has no third row."""
    found = numbered(spark, ("us", [("A", "$1"), ("A", "$2"), ("B", "$3"), ("B", "$4"), ("B", "$5")]))
    asked = spark.createDataFrame([("1", "p", ["A", "B"], 2)], "app_id string, plan_id string, aliases array<string>, occurrence bigint")
    r = matching.match_plan_by_name(asked, found, F.lit("us"), us()).first()
    assert (r.outcome, r.method, r.price) == ("absent", None, None)


def test_every_issue_is_kept(spark):
    schema = "app_id string, plan_id string, region string, outcome string, reason string, cny double"
    matches = spark.createDataFrame([("1", f"p{i:03d}", "us", "issue", "x", None) for i in range(150)] + [("1", "q", "us", "matched", None, 1.0)], schema)
    issues = matching.review_issues(matches)
    assert issues.count() == 150
    order = spark.createDataFrame([("1", f"p{i:03d}", 150 - i) for i in range(150)], "app_id string, plan_id string, seq bigint")
    markets = spark.createDataFrame(MARKETS, "region string, ord bigint, currency string")
    first = matching.first_issues(issues, order, markets).orderBy("place").collect()
    assert len(first) == 100 and [r.plan_id for r in first[:2]] == ["p149", "p148"]


def test_the_comparison_as_one_plan(spark):
    from marketladder.plans.comparison import compare

    found = numbered(
        spark, ("us", [("Plus", "$10.00", "m", "P1M"), ("Plus", "$100.00", "y", "P1Y"), ("Extra", "$3.00")]),
        ("ph", [("Buwanang", "₱400.00", "m", "MONTHLY"), ("Extra", "₱100.00"), ("Extra", "₱200.00")]), ("zz", [("Extra", "$1.00")]),
    )
    cells = spark.createDataFrame(
        [("1", "us", "ok-structured", 3), ("1", "ph", "ok-structured", 3), ("1", "zz", "ok-structured", 1), ("1", "jp", "error:HTTP 500", 0)],
        "app_id string, region string, status string, item_count bigint",
    )
    apps = spark.createDataFrame([("1", "query", None, "Dev", "icon", "url", None)], "app_id string, query string, matched_name string, developer string, icon string, store_url string, price_source string")
    markets = spark.createDataFrame([(r, o, c, n) for (r, o, c), n in zip(MARKETS, ("States", "Islands"))], "region string, ord bigint, currency string, market_name string")
    rates = spark.createDataFrame(RATES, "currency string, units double")
    times = {"generated_at": F.lit("t1"), "rates_updated_at": F.lit("t2")}
    done = compare(cells, found, apps, curated(spark), markets, rates, F.lit("us"), times)
    rolled = {(r.label, r.period): r for r in done.rollup.collect()}
    assert set(rolled) == {("Plus", "月付"), ("Plus", "年付"), ("Extra", "公开项目")}
    prices = rolled["Plus", "月付"].prices
    assert [(p.region, p.market_name, p.currency, p.price, p.local_amount, p.cny) for p in prices] == [
        ("ph", "Islands", "PHP", "₱400.00", 400.0, 50.0), ("us", "States", "USD", "$10.00", 10.0, 71.43)
    ]
    assert (rolled["Plus", "年付"].not_listed, rolled["Extra", "公开项目"].excluded) == (1, 1)
    h = done.headers.first()
    assert (h["name"], h.price_source, h.region_count, h.degraded_regions, h.generated_at, h.excluded_matches, h.error) == (
        "query", "app-store", 2, 1, "t1", 1, None
    )
