"""The same plan in every market, prices in one currency, ladders, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketladder.functions.amounts import parse_localized_amount, round_cny, to_base_currency
from marketladder.functions.plans import PRIMARY_PERIODS, canonical_period
from marketladder.functions.status import is_degraded_region, is_public
from marketladder.operators.items import dedupe_by_product
from marketladder.operators.plans import alias_group, items_by_alias, plan_aliases

PLAN = ("app_id", "plan_id")


def price_fx(rows: DataFrame, markets: DataFrame, rates: DataFrame) -> DataFrame:
    """Add currency, local_amount, cny and an issue for what cannot be priced.

    Rows of markets that are not configured are left out; a market without a
    rate is an issue.  Both dimensions are small (one row per market, one per currency); Spark
    broadcasts them by their statistics, and shuffles if they ever outgrow it.
    """
    priced = (
        rows.join(markets.select("region", "currency", *[c for c in markets.columns if c == "market_name"]), "region")
        .join(rates, "currency", "left")
        .withColumn("local_amount", parse_localized_amount(F.col("price"), F.col("currency")))
        .withColumn("cny", to_base_currency(F.col("local_amount"), F.col("units")))
    )
    return priced.withColumn("issue", F.when(F.col("cny").isNull(), "price-parse-failed")).drop("units")


def match_plan_display(plans: DataFrame, items: DataFrame, pos_range: Column | None = None) -> DataFrame:
    """Display matcher: by product id unless metadata differs, else by number."""
    first = dedupe_by_product(items).select(
        "app_id", "region", "product_id", "name", "price", "pos",
        *[F.col(c).alias(f"i_{c}") for c in ("offer_name", "billing_period", "family_id")],
    )
    conflict = F.lit(False)
    for column in ("offer_name", "billing_period", "family_id"):
        conflict = conflict | F.coalesce(F.col(column) != F.col(f"i_{column}"), F.lit(False))
    by_product = (
        plans.filter(F.col("product_id").isNotNull())
        .join(first, ["app_id", "product_id"])
        .filter(~conflict)
        .select("app_id", "plan_id", "region", "name", "price")
    )
    named = plans.filter(F.col("product_id").isNull())
    numbered = items_by_alias(items, named, pos_range).select(
        "app_id", "alias_group", F.col("alias_number").alias("occurrence"), "region", "name", "price"
    )
    by_number = (
        named.withColumn("alias_group", alias_group(F.col("aliases")))
        .select("app_id", "plan_id", "alias_group", "occurrence")
        .join(numbered, ["app_id", "alias_group", "occurrence"])
        .select("app_id", "plan_id", "region", "name", "price")
    )
    return by_product.unionByName(by_number)


def public_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(is_public(F.col("status"), F.col("item_count")))


def match_plan_by_product(plans: DataFrame, cells: DataFrame, items: DataFrame, anchor: Column) -> DataFrame:
    """Strict matcher for plans with a product id: one row per plan and market.

    outcome: ``matched``, ``not-listed`` (structured market without it) or
    ``issue`` with a reason and the differing metadata fields.
    """
    rows = dedupe_by_product(items).select(
        "app_id", "region", "product_id", "price",
        F.col("offer_name").alias("i_offer"),
        canonical_period(F.col("billing_period")).alias("i_period"),
        F.col("family_id").alias("i_family"),
    )
    anchors = rows.filter(anchor).select(
        "app_id", "product_id", F.col("i_offer").alias("a_offer"), F.col("i_period").alias("a_period"),
        F.col("i_family").alias("a_family"),
    )
    # one row per app with its markets, a bounded list; exploded, a plan's rows are keyed by market
    listed = public_cells(cells).groupBy("app_id").agg(F.collect_list(F.struct("region", "status")).alias("c"))
    grid = (
        plans.filter(F.col("product_id").isNotNull())
        .select("app_id", "plan_id", "product_id")
        .join(listed, "app_id")
        .select("app_id", "plan_id", "product_id", F.inline("c"))
    )
    joined = grid.join(rows, ["app_id", "region", "product_id"], "left").join(
        anchors, ["app_id", "product_id"], "left"
    )
    # Names of the compared fields.
    pairs = {"offer-name": "offer", "billing-period": "period", "subscription-family": "family"}
    fields = F.array_compact(
        F.array(*[F.when(F.col(f"a_{c}") != F.col(f"i_{c}"), F.lit(name)) for name, c in pairs.items()])
    )
    listed = F.col("price").isNotNull()
    structured = F.col("status") == "ok-structured"
    clash = listed & (F.size(fields) > 0)
    return joined.select(
        "app_id", "plan_id", "region",
        F.when(listed & ~clash, F.col("price")).alias("price"),
        F.when(clash, "issue").when(listed, "matched").when(structured, "not-listed").otherwise("issue")
        .alias("outcome"),
        F.when(listed & ~clash, "product-id").alias("method"),
        F.when(clash, "product-metadata-mismatch").when(~listed & ~structured, "product-id-not-listed")
        .alias("reason"),
        F.when(clash, F.array_join(fields, ",")).alias("fields"),
    )


def match_plan_by_name_period(plans: DataFrame, items: DataFrame) -> DataFrame:
    """Strict matcher for a structured period: name and period, unique or an issue."""
    counted = (
        items.withColumn("match_period", canonical_period(F.col("billing_period")))
        .filter(F.col("match_period").isNotNull())
        .groupBy("app_id", "region", F.col("name").alias("alias"), "match_period")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("price").alias("price"))
    )
    names = plan_aliases(plans).join(plans.select(*PLAN, "match_period"), [*PLAN])
    best = (
        names.join(counted, ["app_id", "alias", "match_period"])
        .groupBy(*PLAN, "region")
        .agg(F.min(F.struct("alias_pos", "rows", "price")).alias("best"))
    )
    single = F.col("best.rows") == 1
    return best.select(
        *PLAN, "region",
        F.when(single, F.col("best.price")).alias("price"),
        F.when(single, "matched").otherwise("issue").alias("outcome"),
        F.when(single, "exact-name-period").alias("method"),
        F.when(~single, "duplicate-name-period").alias("reason"),
    )


def match_plan_by_name(plans: DataFrame, numbered: DataFrame, anchor: Column, anchor_rows: Column) -> DataFrame:
    """Strict matcher by name only; duplicates are never paired across markets.

    ``anchor`` is the code of the anchor market, ``anchor_rows`` the condition
    selecting its items.
    """
    counted = numbered.groupBy("app_id", "region", F.col("name").alias("alias")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("price").alias("price")
    )
    anchored = counted.filter(anchor_rows).select("app_id", "alias", F.col("rows").alias("anchor_rows"))
    names = plan_aliases(plans).join(plans.select(*PLAN, "occurrence"), [*PLAN])
    best = (
        names.join(counted, ["app_id", "alias"])
        .groupBy(*PLAN, "occurrence", "region")
        .agg(F.min(F.struct("alias_pos", "alias", "rows", "price")).alias("best"))
        .select(
            *PLAN, "occurrence", "region",
            F.col("best.alias").alias("alias"), F.col("best.rows").alias("rows"), F.col("best.price").alias("single"),
        )
        .join(anchored, ["app_id", "alias"], "left")
    )
    nth = numbered.filter(anchor_rows).select(
        "app_id", "region", F.col("name").alias("alias"), "occurrence", F.col("price").alias("nth_price")
    )
    best = best.join(nth, ["app_id", "region", "alias", "occurrence"], "left")
    in_anchor = F.coalesce("anchor_rows", F.lit(0))
    here = F.col("region") == anchor
    unique = (in_anchor <= 1) & (F.col("rows") == 1)
    own = (in_anchor > 1) & (F.col("rows") == in_anchor) & here
    reason = (
        F.when(unique | own, F.lit(None).cast("string"))
        .when(in_anchor <= 1, "unexpected-duplicate-count")
        .when(F.col("rows") != in_anchor, "duplicate-count-mismatch")
        .otherwise("ambiguous-duplicate-name")
    )
    return best.select(
        *PLAN, "region",
        F.when(unique, F.col("single")).when(own, F.col("nth_price")).alias("price"),
        F.when(reason.isNotNull(), "issue")
        .when(unique | F.col("nth_price").isNotNull(), "matched")
        .otherwise("absent")
        .alias("outcome"),
        F.when(unique, "exact-name").when(own & F.col("nth_price").isNotNull(), "us-anchor-only").alias("method"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), in_anchor).cast("bigint").alias("anchor_count"),
        F.when(reason.isNotNull(), F.col("rows")).alias("region_count"),
    )


def strict_match(
    plans: DataFrame, cells: DataFrame, numbered: DataFrame, anchor: Column, anchor_rows: Column
) -> DataFrame:
    """All strict rules: product id, else name and period, else name."""
    common = [*PLAN, "region", "price", "outcome", "method", "reason"]
    shown = numbered.join(public_cells(cells).select("app_id", "region"), ["app_id", "region"], "left_semi")
    by_product = match_plan_by_product(plans, cells, shown, anchor_rows).select(*common)
    unnamed = plans.filter(F.col("product_id").isNull())
    by_period = match_plan_by_name_period(unnamed.filter(F.col("match_period").isNotNull()), shown).select(*common)
    by_name = match_plan_by_name(unnamed, shown, anchor, anchor_rows).select(*common)
    rest = by_name.join(by_period.select(*PLAN, "region"), [*PLAN, "region"], "left_anti")
    return by_product.unionByName(by_period).unionByName(rest)


def price_ladder(priced: DataFrame, plan: Sequence[str] = PLAN) -> DataFrame:
    """Rank markets per plan by rounded price, ties by market code.

    A plan has at most one price per market, so a group is bounded by the
    market dimension.
    """
    order = Window.partitionBy(*plan).orderBy("cny", "region")
    return (
        priced.filter(F.col("cny").isNotNull())
        .withColumn("cny", round_cny(F.col("cny")))
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
    )


def price_ladder_display(priced: DataFrame, plan: Sequence[str] = PLAN) -> DataFrame:
    """Rank by the unrounded price, ties in market order (needs ``ord``)."""
    order = Window.partitionBy(*plan).orderBy("cny", "ord")
    return priced.filter(F.col("cny").isNotNull()).withColumn("rank", F.row_number().over(order).cast("bigint"))


def cheapest_k(priced: DataFrame, k: int = 3, plan: Sequence[str] = PLAN) -> DataFrame:
    """The k cheapest markets per plan; the limit is applied before the shuffle."""
    return price_ladder_display(priced, plan).filter(F.col("rank") <= k)


def price_spread(priced: DataFrame, plan: Sequence[str] = PLAN) -> DataFrame:
    """Lowest and highest market, saving in percent, number of comparable markets."""
    rows = priced.filter(F.col("cny").isNotNull())
    low = F.min(F.struct("cny", "ord", "region"))
    high = F.max(F.struct("cny", "ord", "region"))
    saving = F.floor((1 - F.try_divide(F.col("low.cny"), F.col("high.cny"))) * 100 + 0.5)
    return (
        rows.groupBy(*plan)
        .agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("comparable"))
        .select(
            *plan,
            F.col("low.region").alias("low_region"), round_cny(F.col("low.cny")).alias("low_cny"),
            F.col("high.region").alias("high_region"), round_cny(F.col("high.cny")).alias("high_cny"),
            saving.alias("saving_percent"), "comparable",
        )
    )


def region_grid(plans: DataFrame, markets: DataFrame, matches: DataFrame, cells: DataFrame) -> DataFrame:
    """Every configured market for every plan, matched or not.

    The market list is one bounded array per row (a dimension with a handful of
    rows), so plans are multiplied in place without a cross join.
    """
    listed = markets.agg(F.sort_array(F.collect_list(F.struct("ord", "region"))).alias("m")).scalar()
    grid = plans.select(*PLAN, F.explode(listed).alias("m")).select(*PLAN, "m.ord", "m.region")
    return grid.join(matches, [*PLAN, "region"], "left").join(
        cells.select("app_id", "region", "status", "item_count"), ["app_id", "region"], "left"
    )


def first_metadata(pages: DataFrame, lookup: DataFrame) -> DataFrame:
    """Name, developer, icon and address from the first market with metadata.

    ``pages``: app_id, ord, matched_name, developer, icon, store_url for markets
    that had metadata; ``lookup``: the same without ord.
    """
    fields = ["matched_name", "developer", "icon", "store_url"]
    first = pages.groupBy("app_id").agg(F.min_by(F.struct(*fields), "ord").alias("p"))
    other = lookup.select("app_id", F.struct(*fields).alias("l"))
    joined = first.join(other, "app_id", "full")
    none = F.col("p").isNull() & F.col("l").isNull()

    def filled(text: str) -> Column:
        return F.when(F.col(text) != "", F.col(text))

    return joined.select(
        "app_id",
        F.coalesce("p.matched_name", "l.matched_name", F.concat(F.lit("App "), "app_id")).alias("matched_name"),
        F.when(none, "Apple App Store")
        .otherwise(F.coalesce(filled("p.developer"), filled("l.developer"), F.lit("")))
        .alias("developer"),
        F.coalesce("p.icon", "l.icon").alias("icon"),
        F.coalesce(
            "p.store_url", "l.store_url", F.concat(F.lit("https://apps.apple.com/us/app/id"), "app_id")
        ).alias("store_url"),
    )


def plan_rollup(plans: DataFrame, matches: DataFrame) -> DataFrame:
    """Per plan: counts, match method, group and the sorted price list.

    ``matches``: strict matches with cny, one row per plan and market (null cny
    of a matched row is an issue), so counting rows counts distinct markets and
    the price list is bounded by the market dimension.
    """
    priced = (F.col("outcome") == "matched") & F.col("cny").isNotNull()
    issue = (F.col("outcome") == "issue") | ((F.col("outcome") == "matched") & F.col("cny").isNull())
    named = [c for c in ("market_name",) if c in matches.columns]
    entry = F.struct(round_cny(F.col("cny")).alias("cny"), "region", "price", "currency", "local_amount", *named)
    counted = matches.groupBy(*PLAN).agg(
        F.count(F.when(priced, 1)).alias("available"),
        F.count(F.when(F.col("outcome") == "not-listed", 1)).alias("not_listed"),
        F.count(F.when(issue, 1)).alias("excluded"),
        F.min("method").alias("__method"),
        F.max("method").alias("__other"),
        F.sort_array(F.collect_list(F.when(priced, entry))).alias("prices"),
    )
    joined = plans.select(*PLAN, "label", "period", "display_group", "product_id").join(counted, [*PLAN], "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("available", "not_listed", "excluded")]
    single = F.col("__method") == F.col("__other")
    return joined.select(
        *PLAN, "label", "period", "product_id",
        F.when((F.col("display_group") == "primary") | F.col("period").isin(PRIMARY_PERIODS), "primary")
        .otherwise("other")
        .alias("plan_group"),
        F.when(single, F.col("__method")).when(F.col("__method").isNotNull(), "mixed-verified")
        .otherwise("unmatched")
        .alias("match_method"),
        *zero, "prices",
    )


def match_review(matches: DataFrame) -> DataFrame:
    """Per app: excluded matches, distinct markets affected and distinct reasons."""
    reason = F.coalesce("reason", F.when((F.col("outcome") == "matched") & F.col("cny").isNull(), "price-parse-failed"))
    issues = matches.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return issues.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("excluded_matches"),
        F.count_distinct("region").alias("affected_regions"),
        F.count_distinct("reason").alias("reason_count"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )


def review_issues(matches: DataFrame) -> DataFrame:
    """Every excluded match with its reason, one row each."""
    reason = F.coalesce("reason", F.when((F.col("outcome") == "matched") & F.col("cny").isNull(), "price-parse-failed"))
    issues = matches.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return issues.select(*PLAN, "region", "reason")


def first_issues(issues: DataFrame, plans: DataFrame, markets: DataFrame, k: int = 100) -> DataFrame:
    """The first k issues of each app for a short report: by the plans' order (``seq``), then the markets'.

    The limit is applied before the shuffle; ``review_issues`` has all rows.
    """
    placed = issues.join(plans.select(*PLAN, "seq"), [*PLAN]).join(markets.select("region", "ord"), "region")
    place = F.row_number().over(Window.partitionBy("app_id").orderBy("seq", "plan_id", "ord"))
    first = placed.withColumn("place", place).filter(F.col("place") <= k)
    return first.select("app_id", F.col("place").cast("bigint").alias("place"), "plan_id", "region", "reason")


def comparison_document(
    cells: DataFrame,
    rollup: DataFrame,
    matches: DataFrame,
    anchor_rows: Column,
    markets: DataFrame,
    apps: DataFrame,
    times: dict[str, Column],
) -> DataFrame:
    """Header row of each app's comparison; apps without a usable anchor fail.

    ``apps``: app_id, query, matched_name, developer, icon, store_url,
    price_source; ``times``: generated_at, rates_updated_at.  The number of
    regions is that of the configured markets.

    Plans, prices and issues stay rows of their own tables (``plan_rollup``,
    ``review_issues``) keyed by app, so no app is gathered in one task.
    """
    per_app = cells.groupBy("app_id").agg(
        F.max(F.when(anchor_rows, is_public(F.col("status"), F.col("item_count")))).alias("__anchor"),
        F.count(F.when(is_degraded_region(F.col("status")), 1)).alias("degraded_regions"),
    )
    per_plan = rollup.groupBy("app_id").agg(
        F.count(F.when(F.col("plan_group") == "primary", 1)).alias("primary_plans"),
        F.count(F.when(F.col("plan_group") != "primary", 1)).alias("other_plans"),
    )
    review = match_review(matches).select("app_id", "excluded_matches", "affected_regions")
    joined = per_app.join(per_plan, "app_id", "left").join(review, "app_id", "left").join(apps, "app_id", "left")
    configured = markets.agg(F.count(F.lit(1))).scalar()
    counts = ["primary_plans", "other_plans", "excluded_matches", "affected_regions"]
    error = F.when(~F.coalesce("__anchor", F.lit(False)), "us-anchor-unavailable").when(
        F.coalesce("primary_plans", F.lit(0)) + F.coalesce("other_plans", F.lit(0)) == 0, "us-plans-unavailable"
    )
    return joined.select(
        "app_id", F.coalesce("matched_name", "query", "app_id").alias("name"),
        F.coalesce("developer", F.lit("")).alias("developer"), "icon", "store_url",
        F.coalesce("price_source", F.lit("app-store")).alias("price_source"),
        times["generated_at"].alias("generated_at"), times["rates_updated_at"].alias("rates_updated_at"),
        configured.alias("region_count"), "degraded_regions",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        error.alias("error"),
    )
