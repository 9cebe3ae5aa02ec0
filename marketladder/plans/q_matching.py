"""Queries for plan matching, prices in one currency, ladders and summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketladder.functions import plans as words
from marketladder.functions.status import evidence_state
from marketladder.operators import carry, coverage, diff, matching
from marketladder.operators.items import dedupe_by_product
from marketladder.operators.quality import populated_pages
from marketladder.plans import fixtures as fx
from marketladder.plans.comparison import Comparison, compare
from marketladder.plans.oracle_base import OBS, amount, cny
from marketladder.plans.q_functions import DISPLAY_STATE, INFER_SQL, _java_free
from marketladder.plans.q_items import AFTER, CURATED_SQL, DISCOVER, PERIOD_LABEL, after, curated
from marketladder.plans.registry import n_rows, query
from marketladder.session import dealt, stored


PAGES = """app_page AS (SELECT (100000 + p_partkey % 20)::VARCHAR AS app_id, CASE WHEN min(p_partkey % 20) % 2 = 0 THEN min(p_name) END AS matched_name,
  CASE WHEN min(p_partkey % 20) % 3 = 0 THEN min(p_type) END AS query, CASE WHEN min(p_partkey % 20) % 5 > 0 THEN min(p_brand) END AS developer,
  min(p_name) || '.jpg' AS icon, 'https://example.test/' || min(p_partkey) AS store_url, CASE WHEN min(p_partkey % 20) % 4 = 0 THEN 'service' END AS price_source
  FROM part GROUP BY ALL)"""


def newer_cells(spark: SparkSession, sf: str) -> DataFrame:
    return fx.cells(spark, sf).filter("snap = 'after'").drop("snap")


@query(
    "price_fx",
    "O40",
    f"""WITH {OBS}, p AS (SELECT region, currency, price, {amount('price', 'currency')} AS local_amount, units
      FROM obs LEFT JOIN (SELECT * FROM fx WHERE currency <> 'GBP') USING (currency) WHERE ord <> 3)
    SELECT region, currency, price, local_amount, local_amount / units AS cny,
      CASE WHEN local_amount / units IS NULL THEN 'price-parse-failed' END AS issue, count(*) AS rows FROM p GROUP BY ALL""",
)
def _price_fx(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["region", "currency", "price", "local_amount", "cny", "issue"]
    rows = fx.observations(spark, sf).select("region", "price")
    markets = fx.markets(spark, sf).filter("ord <> 3")  # one market is not configured, one currency has no rate
    return matching.price_fx(rows, markets, fx.rates(spark).filter("currency <> 'GBP'")).groupBy(*columns).agg(n_rows())


@query(
    "match_plan_display",
    "O43",
    f"""WITH {OBS}, {DISCOVER},
    byproduct AS (SELECT p.app_id, p.plan_id, n.region, n.name, n.price FROM plan p JOIN num n ON n.app_id = p.app_id AND n.product_id = p.product_id
      WHERE NOT (coalesce(p.offer_name <> n.offer_name, FALSE) OR coalesce(p.billing_period <> n.billing_period, FALSE) OR coalesce(p.family_id <> n.family_id, FALSE))),
    named AS (SELECT p.app_id, p.plan_id, n.region, n.name, n.price, p.occurrence,
        row_number() OVER (PARTITION BY p.app_id, p.plan_id, n.region ORDER BY n.pos) - 1 AS k
      FROM plan p JOIN num n ON n.app_id = p.app_id AND list_contains(p.aliases, n.name) WHERE p.product_id IS NULL)
    SELECT * FROM byproduct UNION ALL SELECT app_id, plan_id, region, name, price FROM named WHERE k = occurrence""",
)
def _display(spark: SparkSession, sf: str) -> DataFrame:
    found = after(spark, sf)
    plans = stored(discovered_from(found))
    return matching.match_plan_display(plans, found, fx.pos_range())


def discovered_from(found: DataFrame) -> DataFrame:
    from marketladder.operators.plans import discover_plans

    return discover_plans(found, curated(found), F.col("anchor"), fx.pos_range())


def product_plans(found: DataFrame) -> DataFrame:
    """One plan per product of the anchor market."""
    return (
        dedupe_by_product(found.filter("anchor"))
        .select("app_id", F.col("product_id").alias("plan_id"), "product_id")
    )


SHOWN = "shown AS (SELECT app_id, region, status FROM cell WHERE snap = 'after' AND status NOT LIKE 'error:%' AND item_count > 0)"
PRODUCT_MATCH = f"""item AS (SELECT app_id, region, product_id, price, offer_name AS o, {PERIOD_LABEL} AS p, family_id AS f, anchor FROM num WHERE product_id IS NOT NULL),
pm0 AS (SELECT g.app_id, g.plan_id, s.region, s.status, i.price,
    list_filter([CASE WHEN a.o <> i.o THEN 'offer-name' END, CASE WHEN a.p <> i.p THEN 'billing-period' END, CASE WHEN a.f <> i.f THEN 'subscription-family' END], lambda x: x IS NOT NULL) AS fields
  FROM pplan g JOIN shown s ON s.app_id = g.app_id
  LEFT JOIN item i ON i.app_id = g.app_id AND i.region = s.region AND i.product_id = g.product_id
  LEFT JOIN item a ON a.anchor AND a.app_id = g.app_id AND a.product_id = g.product_id),
pm AS (SELECT app_id, plan_id, region, CASE WHEN len(fields) = 0 THEN price END AS price,
    CASE WHEN price IS NULL THEN CASE WHEN status = 'ok-structured' THEN 'not-listed' ELSE 'issue' END WHEN len(fields) > 0 THEN 'issue' ELSE 'matched' END AS outcome,
    CASE WHEN price IS NOT NULL AND len(fields) = 0 THEN 'product-id' END AS method,
    CASE WHEN price IS NULL THEN CASE WHEN status <> 'ok-structured' THEN 'product-id-not-listed' END WHEN len(fields) > 0 THEN 'product-metadata-mismatch' END AS reason,
    CASE WHEN price IS NOT NULL AND len(fields) > 0 THEN list_aggregate(fields, 'string_agg', ',') END AS fields
  FROM pm0)"""


@query(
    "match_plan_by_product",
    "O44",
    f"""WITH {OBS}, {AFTER}, pplan AS (SELECT app_id, product_id AS plan_id, product_id FROM num WHERE anchor), {SHOWN}, {PRODUCT_MATCH}
    SELECT * FROM pm""",
)
def _by_product(spark: SparkSession, sf: str) -> DataFrame:
    found = after(spark, sf)
    return matching.match_plan_by_product(product_plans(found), newer_cells(spark, sf), found, F.col("region") == fx.anchor_region(spark, sf))


@query(
    "match_plan_by_name_period",
    "O45",
    f"""WITH {OBS}, {AFTER}, i AS (SELECT *, {PERIOD_LABEL} AS pl FROM num),
    plan AS (SELECT DISTINCT app_id, name || '/' || pl AS plan_id, name, pl FROM i WHERE anchor AND pl IS NOT NULL),
    c AS (SELECT app_id, region, name, pl, count(*) AS n, min(price) AS price FROM i WHERE pl IS NOT NULL GROUP BY ALL)
    SELECT p.app_id, plan_id, region, CASE WHEN n = 1 THEN price END AS price, CASE WHEN n = 1 THEN 'matched' ELSE 'issue' END AS outcome,
      CASE WHEN n = 1 THEN 'exact-name-period' END AS method, CASE WHEN n > 1 THEN 'duplicate-name-period' END AS reason
    FROM plan p JOIN c ON c.app_id = p.app_id AND c.name = p.name AND c.pl = p.pl""",
)
def _by_period(spark: SparkSession, sf: str) -> DataFrame:
    found = after(spark, sf)
    label = words.canonical_period(F.col("billing_period"))
    plans = (
        found.filter("anchor").withColumn("match_period", label).filter("match_period IS NOT NULL")
        .select(
            "app_id", F.concat("name", F.lit("/"), "match_period").alias("plan_id"), "match_period",
            F.array(F.concat(F.lit("Old "), "name"), F.col("name")).alias("aliases"),
        )
        .dropDuplicates(["app_id", "plan_id"])
    )
    return matching.match_plan_by_name_period(plans, found)


# Plans of the anchor market by their names and number; the first name that occurs in a market counts.
NAME_MATCH = """cn AS (SELECT app_id, region, name, count(*) AS n, min(price) AS price FROM num GROUP BY ALL),
an AS (SELECT c.app_id, c.name, c.n AS an FROM cn c WHERE region = (SELECT region FROM anchor)),
asked AS (SELECT app_id, plan_id, occurrence, unnest(aliases) AS name, generate_subscripts(aliases, 1) AS i FROM nplan),
met AS (SELECT p.*, c.region, c.n, c.price FROM asked p JOIN cn c ON c.app_id = p.app_id AND c.name = p.name
  QUALIFY row_number() OVER (PARTITION BY p.app_id, p.plan_id, c.region ORDER BY p.i) = 1),
nm0 AS (SELECT p.app_id, p.plan_id, p.occurrence, p.region, p.name, p.n, p.price, coalesce(a.an, 0) AS an, p.region = (SELECT region FROM anchor) AS here
  FROM met p LEFT JOIN an a ON a.app_id = p.app_id AND a.name = p.name),
nm1 AS (SELECT m.*, x.price AS nth, an <= 1 AND n = 1 AS uniq, an > 1 AND n = an AND here AS own FROM nm0 m
  LEFT JOIN num x ON x.anchor AND x.app_id = m.app_id AND x.region = m.region AND x.name = m.name AND x.occurrence = m.occurrence),
nm2 AS (SELECT *, CASE WHEN uniq OR own THEN NULL WHEN an <= 1 THEN 'unexpected-duplicate-count' WHEN n <> an THEN 'duplicate-count-mismatch' ELSE 'ambiguous-duplicate-name' END AS reason FROM nm1),
nm AS (SELECT app_id, plan_id, region, CASE WHEN uniq THEN price WHEN own THEN nth END AS price,
    CASE WHEN reason IS NOT NULL THEN 'issue' WHEN uniq OR nth IS NOT NULL THEN 'matched' ELSE 'absent' END AS outcome,
    CASE WHEN uniq THEN 'exact-name' WHEN own AND nth IS NOT NULL THEN 'us-anchor-only' END AS method, reason,
    CASE WHEN reason IS NOT NULL THEN an END AS anchor_count, CASE WHEN reason IS NOT NULL THEN n END AS region_count FROM nm2)"""


@query(
    "match_plan_by_name",
    "O46",
    f"""WITH {OBS}, {AFTER}, nplan AS (SELECT app_id, name || '#' || occurrence AS plan_id, ['Old ' || name, name] AS aliases, occurrence FROM num WHERE anchor
      UNION ALL SELECT app_id, name || '/two' AS plan_id, [name, 'SMALL', 'LARGE'] AS aliases, 1 FROM num WHERE anchor AND occurrence = 1), {NAME_MATCH}
    SELECT * FROM nm""",
)
def _by_name(spark: SparkSession, sf: str) -> DataFrame:
    found = after(spark, sf)
    plans = found.filter("anchor").select(
        "app_id", F.concat_ws("#", "name", F.col("occurrence").cast("string")).alias("plan_id"),
        F.array(F.concat(F.lit("Old "), "name"), F.col("name")).alias("aliases"), "occurrence",
    )
    second = found.filter("anchor AND occurrence = 1").select(  # several of their names occur
        "app_id", F.concat("name", F.lit("/two")).alias("plan_id"), F.array(F.col("name"), F.lit("SMALL"), F.lit("LARGE")).alias("aliases"),
        F.lit(1).cast("bigint").alias("occurrence"),
    )
    code = fx.anchor_region(spark, sf)
    return matching.match_plan_by_name(plans.unionByName(second), found, code, F.col("region") == code)


ANCHORED = re.sub(r"(FROM|JOIN) num\b", r"\1 anum", DISCOVER.split(CURATED_SQL)[1])
STRICT_PLANS = f"""{SHOWN},
anum AS (SELECT num.* FROM num SEMI JOIN shown USING (app_id, region) WHERE anchor), {CURATED_SQL}{ANCHORED},
ea AS (SELECT *, {PERIOD_LABEL} AS per FROM anum),
prow AS (SELECT app_id, product_id, arg_min({{'name': name, 'pid': product_id, 'per': per}}, pos) AS r FROM ea WHERE product_id IS NOT NULL GROUP BY ALL),
wrow AS (SELECT app_id, per, arg_min({{'name': name, 'pid': product_id, 'per': per}}, pos) AS r FROM ea WHERE per IS NOT NULL GROUP BY ALL),
ecnt AS (SELECT app_id, name, count(*) AS n FROM ea GROUP BY ALL),
enames AS (SELECT app_id, plan_id, occurrence, unnest(aliases) AS name, generate_subscripts(aliases, 1) AS i FROM plan),
ebest AS (SELECT app_id, plan_id, occurrence, arg_min(enames.name, i) AS name, arg_min(n, i) AS n FROM enames JOIN ecnt USING (app_id, name) GROUP BY ALL),
nrow AS (SELECT b.app_id, b.plan_id, {{'name': e.name, 'pid': e.product_id, 'per': e.per}} AS r FROM ebest b JOIN ea e ON e.app_id = b.app_id AND e.name = b.name
  AND e.occurrence = CASE WHEN b.n = 1 THEN 0 ELSE b.occurrence END),
sp0 AS (SELECT p.*, {PERIOD_LABEL.replace('billing_period', 'p.billing_period')} AS wanted,
    CASE WHEN p.product_id IS NOT NULL THEN prow.r ELSE coalesce(wrow.r, nrow.r) END AS r
  FROM plan p LEFT JOIN prow ON prow.app_id = p.app_id AND prow.product_id = p.product_id
  LEFT JOIN wrow ON wrow.app_id = p.app_id AND wrow.per = {PERIOD_LABEL.replace('billing_period', 'p.billing_period')}
  LEFT JOIN nrow ON nrow.app_id = p.app_id AND nrow.plan_id = p.plan_id),
sp1 AS (SELECT * EXCLUDE (product_id, period), coalesce(wanted, r.per) AS match_period, coalesce(product_id, r.pid) AS product_id,
    coalesce(wanted, r.per, CASE WHEN regexp_matches(lower(r.name), 'annual') THEN '年付' WHEN regexp_matches(lower(r.name), 'monthly') THEN '月付'
      WHEN regexp_matches(lower(r.name), 'credit') THEN '一次性' END, '公开项目') AS period FROM sp0),
splan AS (SELECT * EXCLUDE (label), CASE WHEN count(*) OVER (PARTITION BY app_id, label, period) > 1 THEN label || ' #' || row_number() OVER (
    PARTITION BY app_id, label, period ORDER BY discovered, curated_ord, first_ord, first_pos, occurrence) ELSE label END AS label,
    row_number() OVER (PARTITION BY app_id ORDER BY discovered, curated_ord, first_ord, first_pos, occurrence) - 1 AS seq FROM sp1),
grp AS (SELECT *, CASE WHEN display_group = 'primary' OR period IN ('月付', '年付', '周付') THEN 'primary' ELSE 'other' END AS plan_group FROM splan)"""

STRICT = f"""{AFTER}, {STRICT_PLANS},
pplan AS (SELECT app_id, plan_id, product_id FROM splan WHERE product_id IS NOT NULL), {PRODUCT_MATCH},
nplan AS (SELECT app_id, plan_id, aliases, occurrence FROM splan WHERE product_id IS NULL), {NAME_MATCH},
cp AS (SELECT app_id, region, name, {PERIOD_LABEL} AS pl, count(*) AS n, min(price) AS price FROM num WHERE billing_period IS NOT NULL GROUP BY ALL),
pasked AS (SELECT app_id, plan_id, match_period, unnest(aliases) AS name, generate_subscripts(aliases, 1) AS i FROM splan WHERE product_id IS NULL),
pmet AS (SELECT p.app_id, p.plan_id, c.region, c.n, c.price FROM pasked p JOIN cp c ON c.app_id = p.app_id AND c.name = p.name AND c.pl = p.match_period
  QUALIFY row_number() OVER (PARTITION BY p.app_id, p.plan_id, c.region ORDER BY p.i) = 1),
pp AS (SELECT app_id, plan_id, region, CASE WHEN n = 1 THEN price END AS price, CASE WHEN n = 1 THEN 'matched' ELSE 'issue' END AS outcome,
    CASE WHEN n = 1 THEN 'exact-name-period' END AS method, CASE WHEN n > 1 THEN 'duplicate-name-period' END AS reason FROM pmet),
strict AS (SELECT app_id, plan_id, region, price, outcome, method, reason FROM pm UNION ALL SELECT * FROM pp
  UNION ALL SELECT app_id, plan_id, region, price, outcome, method, reason FROM nm
    WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.app_id = nm.app_id AND pp.plan_id = nm.plan_id AND pp.region = nm.region)),
money AS (SELECT s.*, m.currency, {amount('s.price', 'm.currency')} / f.units AS cny FROM strict s JOIN market m USING (region) JOIN fx f USING (currency)),
judged AS (SELECT *, outcome = 'matched' AND cny IS NOT NULL AS priced, outcome = 'issue' OR (outcome = 'matched' AND cny IS NULL) AS bad,
    coalesce(reason, CASE WHEN outcome = 'matched' AND cny IS NULL THEN 'price-parse-failed' END) AS why FROM money)"""


def compared(spark: SparkSession, sf: str) -> tuple[DataFrame, Comparison]:
    """Newer cells, and the comparison of the newer snapshot."""
    found, cells = after(spark, sf), stored(newer_cells(spark, sf))
    times = {"generated_at": F.lit("2026-08-30T00:00:00Z"), "rates_updated_at": F.lit("2026-08-29T00:00:00Z")}
    return cells, compare(
        cells, found, fx.app_pages(spark, sf), curated(found), fx.markets(spark, sf), fx.rates(spark),
        fx.anchor_region(spark, sf), times, fx.pos_range(),
    )


@query("strict_match", "O44", f"WITH {OBS}, {STRICT} SELECT app_id, plan_id, region, price, outcome, method, reason, cny FROM money")
def _strict(spark: SparkSession, sf: str) -> DataFrame:
    _, found = compared(spark, sf)
    return found.matches.select("app_id", "plan_id", "region", "price", "outcome", "method", "reason", "cny")


ROLLUP = """rolled AS (SELECT g.app_id, g.plan_id, g.label, g.product_id, g.period, g.plan_group,
    CASE WHEN count(DISTINCT method) = 1 THEN min(method) WHEN count(DISTINCT method) > 1 THEN 'mixed-verified' ELSE 'unmatched' END AS match_method,
    count(*) FILTER (priced) AS available, count(DISTINCT region) FILTER (outcome = 'not-listed') AS not_listed, count(DISTINCT region) FILTER (bad) AS excluded,
    coalesce(string_agg(region || ':' || currency || ':' || price, ' ' ORDER BY floor((cny + 2.220446049250313e-16) * 100 + 0.5) / 100, region, price) FILTER (priced), '') AS prices
  FROM grp g LEFT JOIN judged j USING (app_id, plan_id) GROUP BY ALL)"""


@query("plan_rollup", "O56", f"WITH {OBS}, {STRICT}, {ROLLUP} SELECT * FROM rolled")
def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    _, found = compared(spark, sf)
    entry = lambda p: F.concat_ws(":", p["region"], p["currency"], p["price"])
    shown = F.array_join(F.transform("prices", entry), " ")
    return found.rollup.select(
        "app_id", "plan_id", "label", "product_id", "period", "plan_group", "match_method", "available", "not_listed",
        "excluded", F.coalesce(shown, F.lit("")).alias("prices"),
    )


@query(
    "comparison_document",
    "O57",
    f"""WITH {OBS}, {STRICT}, {ROLLUP},
    {PAGES},
    pa AS (SELECT app_id, count(*) FILTER (status LIKE 'error:%' AND status <> 'error:HTTP 404') AS degraded_regions,
      bool_or(region = (SELECT region FROM anchor) AND status NOT LIKE 'error:%' AND item_count > 0) AS anchored FROM cell WHERE snap = 'after' GROUP BY ALL),
    pl AS (SELECT app_id, count(*) FILTER (plan_group = 'primary') AS primary_plans, count(*) FILTER (plan_group <> 'primary') AS other_plans FROM rolled GROUP BY ALL),
    rv AS (SELECT app_id, count(*) AS excluded_matches, count(DISTINCT region) AS affected_regions FROM judged WHERE why IS NOT NULL GROUP BY ALL)
    SELECT app_id, coalesce(matched_name, query, app_id) AS name, coalesce(developer, '') AS developer, icon, store_url, coalesce(price_source, 'app-store') AS price_source,
      '2026-08-30T00:00:00Z' AS generated_at, '2026-08-29T00:00:00Z' AS rates_updated_at, (SELECT count(*) FROM market) AS region_count, degraded_regions, coalesce(primary_plans, 0) AS primary_plans, coalesce(other_plans, 0) AS other_plans,
      coalesce(excluded_matches, 0) AS excluded_matches, coalesce(affected_regions, 0) AS affected_regions,
      CASE WHEN NOT anchored THEN 'us-anchor-unavailable' WHEN coalesce(primary_plans, 0) + coalesce(other_plans, 0) = 0 THEN 'us-plans-unavailable' END AS error
    FROM pa LEFT JOIN pl USING (app_id) LEFT JOIN rv USING (app_id) LEFT JOIN app_page USING (app_id)""",
)
def _document(spark: SparkSession, sf: str) -> DataFrame:
    _, found = compared(spark, sf)
    return found.headers


@query(
    "comparison_issues",
    "O57",
    f"WITH {OBS}, {STRICT} SELECT app_id, plan_id, region, why AS reason FROM judged WHERE why IS NOT NULL",
)
def _issues(spark: SparkSession, sf: str) -> DataFrame:
    _, found = compared(spark, sf)
    return found.issues


@query(
    "match_review",
    "O62",
    f"""WITH {OBS}, {STRICT} SELECT app_id, count(*) AS excluded_matches, count(DISTINCT region) AS affected_regions,
      count(DISTINCT why) AS reason_count, string_agg(DISTINCT why, ',' ORDER BY why) AS reasons FROM judged WHERE why IS NOT NULL GROUP BY ALL""",
)
def _review(spark: SparkSession, sf: str) -> DataFrame:
    _, found = compared(spark, sf)
    return matching.match_review(found.matches)


@query(
    "first_issues",
    "O57",
    f"""WITH {OBS}, {STRICT} SELECT j.app_id, row_number() OVER (PARTITION BY j.app_id ORDER BY s.seq, j.plan_id, m.ord) AS place, j.plan_id, j.region, why AS reason
    FROM judged j JOIN splan s USING (app_id, plan_id) JOIN market m USING (region) WHERE why IS NOT NULL QUALIFY place <= 100""",
)
def _first_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The top-k view beside ``comparison_issues``."""
    _, found = compared(spark, sf)
    return matching.first_issues(found.issues, found.plans, fx.markets(spark, sf))


IDENTITY = f"""{STRICT}, {ROLLUP},
al AS (SELECT app_id, plan_id, unnest(aliases) AS alias FROM splan),
dup AS (SELECT DISTINCT app_id, plan_id FROM al JOIN (SELECT app_id, alias FROM al GROUP BY ALL HAVING count(*) > 1) USING (app_id, alias)),
counted AS (SELECT r.app_id, count(*) AS plan_count, count(r.product_id) AS structured_plans,
    count(*) FILTER (d.plan_id IS NOT NULL AND (r.product_id IS NULL OR r.period = '公开项目' OR match_method IN ('us-anchor-only', 'unmatched'))) AS unresolved_plans,
    count(*) FILTER (match_method = 'us-anchor-only') AS anchor_only_plans
  FROM rolled r LEFT JOIN dup d USING (app_id, plan_id) GROUP BY ALL),
rec AS (SELECT app_id, CASE WHEN app_id::INTEGER % 2 = 0 THEN 'snapshot' ELSE 'live' END AS source,
    max(CASE WHEN region = (SELECT region FROM anchor) THEN status END) AS us_status,
    max(CASE WHEN region = (SELECT region FROM anchor) THEN identity_status END) AS us_identity_status, count(*) FILTER (status = 'ok-structured') AS structured_regions,
    count(*) FILTER (status <> 'ok-structured' AND coalesce(identity_status, '') <> '') AS degraded_regions FROM cell WHERE snap = 'after' GROUP BY ALL)"""


@query(
    "identity_summary",
    "O58",
    f"""WITH {OBS}, {IDENTITY} SELECT app_id, source, us_status, us_identity_status, structured_regions, degraded_regions, coalesce(plan_count, 0) AS plan_count, coalesce(structured_plans, 0) AS structured_plans,
      coalesce(unresolved_plans, 0) AS unresolved_plans, coalesce(anchor_only_plans, 0) AS anchor_only_plans FROM rec LEFT JOIN counted USING (app_id)""",
)
def _identity(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(spark, sf)


@query(
    "unresolved_plans",
    "O58",
    f"""WITH {OBS}, {IDENTITY} SELECT r.app_id, r.plan_id FROM rolled r SEMI JOIN dup d USING (app_id, plan_id)
    WHERE r.product_id IS NULL OR r.period = '公开项目' OR match_method IN ('us-anchor-only', 'unmatched')""",
)
def _unresolved(spark: SparkSession, sf: str) -> DataFrame:
    from marketladder.operators.plans import duplicate_alias_plans

    _, found = compared(spark, sf)
    return carry.unresolved_ids(found.rollup, duplicate_alias_plans(found.plans))


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    from marketladder.functions.status import is_identity_degraded
    from marketladder.operators.plans import duplicate_alias_plans

    cells, found = compared(spark, sf)
    here = F.col("region") == fx.anchor_region(spark, sf)
    records = cells.groupBy("app_id").agg(
        F.max(F.when(here, F.col("status"))).alias("us_status"),
        F.max(F.when(here, F.col("identity_status"))).alias("us_identity_status"),
        F.count(F.when(F.col("status") == "ok-structured", 1)).alias("structured_regions"),
        F.count(F.when(is_identity_degraded(F.col("status"), F.col("identity_status")), 1)).alias("degraded_regions"),
    ).withColumn("source", F.when(F.col("app_id").cast("int") % 2 == 0, "snapshot").otherwise("live"))
    return carry.identity_summary(records, found.rollup, duplicate_alias_plans(found.plans))


# Prices of each product of the newer snapshot.
PRICED = f"""{AFTER}, priced AS (SELECT app_id, product_id AS plan_id, n.region, n.ord, n.price, {amount('price', 'currency')} / units AS cny
  FROM num n JOIN fx USING (currency) WHERE product_id IS NOT NULL),
ok AS (SELECT *, {cny('cny')} AS rounded FROM priced WHERE cny IS NOT NULL)"""


def product_prices(spark: SparkSession, sf: str) -> DataFrame:
    newer = fx.observations(spark, sf).filter("snap = 'after'")
    rows = dedupe_by_product(newer).select("app_id", F.col("product_id").alias("plan_id"), "region", "ord", "price")
    return matching.price_fx(rows, fx.markets(spark, sf), fx.rates(spark))


@query(
    "price_ladder",
    "O65",
    f"""WITH {OBS}, {PRICED} SELECT app_id, plan_id, region, price, rounded AS cny, row_number() OVER (PARTITION BY app_id, plan_id ORDER BY rounded, region) AS rank FROM ok""",
)
def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    return matching.price_ladder(product_prices(spark, sf)).select("app_id", "plan_id", "region", "price", "cny", "rank")


@query(
    "price_ladder_display",
    "O65",
    f"""WITH {OBS}, {PRICED} SELECT app_id, plan_id, region, cny, row_number() OVER (PARTITION BY app_id, plan_id ORDER BY cny, ord) AS rank FROM ok""",
)
def _ladder_display(spark: SparkSession, sf: str) -> DataFrame:
    return matching.price_ladder_display(product_prices(spark, sf)).select("app_id", "plan_id", "region", "cny", "rank")


@query(
    "cheapest_k",
    "O67",
    f"""WITH {OBS}, {PRICED} SELECT app_id, plan_id, region, row_number() OVER (PARTITION BY app_id, plan_id ORDER BY cny, ord) AS rank FROM ok QUALIFY rank <= 3""",
)
def _cheapest(spark: SparkSession, sf: str) -> DataFrame:
    return matching.cheapest_k(product_prices(spark, sf), 3).select("app_id", "plan_id", "region", "rank")


@query(
    "price_spread",
    "O68",
    f"""WITH {OBS}, {PRICED}, s AS (SELECT app_id, plan_id, min(cny) AS lo, max(cny) AS hi, arg_min(region, (cny, ord)) AS low_region,
        arg_max(region, (cny, ord)) AS high_region, count(*) AS comparable FROM ok GROUP BY ALL)
    SELECT app_id, plan_id, low_region, {cny('lo')} AS low_cny, high_region, {cny('hi')} AS high_cny,
      floor((1 - lo / hi) * 100 + 0.5)::BIGINT AS saving_percent, comparable FROM s""",
)
def _spread(spark: SparkSession, sf: str) -> DataFrame:
    return matching.price_spread(product_prices(spark, sf))


@query(
    "region_grid",
    "O49",
    f"""WITH {OBS}, {PRICED}, p AS (SELECT DISTINCT app_id, plan_id FROM priced)
    SELECT p.app_id, p.plan_id, m.region, r.price, c.status, c.item_count,
      CASE WHEN r.price IS NULL THEN CASE WHEN c.status = 'official-price-page-missing' THEN 'x' ELSE {DISPLAY_STATE.replace('status', 'c.status').replace('item_count', 'c.item_count')} END END AS missing
    FROM p CROSS JOIN market m LEFT JOIN priced r ON r.app_id = p.app_id AND r.plan_id = p.plan_id AND r.region = m.region
    LEFT JOIN cell c ON c.snap = 'after' AND c.app_id = p.app_id AND c.region = m.region""",
)
def _grid(spark: SparkSession, sf: str) -> DataFrame:
    priced = stored(product_prices(spark, sf).select("app_id", "plan_id", "region", "price"))
    plans = priced.select("app_id", "plan_id").distinct()
    grid = matching.region_grid(plans, fx.markets(spark, sf), priced, newer_cells(spark, sf))
    state = evidence_state(F.coalesce("status", F.lit("")), F.col("item_count"))
    return grid.select(
        "app_id", "plan_id", "region", "price", "status", "item_count",
        F.when(F.col("price").isNull(), state).alias("missing"),
    )


@query(
    "coverage_summary",
    "O54",
    f"""WITH {OBS}, s AS (SELECT snap, app_id, {DISPLAY_STATE} AS state FROM cell)
    SELECT snap, app_id, count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (state = 'unavailable') AS unavailable,
      count(*) FILTER (state = 'not-public') AS not_public, count(*) FILTER (state = 'review') AS review, count(*) AS total
    FROM s GROUP BY GROUPING SETS ((snap, app_id), ())""",
)
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_summary(fx.cells(spark, sf), ["snap", "app_id"])


@query(
    "item_range",
    "O55",
    f"""WITH {OBS} SELECT snap, app_id, coalesce(min(item_count) FILTER (status LIKE 'ok-%' AND item_count > 0), 0) AS min_items,
      coalesce(max(item_count) FILTER (status LIKE 'ok-%' AND item_count > 0), 0) AS max_items FROM cell GROUP BY ALL""",
)
def _range(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.item_range(fx.cells(spark, sf), ["snap", "app_id"])


@query(
    "populated_pages",
    "O60",
    f"WITH {OBS} SELECT snap, app_id, count(*) FILTER (item_count > 0) AS populated FROM cell GROUP BY ALL",
)
def _populated(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.cells(spark, sf).withColumnRenamed("item_count", "declared")
    return populated_pages(cells, ["snap", "app_id"])


@query(
    "flag_known_apps",
    "O50",
    """WITH log AS (SELECT l_orderkey, (l_partkey % 5000 + 100000)::VARCHAR AS app_id FROM lineitem)
    SELECT l_orderkey, log.app_id, p.app_id IS NOT NULL AS known, count(*) AS rows FROM log
    LEFT JOIN (SELECT (100000 + p_partkey)::VARCHAR AS app_id FROM part WHERE p_size < 25) p USING (app_id) GROUP BY ALL""",
)
def _known(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % 5000 + 100000).cast("string").alias("app_id")
    )
    catalog = fx.table(spark, sf, "part").filter("p_size < 25").select(
        (F.col("p_partkey") + 100000).cast("string").alias("app_id")
    )
    # Nearly every row is a group of its own, so rows are dealt out before they are counted, not after.
    flagged = dealt(diff.flag_known_apps(log, catalog), "l_orderkey", "app_id")
    return flagged.groupBy("l_orderkey", "app_id", "known").agg(n_rows())


@query(
    "first_metadata",
    "O51",
    """WITH pg AS (SELECT (100000 + l_partkey)::VARCHAR AS app_id, s_nationkey::BIGINT AS ord, min(l_orderkey) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE l_returnflag <> 'N' GROUP BY ALL),
      f AS (SELECT app_id, min(ord) AS ord, arg_min(k, ord) AS k FROM pg GROUP BY ALL),
      l AS (SELECT (100000 + p_partkey)::VARCHAR AS app_id, p_name, p_brand FROM part WHERE p_size % 3 <> 0)
    SELECT coalesce(f.app_id, l.app_id) AS app_id, coalesce(CASE WHEN f.ord % 4 <> 0 THEN 'Page ' || f.k END, l.p_name, 'App ' || coalesce(f.app_id, l.app_id)) AS matched_name,
      coalesce(CASE WHEN f.ord % 3 <> 0 THEN 'Maker ' || f.k END, l.p_brand, '') AS developer, CASE WHEN f.ord % 2 = 0 THEN 'icon' || f.k ELSE l.p_name END AS icon,
      coalesce(l.p_brand, 'https://apps.apple.com/us/app/id' || coalesce(f.app_id, l.app_id)) AS store_url
    FROM f FULL JOIN l ON f.app_id = l.app_id""",
)
def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    line = fx.table(spark, sf, "lineitem").filter("l_returnflag <> 'N'")
    supplier = fx.table(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    k, ord_ = F.col("k").cast("string"), F.col("ord")
    pages = (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .groupBy((F.col("l_partkey") + 100000).cast("string").alias("app_id"), F.col("s_nationkey").cast("bigint").alias("ord"))
        .agg(F.min("l_orderkey").alias("k"))
        .select(
            "app_id", "ord", F.when(ord_ % 4 != 0, F.concat(F.lit("Page "), k)).alias("matched_name"),
            F.when(ord_ % 3 != 0, F.concat(F.lit("Maker "), k)).otherwise("").alias("developer"),
            F.when(ord_ % 2 == 0, F.concat(F.lit("icon"), k)).alias("icon"), none.alias("store_url"),
        )
    )
    lookup = fx.table(spark, sf, "part").filter("p_size % 3 <> 0").select(
        (F.col("p_partkey") + 100000).cast("string").alias("app_id"), F.col("p_name").alias("matched_name"),
        F.col("p_brand").alias("developer"), F.col("p_name").alias("icon"), F.col("p_brand").alias("store_url"),
    )
    return matching.first_metadata(pages, lookup)
