"""Queries for the publishing rules, one per rule, on disturbed copies of the fixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketladder.operators import quality
from marketladder.operators.numbering import number_in_group, position_range
from marketladder.plans import fixtures as fx
from marketladder.plans.oracle_base import OBS
from marketladder.plans.registry import n_rows, query
from marketladder.session import stored

SAFE_EMPTY = "('iap-section-missing', 'official-price-page-missing', 'error:HTTP 404')"


def rule(number: str, name: str, sql: str) -> Callable[[Callable], Callable]:
    """A rule's violations; ``sql`` gives app_id, region and detail."""
    return query(f"rule_{name}", number, f"SELECT '{number}' AS rule, app_id::VARCHAR AS app_id, region::VARCHAR AS region, detail::VARCHAR AS detail FROM ({sql})")


def key_text(column: str) -> Column:
    return F.col(column).cast("string")


def app_id(column: str) -> Column:
    return (F.col(column) + 100000).cast("string")


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot header per order."""
    key = F.col("o_orderkey")
    time = F.when(key % 7 == 0, "yesterday").when(key % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    source = F.when(key % 5 == 0, F.col("o_orderpriority")).otherwise(quality.SOURCE)
    return fx.table(spark, sf, "orders").select(time.alias("generated_at"), source.alias("source"))


@rule(
    "V01", "snapshot_time_parses",
    "SELECT NULL AS app_id, NULL AS region, CASE WHEN o_orderkey % 7 = 0 THEN 'yesterday' END AS detail FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0",
)
def _v01(spark: SparkSession, sf: str) -> DataFrame:
    return quality.snapshot_time_parses(headers(spark, sf))


@rule(
    "V02", "source_is_expected",
    "SELECT NULL AS app_id, NULL AS region, o_orderpriority AS detail FROM orders WHERE o_orderkey % 5 = 0",
)
def _v02(spark: SparkSession, sf: str) -> DataFrame:
    return quality.source_is_expected(headers(spark, sf))


def config(spark: SparkSession, sf: str) -> DataFrame:
    """Configured apps: every part but some."""
    key = F.col("p_partkey")
    return fx.table(spark, sf, "part").filter(key % 50 != 3).select(
        app_id("p_partkey").alias("app_id"), key.alias("ord"),
        F.when(key % 6 == 0, "apple-service").alias("price_source"),
        F.when(key % 8 == 0, F.col("p_type")).alias("catalog_group"), (key % 30 == 0).alias("allow_all_empty"),
    )


def deferred(spark: SparkSession, sf: str) -> DataFrame:
    line = fx.table(spark, sf, "lineitem").filter("l_quantity = 50 AND l_discount > 0.08")
    return line.select(app_id("l_partkey").alias("app_id")).distinct()


DEFERRED = "(SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08)"


@rule("V03", "deferred_are_configured", f"SELECT 100000 + k AS app_id, NULL AS region, NULL AS detail FROM {DEFERRED} WHERE k % 50 = 3")
def _v03(spark: SparkSession, sf: str) -> DataFrame:
    return quality.deferred_are_configured(deferred(spark, sf), config(spark, sf))


@rule(
    "V04", "deferred_were_unpublished",
    f"SELECT 100000 + k AS app_id, NULL AS region, NULL AS detail FROM {DEFERRED} WHERE k IN (SELECT p_partkey FROM part WHERE p_size > 10)",
)
def _v04(spark: SparkSession, sf: str) -> DataFrame:
    previous = fx.table(spark, sf, "part").filter("p_size > 10").select(app_id("p_partkey").alias("app_id"))
    return quality.deferred_were_unpublished(deferred(spark, sf), previous)


@rule(
    "V05", "published_match_config",
    f"""WITH e AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part WHERE p_partkey % 50 <> 3 AND p_partkey NOT IN (SELECT k FROM {DEFERRED})),
      a AS (SELECT k, row_number() OVER (ORDER BY o) - 1 AS place FROM (SELECT k, CASE WHEN place % 400 = 7 THEN k + 3.5 ELSE k END AS o FROM e WHERE k % 701 <> 700))
    SELECT 100000 + coalesce(a.k, e.k) AS app_id, NULL AS region, 'place ' || coalesce(a.place, e.place) AS detail FROM a FULL JOIN e USING (place) WHERE a.k IS DISTINCT FROM e.k""",
)
def _v05(spark: SparkSession, sf: str) -> DataFrame:
    wanted = config(spark, sf).join(deferred(spark, sf), "app_id", "left_anti")
    placed = number_in_group(wanted, [], ["ord"], position_range("ord"), "place")
    moved = F.when(F.col("place") % 400 == 7, F.col("ord") + 3).otherwise(F.col("ord"))
    published = placed.filter(F.col("ord") % 701 != 700).select(
        "app_id", (moved * 2 + F.when(F.col("place") % 400 == 7, 1).otherwise(0)).alias("ord")
    )
    return quality.published_match_config(published, config(spark, sf), deferred(spark, sf))


@rule("V06", "regions_exist", "SELECT o_orderkey::VARCHAR AS app_id, NULL AS region, NULL AS detail FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _v06(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as configurations, the nations of their suppliers as markets; some orders have none."""
    line, supplier = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "supplier")
    markets = line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(key_text("l_orderkey").alias("app_id"), key_text("s_nationkey").alias("region"))
    return quality.regions_exist(markets, fx.table(spark, sf, "orders").select(key_text("o_orderkey").alias("app_id")))


@rule("V07", "regions_are_unique", "SELECT NULL AS app_id, s_nationkey AS region, count(*) AS detail FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def _v07(spark: SparkSession, sf: str) -> DataFrame:
    return quality.regions_are_unique(fx.table(spark, sf, "supplier").select(key_text("s_nationkey").alias("region")))


@rule(
    "V08", "listed_regions_match",
    """SELECT NULL AS app_id, coalesce(CASE WHEN c_custkey % 10 <> 4 THEN CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE c_name END END, c_name) AS region, c_custkey AS detail FROM customer
    WHERE c_custkey % 10 = 4 OR c_custkey % 7 = 0""",
)
def _v08(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = fx.table(spark, sf, "customer")
    configured = customers.select(key.alias("ord"), F.col("c_name").alias("region"))
    listed = customers.filter(key % 10 != 4).select(
        key.alias("ord"), F.when(key % 7 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("region")
    )
    return quality.listed_regions_match(configured, listed)


def published(spark: SparkSession, sf: str) -> DataFrame:
    """Published apps with metadata, some of it missing or wrong."""
    key = F.col("p_partkey")
    categories = F.array(F.lit("Music"), F.lit("Games"), F.lit("Weather"))
    return fx.table(spark, sf, "part").select(
        app_id("p_partkey").alias("app_id"),
        F.when(key % 40 != 1, F.col("p_name")).alias("matched_name"),
        F.when(key % 40 == 2, "").otherwise(F.col("p_brand")).alias("developer"),
        F.when(key % 5 != 0, F.col("p_name")).alias("icon"),
        F.when(key % 6 == 0, "apple-service").when(key % 25 != 4, "app-store").alias("price_source"),
        F.get(categories, (key % 3).cast("int")).alias("category"),
        F.when(key % 8 == 0, F.col("p_type")).when(key % 3 == 0, "影音娱乐").when(key % 3 == 1, "游戏").otherwise("其它")
        .alias("catalog_group"),
    )


@rule(
    "V09", "metadata_is_complete",
    """SELECT 100000 + p_partkey AS app_id, NULL AS region, NULL AS detail FROM part
    WHERE p_partkey % 40 = 1 OR p_partkey % 40 = 2 OR (p_partkey % 5 = 0 AND p_partkey % 6 <> 0)""",
)
def _v09(spark: SparkSession, sf: str) -> DataFrame:
    return quality.metadata_is_complete(published(spark, sf))


@rule(
    "V10", "price_source_matches",
    "SELECT 100000 + p_partkey AS app_id, NULL AS region, NULL AS detail FROM part WHERE p_partkey % 50 <> 3 AND p_partkey % 6 <> 0 AND p_partkey % 25 = 4",
)
def _v10(spark: SparkSession, sf: str) -> DataFrame:
    return quality.price_source_matches(published(spark, sf), config(spark, sf))


@rule(
    "V11", "group_matches",
    "SELECT 100000 + p_partkey AS app_id, NULL AS region, '其它' AS detail FROM part WHERE p_partkey % 50 <> 3 AND p_partkey % 8 <> 0 AND p_partkey % 3 = 2",
)
def _v11(spark: SparkSession, sf: str) -> DataFrame:
    return quality.group_matches(published(spark, sf), config(spark, sf))


# Cells with a wrong count, an unsafe status or hidden items in some markets.
BAD_CELLS = """bad AS (SELECT app_id, region, snap, ord, CASE WHEN ord % 8 = 1 AND status LIKE 'ok-%' THEN 'iap-section-missing' WHEN ord % 8 = 2 AND status NOT LIKE 'ok-%' THEN 'ok-textPairs' ELSE status END AS status,
    item_count + CASE WHEN ord % 9 = 4 THEN 1 ELSE 0 END AS declared, item_count AS actual FROM cell)"""


def bad_cells(spark: SparkSession, sf: str) -> DataFrame:
    number, status = F.col("ord"), F.col("status")
    ok = status.startswith("ok-")
    return fx.cells(spark, sf).select(
        *fx.CELL, "ord",
        F.when((number % 8 == 1) & ok, "iap-section-missing").when((number % 8 == 2) & ~ok, "ok-textPairs").otherwise(status)
        .alias("status"),
        (F.col("item_count") + F.when(number % 9 == 4, 1).otherwise(0)).alias("declared"),
        F.col("item_count").alias("actual"),
    )


@rule(
    "V12", "app_regions_match",
    f"""WITH {OBS}, p AS (SELECT snap || app_id AS app_id, count(*) AS n, count(*) FILTER (NOT (app_id::INTEGER % 4 = 0 AND ord > 20)) AS agreeing
        FROM cell WHERE NOT (app_id::INTEGER % 5 = 0 AND ord = 3) GROUP BY ALL)
    SELECT app_id, NULL AS region, agreeing AS detail FROM p WHERE n <> (SELECT count(*) FROM market) OR agreeing <> (SELECT count(*) FROM market)""",
)
def _v12(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("app_id").cast("int")
    listed = fx.cells(spark, sf).filter(~((number % 5 == 0) & (F.col("ord") == 3)))
    place = F.when((number % 4 == 0) & (F.col("ord") > 20), F.col("ord") - 1).otherwise(F.col("ord"))
    cells = listed.select(F.concat("snap", "app_id").alias("app_id"), "region", place.alias("place"))
    return quality.app_regions_match(cells, fx.markets(spark, sf))


@rule(
    "V13", "status_is_safe",
    f"WITH {OBS}, {BAD_CELLS} SELECT app_id, region, status AS detail FROM bad WHERE status NOT IN {SAFE_EMPTY} AND status NOT LIKE 'ok-%'",
)
def _v13(spark: SparkSession, sf: str) -> DataFrame:
    return quality.status_is_safe(bad_cells(spark, sf))


@rule("V14", "count_matches", f"WITH {OBS}, {BAD_CELLS} SELECT app_id, region, declared AS detail FROM bad WHERE declared <> actual")
def _v14(spark: SparkSession, sf: str) -> DataFrame:
    return quality.count_matches(bad_cells(spark, sf))


@rule(
    "V15", "ok_has_items",
    f"WITH {OBS}, {BAD_CELLS} SELECT app_id, region, status AS detail FROM bad WHERE declared = actual AND status LIKE 'ok-%' AND actual = 0",
)
def _v15(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ok_has_items(bad_cells(spark, sf))


@rule(
    "V16", "empty_has_none",
    f"WITH {OBS}, {BAD_CELLS} SELECT app_id, region, status AS detail FROM bad WHERE declared = actual AND status IN {SAFE_EMPTY} AND actual > 0",
)
def _v16(spark: SparkSession, sf: str) -> DataFrame:
    return quality.empty_has_none(bad_cells(spark, sf))


# Items with blank names, prices without digits and broken product ids.
BAD_ITEMS = """bad AS (SELECT app_id, region, status, pos, CASE WHEN (pos // 4194304) % 31 = 0 THEN ' ' ELSE name END AS name,
    CASE WHEN (pos // 4194304) % 37 = 0 THEN 'free' WHEN (pos // 4194304) % 41 = 0 THEN NULL ELSE price END AS price,
    CASE WHEN (pos // 4194304) % 43 = 0 THEN 'x' || product_id WHEN (pos // 4194304) % 47 <> 0 THEN product_id END AS product_id FROM obs)"""


def bad_items(spark: SparkSession, sf: str) -> DataFrame:
    line = F.floor(F.col("pos") / 4194304)
    return fx.observations(spark, sf).select(
        "app_id", "region", "status", "pos", F.when(line % 31 == 0, " ").otherwise(F.col("name")).alias("name"),
        F.when(line % 37 == 0, "free").when(line % 41 != 0, F.col("price")).alias("price"),
        F.when(line % 43 == 0, F.concat(F.lit("x"), "product_id")).when(line % 47 != 0, F.col("product_id"))
        .alias("product_id"),
    )


@rule(
    "V17", "items_are_named",
    f"WITH {OBS}, {BAD_ITEMS} SELECT app_id, region, pos AS detail FROM bad WHERE trim(coalesce(name, '')) = '' OR trim(coalesce(price, '')) = ''",
)
def _v17(spark: SparkSession, sf: str) -> DataFrame:
    return quality.items_are_named(bad_items(spark, sf))


@rule(
    "V18", "price_has_digit",
    f"WITH {OBS}, {BAD_ITEMS} SELECT app_id, region, price AS detail FROM bad WHERE trim(coalesce(name, '')) <> '' AND trim(coalesce(price, '')) <> '' AND NOT regexp_matches(price, '[0-9]')",
)
def _v18(spark: SparkSession, sf: str) -> DataFrame:
    return quality.price_has_digit(bad_items(spark, sf))


@rule(
    "V19", "product_id_is_valid",
    f"WITH {OBS}, {BAD_ITEMS} SELECT app_id, region, name AS detail FROM bad WHERE status = 'ok-structured' AND NOT regexp_matches(coalesce(product_id, ''), '^[0-9]{{6,15}}$')",
)
def _v19(spark: SparkSession, sf: str) -> DataFrame:
    return quality.product_id_is_valid(bad_items(spark, sf))


@rule(
    "V20", "items_are_unique",
    f"""WITH {OBS}, k AS (SELECT app_id, region, CASE WHEN product_id IS NOT NULL THEN 'product:' || product_id ELSE 'legacy:' || name || chr(0) || price END AS key, count(*) AS n FROM obs GROUP BY ALL)
    SELECT app_id, region, n AS detail FROM k WHERE n > 1""",
)
def _v20(spark: SparkSession, sf: str) -> DataFrame:
    return quality.items_are_unique(fx.observations(spark, sf))


# Per part: markets of its suppliers, with items or without, in two years.
PAGES = """pages AS (SELECT l_partkey AS k, l_suppkey AS s, max(CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 1 ELSE 0 END)::BIGINT AS b,
    max(CASE WHEN l_shipdate >= TIMESTAMP '2000-06-01' AND l_quantity > 35 THEN 1 ELSE 0 END)::BIGINT AS a FROM lineitem GROUP BY ALL)"""


def page_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ship = F.col("l_shipdate")
    old = F.max(F.when(ship < F.lit("1998-07-01").cast("timestamp_ntz"), 1).otherwise(0)).cast("bigint")
    late = (ship >= F.lit("2000-06-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 35)
    rows = fx.table(spark, sf, "lineitem").groupBy(app_id("l_partkey").alias("app_id"), "l_suppkey").agg(
        old.alias("b"), F.max(F.when(late, 1).otherwise(0)).cast("bigint").alias("a")
    )
    return rows.select("app_id", F.col("a").alias("declared")), rows.select("app_id", F.col("b").alias("declared"))


@rule(
    "V21", "app_keeps_pages",
    f"WITH {PAGES} SELECT 100000 + k AS app_id, NULL AS region, sum(b) AS detail FROM pages WHERE k % 50 <> 3 AND k % 30 <> 0 GROUP BY k HAVING sum(b) >= 5 AND sum(a) = 0",
)
def _v21(spark: SparkSession, sf: str) -> DataFrame:
    newer, older = page_counts(spark, sf)
    return quality.app_keeps_pages(newer, older, config(spark, sf))


@rule(
    "V22", "snapshot_keeps_pages",
    f"WITH {PAGES}, t AS (SELECT sum(b)::BIGINT AS o, sum(a)::BIGINT AS n FROM pages) SELECT NULL AS app_id, NULL AS region, o || '>' || n AS detail FROM t WHERE o >= 20 AND n < floor(o * 0.6)",
)
def _v22(spark: SparkSession, sf: str) -> DataFrame:
    newer, older = page_counts(spark, sf)
    return quality.snapshot_keeps_pages(newer, older)


@query(
    "validate_snapshot",
    "V01",
    f"""WITH {OBS}, c AS (SELECT * FROM cell WHERE snap = 'after'), o AS (SELECT * FROM obs WHERE snap = 'after'),
    k AS (SELECT app_id, region, CASE WHEN product_id IS NOT NULL THEN product_id ELSE name || chr(0) || price END AS key, count(*) AS n FROM o GROUP BY ALL)
    SELECT 'V13' AS rule, app_id, count(*) AS rows FROM c WHERE status NOT IN {SAFE_EMPTY} AND status NOT LIKE 'ok-%' GROUP BY ALL
    UNION ALL SELECT 'V20', app_id, count(*) FROM k WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT 'V12', app_id, 1 FROM c GROUP BY app_id HAVING count(*) <> (SELECT count(*) FROM market)""",
)
def _validate(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over the newer snapshot, which breaks three of them."""
    candidate, configured, previous = snapshot_tables(spark, sf)
    found = quality.validate_snapshot(candidate, configured, previous)
    return found.groupBy("rule", "app_id").agg(n_rows())


def snapshot_tables(spark: SparkSession, sf: str) -> tuple[dict, dict, dict]:
    """The fixture's newer snapshot as a candidate, its configuration and the older one.

    Cells and items are stored, since nearly every rule reads them.
    """
    cells = stored(fx.cells(spark, sf))
    newer = cells.filter("snap = 'after'")
    names = newer.select("app_id").distinct().withColumn("ord", F.col("app_id").cast("bigint"))
    apps = names.select(
        "app_id", "ord", F.concat(F.lit("App "), "app_id").alias("matched_name"), F.lit("Maker").alias("developer"),
        F.lit("icon").alias("icon"), F.lit("app-store").alias("price_source"), F.lit("Games").alias("category"),
        F.lit("游戏").alias("catalog_group"),
    )
    settings = names.select(
        "app_id", "ord", F.lit(None).cast("string").alias("price_source"),
        F.lit(None).cast("string").alias("catalog_group"), F.lit(False).alias("allow_all_empty"),
    )
    declared = F.col("item_count").alias("declared")
    markets = fx.markets(spark, sf).select("ord", "region")
    header = fx.table(spark, sf, "lineitem").agg(F.max("l_shipdate").cast("string").alias("generated_at")).withColumn(
        "source", F.lit(quality.SOURCE)
    )
    candidate = {
        "header": header, "apps": apps, "regions": markets, "deferred": apps.filter("ord < 0").select("app_id"),
        "cells": newer.select("app_id", "region", F.col("ord").alias("place"), "status", declared, F.col("item_count").alias("actual")),
        "items": stored(fx.observations(spark, sf).filter("snap = 'after'")),
    }
    previous = {"apps": settings, "cells": cells.filter("snap = 'before'").select("app_id", declared)}
    return candidate, {"apps": settings, "regions": markets}, previous
