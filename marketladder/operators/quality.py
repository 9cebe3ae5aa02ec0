"""Rules a candidate snapshot must pass before it is published.

Every rule returns its violations as rows (rule, app_id, region, detail); all
rules are collected and any row fails the gate.  Ordered lists are compared
place by place with joins, never by gathering a list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketladder.functions.status import SAFE_EMPTY
from marketladder.functions.text import catalog_group
from marketladder.operators.numbering import number_in_group, position_range

# The source text, and the limits of the two drop rules.
SOURCE = "Apple public App Store product and service pricing pages"
POPULATED_APP, POPULATED_TOTAL, KEPT_SHARE = 5, 20, 0.6


def _found(df: DataFrame, rule: str, condition: Column | None, detail: Column | None = None) -> DataFrame:
    """Violation rows of one rule."""
    rows = df if condition is None else df.filter(F.coalesce(condition, F.lit(False)))
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(rule).alias("rule"),
        (F.col("app_id") if "app_id" in df.columns else none).alias("app_id"),
        (F.col("region") if "region" in df.columns else none).alias("region"),
        (none if detail is None else detail.cast("string")).alias("detail"),
    )


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _allowed_empty() -> Column:
    return F.coalesce(F.col("status").isin(SAFE_EMPTY), F.lit(False))


def _populated_status() -> Column:
    return F.coalesce(F.col("status").startswith("ok-"), F.lit(False))


# Snapshot header: generated_at text, source.


def snapshot_time_parses(header: DataFrame) -> DataFrame:
    parsed = F.try_to_timestamp(F.col("generated_at"))
    return _found(header, "V01", parsed.isNull(), F.col("generated_at"))


def source_is_expected(header: DataFrame) -> DataFrame:
    return _found(header, "V02", F.coalesce(F.col("source"), F.lit("")) != SOURCE, F.col("source"))


# Apps: deferred (app_id), config (app_id, ord), published (app_id, ord).


def deferred_are_configured(deferred: DataFrame, config: DataFrame) -> DataFrame:
    return _found(deferred.join(config.select("app_id"), "app_id", "left_anti").distinct(), "V03", None)


def deferred_were_unpublished(deferred: DataFrame, previous: DataFrame) -> DataFrame:
    return _found(deferred.join(previous.select("app_id"), "app_id", "left_semi").distinct(), "V04", None)


def published_match_config(published: DataFrame, config: DataFrame, deferred: DataFrame) -> DataFrame:
    """Published ids equal the configured ones without the deferred, in order."""
    wanted = config.join(deferred.select("app_id"), "app_id", "left_anti")
    expected = number_in_group(wanted, [], ["ord"], position_range("ord"), "place").select(
        "place", F.col("app_id").alias("expected_id")
    )
    actual = number_in_group(published, [], ["ord"], position_range("ord"), "place").select(
        "place", F.col("app_id").alias("actual_id")
    )
    joined = actual.join(expected, "place", "full").withColumn("app_id", F.coalesce("actual_id", "expected_id"))
    differs = ~F.col("actual_id").eqNullSafe(F.col("expected_id"))
    return _found(joined, "V05", differs, F.concat(F.lit("place "), F.col("place").cast("string")))


# Markets: configured (ord, region), listed (ord, region).


def regions_exist(configured: DataFrame, configurations: DataFrame | None = None) -> DataFrame:
    """A configuration without any market; ``configurations`` lists several by ``app_id``."""
    if configurations is not None:
        return _found(configurations.join(configured.select("app_id").distinct(), "app_id", "left_anti"), "V06", None)
    empty = configured.agg(F.count(F.lit(1)).alias("n"))
    return _found(empty, "V06", F.col("n") == 0)


def regions_are_unique(configured: DataFrame) -> DataFrame:
    return _found(configured.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "V07", F.col("n") > 1, F.col("n"))


def listed_regions_match(configured: DataFrame, listed: DataFrame) -> DataFrame:
    want = configured.select("ord", F.col("region").alias("want"))
    have = listed.select("ord", F.col("region").alias("have"))
    joined = want.join(have, "ord", "full").withColumn("region", F.coalesce("have", "want"))
    return _found(joined, "V08", ~F.col("want").eqNullSafe(F.col("have")), F.col("ord"))


# Published apps with metadata joined to their configuration.


def metadata_is_complete(apps: DataFrame) -> DataFrame:
    needs_icon = F.coalesce(F.col("price_source") != "apple-service", F.lit(True))
    bad = _blank("matched_name") | _blank("developer") | (needs_icon & _blank("icon"))
    return _found(apps, "V09", bad)


def price_source_matches(apps: DataFrame, config: DataFrame) -> DataFrame:
    wanted = config.select("app_id", F.coalesce("price_source", F.lit("app-store")).alias("__want"))
    joined = apps.join(wanted, "app_id")
    return _found(joined, "V10", ~F.col("price_source").eqNullSafe(F.col("__want")), F.col("price_source"))


def group_matches(apps: DataFrame, config: DataFrame) -> DataFrame:
    joined = apps.join(config.select("app_id", F.col("catalog_group").alias("__explicit")), "app_id")
    wanted = catalog_group(F.col("category"), F.col("__explicit"))
    return _found(joined, "V11", ~F.col("catalog_group").eqNullSafe(wanted), F.col("catalog_group"))


def app_regions_match(cells: DataFrame, configured: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """Every app lists all markets in order (``place`` is the listed position).

    With ``apps``, an app without any market row is reported too.

    Counted, not gathered: all places agree and there are as many as configured.
    """
    want = configured.select(F.col("ord").alias("place"), F.col("region").alias("__want"))
    total = configured.agg(F.count(F.lit(1))).scalar()
    checked = cells.join(want, "place", "left").groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("region") == F.col("__want"), 1)).alias("agreeing"),
    )
    if apps is not None:
        checked = apps.select("app_id").join(checked, "app_id", "left").na.fill(0, ["n", "agreeing"])
    bad = (F.col("n") != F.col("total")) | (F.col("agreeing") != F.col("total"))
    return _found(checked.withColumn("total", total), "V12", bad, F.col("agreeing"))


# Cells: status, declared and actual item count.


def status_is_safe(cells: DataFrame) -> DataFrame:
    return _found(cells, "V13", ~_allowed_empty() & ~_populated_status(), F.col("status"))


def count_matches(cells: DataFrame) -> DataFrame:
    return _found(cells, "V14", ~F.col("declared").eqNullSafe(F.col("actual")), F.col("declared"))


def _countable(cells: DataFrame) -> DataFrame:
    """Later cell rules only look at cells whose counts agree."""
    return cells.filter(F.col("declared") == F.col("actual"))


def ok_has_items(cells: DataFrame) -> DataFrame:
    return _found(_countable(cells), "V15", _populated_status() & (F.col("actual") == 0), F.col("status"))


def empty_has_none(cells: DataFrame) -> DataFrame:
    return _found(_countable(cells), "V16", _allowed_empty() & (F.col("actual") > 0), F.col("status"))


# Items: name, price, product_id and the status of their cell.


def _no_text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).rlike(r"(?U)^[\s\uFEFF]*$")


def items_are_named(items: DataFrame) -> DataFrame:
    return _found(items, "V17", _no_text("name") | _no_text("price"), F.col("pos"))


def price_has_digit(items: DataFrame) -> DataFrame:
    named = ~_no_text("name") & ~_no_text("price")
    return _found(items, "V18", named & ~F.col("price").rlike("[0-9]"), F.col("price"))


def product_id_is_valid(items: DataFrame) -> DataFrame:
    valid = F.coalesce(F.col("product_id"), F.lit("")).rlike("^[0-9]{6,15}$")
    return _found(items, "V19", (F.col("status") == "ok-structured") & ~valid, F.col("name"))


def items_are_unique(items: DataFrame) -> DataFrame:
    """One row per (product id, else name and price) that occurs again in its cell."""
    has_id = ~_blank("product_id")
    key = F.when(has_id, F.concat(F.lit("product:"), "product_id")).otherwise(
        F.concat(F.lit("legacy:"), "name", F.lit("\u0000"), "price")
    )
    counted = items.withColumn("__key", key).groupBy("app_id", "region", "__key").agg(F.count(F.lit(1)).alias("n"))
    return _found(counted, "V20", F.col("n") > 1, F.col("n"))


# Drops against the previous snapshot; both sides are cell tables with declared.


def populated_pages(cells: DataFrame, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """Markets with items, per app or (no keys) for the snapshot."""
    return cells.groupBy(*keys).agg(F.count(F.when(F.col("declared") > 0, 1)).alias("populated"))


def app_keeps_pages(cells: DataFrame, previous: DataFrame, config: DataFrame) -> DataFrame:
    """An app with five or more populated markets does not drop to none."""
    old = populated_pages(previous).withColumnRenamed("populated", "__old")
    strict = config.filter(~F.coalesce("allow_all_empty", F.lit(False))).select("app_id")
    joined = populated_pages(cells).join(old, "app_id").join(strict, "app_id", "left_semi")
    return _found(joined, "V21", (F.col("__old") >= POPULATED_APP) & (F.col("populated") == 0), F.col("__old"))


def snapshot_keeps_pages(cells: DataFrame, previous: DataFrame) -> DataFrame:
    """All populated pages do not fall below 60 % of the previous number."""
    old = populated_pages(previous, ()).select("populated").scalar()
    joined = populated_pages(cells, ()).withColumn("__old", old)
    bad = (F.col("__old") >= POPULATED_TOTAL) & (F.col("populated") < F.floor(F.col("__old") * KEPT_SHARE))
    return _found(joined, "V22", bad, F.concat_ws(">", F.col("__old").cast("string"), F.col("populated").cast("string")))


def validate_snapshot(
    candidate: dict[str, DataFrame], config: dict[str, DataFrame], previous: dict[str, DataFrame] | None
) -> DataFrame:
    """Violations of all rules.

    candidate: header, apps, regions, cells, items, deferred; config: apps,
    regions; previous: apps, cells (or None for a first run).
    """
    c, k = candidate, config
    parts = [
        snapshot_time_parses(c["header"]),
        source_is_expected(c["header"]),
        deferred_are_configured(c["deferred"], k["apps"]),
        published_match_config(c["apps"], k["apps"], c["deferred"]),
        regions_exist(k["regions"]),
        regions_are_unique(k["regions"]),
        listed_regions_match(k["regions"], c["regions"]),
        metadata_is_complete(c["apps"]),
        price_source_matches(c["apps"], k["apps"]),
        group_matches(c["apps"], k["apps"]),
        app_regions_match(c["cells"], k["regions"], c["apps"]),
        status_is_safe(c["cells"]),
        count_matches(c["cells"]),
        ok_has_items(c["cells"]),
        empty_has_none(c["cells"]),
        items_are_named(c["items"]),
        price_has_digit(c["items"]),
        product_id_is_valid(c["items"]),
        items_are_unique(c["items"]),
    ]
    if previous is not None:
        parts += [
            deferred_were_unpublished(c["deferred"], previous["apps"]),
            app_keeps_pages(c["cells"], previous["cells"], k["apps"]),
            snapshot_keeps_pages(c["cells"], previous["cells"]),
        ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
