"""Rows of a cell: cleaning, de-duplication, numbering, occurrences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketladder.functions.amounts import numeric_price
from marketladder.functions.status import is_reusable
from marketladder.functions.text import strip
from marketladder.operators.numbering import number_in_group, position_range

CELL = ("app_id", "region")


def normalize_items(items: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Trim, drop blanks, keep the first of each (name, price) in page order.

    A hash aggregate with map-side combine; a hot cell never meets in one task.
    """
    return (
        items.select(*cell, "pos", strip(F.col("name")).alias("name"), strip(F.col("price")).alias("price"))
        .filter((F.col("name") != "") & (F.col("price") != ""))
        .groupBy(*cell, "name", "price")
        .agg(F.min("pos").alias("pos"))
    )


def exclude_items(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop names listed for an app (``excluded``: app_id, name), any case."""
    listed = excluded.select("app_id", F.lower("name").alias("__name")).distinct()
    return items.withColumn("__name", F.lower("name")).join(listed, ["app_id", "__name"], "left_anti").drop("__name")


def dedupe_by_product(items: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """First row of each product in a cell.

    ``row_number() = 1`` becomes a group limit before the shuffle, so a product
    repeated millions of times sends one row per input partition.
    """
    order = Window.partitionBy(*cell, "product_id").orderBy("pos", "price", "name")
    return (
        items.filter(F.col("product_id").isNotNull())
        .withColumn("__first", F.row_number().over(order))
        .filter(F.col("__first") == 1)
        .drop("__first")
    )


def one_per_product(items: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """First row of each product in a cell, and all rows without a product id, in one pass.

    A row without a product id is a group of its own, by its position.
    """
    own = F.coalesce(F.concat(F.lit("p"), "product_id"), F.concat(F.lit("#"), F.col("pos").cast("string")))
    order = Window.partitionBy(*cell, "__own").orderBy("pos", "price", "name")
    first = items.withColumn("__own", own).withColumn("__first", F.row_number().over(order))
    return first.filter((F.col("__first") == 1) | F.col("product_id").isNull()).drop("__own", "__first")


def occurrence_number(
    items: DataFrame, cell: Sequence[str] = CELL, pos_range: Column | None = None
) -> DataFrame:
    """0-based number of an item among same-named rows of its cell."""
    return number_in_group(
        items, [*cell, "name"], ["pos"], position_range("pos") if pos_range is None else pos_range, "occurrence"
    )


def max_occurrences(items: DataFrame, app: Sequence[str] = ("app_id",)) -> DataFrame:
    """Per app and name: largest count in any market and the place first seen.

    Needs ``ord`` (market order) and ``pos``.  Rows shrink to one per market
    before the second grouping.
    """
    per_market = items.groupBy(*app, "region", "ord", "name").agg(
        F.count(F.lit(1)).alias("__n"), F.min("pos").alias("__pos")
    )
    return (
        per_market.groupBy(*app, "name")
        .agg(F.max("__n").alias("max_count"), F.min(F.struct("ord", "__pos")).alias("__seen"))
        .select(
            *app, "name", "max_count",
            F.col("__seen.ord").alias("first_ord"), F.col("__seen.__pos").alias("first_pos"),
        )
    )


def price_ratio_median(numbered: DataFrame, app: Sequence[str] = ("app_id",)) -> DataFrame:
    """Upper median over markets of price(j-th) / price(first) per name.

    ``numbered`` comes from ``occurrence_number``.  A list holds one ratio per
    market, so its length is bounded by the market dimension.
    """
    priced = numbered.select(
        *app, "region", "name", "occurrence", numeric_price(F.col("price")).alias("__amount")
    ).filter(F.col("__amount") != 0)
    base = priced.filter(F.col("occurrence") == 0).select(
        *app, "region", "name", F.col("__amount").alias("__base")
    )
    ratios = F.sort_array(F.collect_list(F.col("__amount") / F.col("__base")))
    return (
        priced.filter(F.col("occurrence") > 0)
        .join(base, [*app, "region", "name"])
        .groupBy(*app, "name", "occurrence")
        .agg(ratios.alias("__ratios"))
        .select(
            *app, "name", "occurrence",
            F.element_at("__ratios", (F.floor(F.size("__ratios") / 2) + 1).cast("int")).alias("ratio"),
        )
    )


def select_reusable(previous: DataFrame, tasks: DataFrame) -> DataFrame:
    """Which (app, market) tasks can reuse the previous cell.

    ``tasks``: app_id, region, has_exclusions, has_regional_id.  The result has
    a ``reuse`` flag; the rest has to be fetched.
    """
    known = previous.select("app_id", "region", is_reusable(F.col("status"), F.col("item_count")).alias("__safe"))
    free = ~F.col("has_exclusions") & ~F.col("has_regional_id")
    return tasks.join(known, ["app_id", "region"], "left").select(
        *tasks.columns, (free & F.coalesce("__safe", F.lit(False))).alias("reuse")
    )
