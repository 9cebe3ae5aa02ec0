"""Plans of an app: curated definitions plus everything found in its items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketladder.functions.plans import (
    MONTH,
    PUBLIC,
    YEAR,
    canonical_period,
    display_group,
    infer_period,
    plan_id,
    strict_period,
)
from marketladder.operators.items import max_occurrences, price_ratio_median
from marketladder.operators.numbering import number_in_group, position_range
from marketladder.session import stored

IDENTITY = ["product_id", "offer_name", "billing_period", "family_id"]


def alias_group(aliases: Column) -> Column:
    """One key for a set of names; plans with the same names share numbering."""
    return F.array_join(F.array_sort(F.array_distinct(aliases)), "\u0000")


def plan_aliases(plans: DataFrame) -> DataFrame:
    """app_id, plan_id, alias_pos, alias: one row per plan and name."""
    return plans.select("app_id", "plan_id", F.posexplode("aliases").alias("alias_pos", "alias"))


def items_by_alias(items: DataFrame, plans: DataFrame, pos_range: Column | None = None) -> DataFrame:
    """Items carrying one of a plan's names, numbered per market and name set.

    Plans are joined later on (name set, number), an equi join; pairing every
    plan with every item of its names would be quadratic.
    """
    names = plans.select("app_id", alias_group(F.col("aliases")).alias("alias_group"), F.explode("aliases").alias("name"))
    return number_in_group(
        items.join(names.distinct(), ["app_id", "name"]),
        ["app_id", "region", "alias_group"],
        ["pos"],
        position_range("pos") if pos_range is None else pos_range,
        "alias_number",
    )


def duplicate_alias_plans(curated: DataFrame) -> DataFrame:
    """Curated plans that share a name with another plan of the app."""
    names = plan_aliases(curated)
    shared = names.groupBy("app_id", "alias").count().filter("count > 1").drop("count")
    return names.join(shared, ["app_id", "alias"], "left_semi").select("app_id", "plan_id").distinct()


def number_ambiguous_labels(plans: DataFrame, order: list[Column], bucket: Column) -> DataFrame:
    """Append " #n" where (label, period) occurs more than once in an app."""
    totals = plans.groupBy("app_id", "label", "period").agg(F.count(F.lit(1)).alias("__total"))
    numbered = number_in_group(plans, ["app_id", "label", "period"], order, bucket, "__n", per_key=totals)
    marked = F.concat(F.col("label"), F.lit(" #"), (F.col("__n") + 1).cast("string"))
    return numbered.withColumn("label", F.when(F.col("__total") > 1, marked).otherwise(F.col("label"))).drop(
        "__total", "__n"
    )


def _inferred_periods(found: DataFrame, numbered: DataFrame, curated: DataFrame) -> DataFrame:
    """Period of each found plan; names known to the curated list may use ratios."""
    known = curated.select("app_id", F.explode("aliases").alias("name")).distinct().withColumn("__known", F.lit(True))
    annual = price_ratio_median(numbered.join(known.drop("__known"), ["app_id", "name"], "left_semi")).filter(
        F.col("ratio").between(6, 15)
    )
    later = annual.select("app_id", "name", "occurrence", F.lit(True).alias("__annual"))
    first = annual.select("app_id", "name").distinct().withColumn("__monthly", F.lit(True))
    by_name = infer_period(F.col("name"))
    return (
        found.join(later, ["app_id", "name", "occurrence"], "left")
        .join(first, ["app_id", "name"], "left")
        .withColumn(
            "period",
            F.when(by_name != PUBLIC, by_name)
            .when((F.col("occurrence") == 0) & F.col("__monthly"), MONTH)
            .when((F.col("occurrence") > 0) & F.col("__annual"), YEAR)
            .otherwise(PUBLIC),
        )
        .drop("__annual", "__monthly")
    )


def usable_curated(numbered: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated plans for which some market shows enough items."""
    names = curated.select("app_id", "plan_id", "occurrence", F.explode("aliases").alias("name"))
    present = numbered.select("app_id", "name", "occurrence").distinct()
    enough = names.join(present, ["app_id", "name", "occurrence"], "left_semi").select("app_id", "plan_id").distinct()
    return curated.join(enough, ["app_id", "plan_id"], "left_semi")


def discover_plans(
    numbered: DataFrame,
    curated: DataFrame,
    anchor: Column,
    pos_range: Column | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Curated plans with enough items, then one plan per uncovered item number.

    ``numbered``: items with app_id, region, ord, pos, name, price, occurrence
    and identity columns.  ``curated``: app_id, plan_id, label, period,
    aliases, occurrence, curated_ord.  ``anchor``: condition selecting the rows
    of the anchor market.  Both tables are read several times, so pass tables
    that are stored.
    """
    kept = usable_curated(numbered, curated)
    covered = kept.select("app_id", F.explode("aliases").alias("name"), "occurrence")
    seen = max_occurrences(numbered).select("app_id", "name", "first_ord", "first_pos")
    found = (
        numbered.select("app_id", "name", "occurrence")
        .distinct()
        .join(covered, ["app_id", "name", "occurrence"], "left_anti")
    )
    found = _inferred_periods(found, numbered, curated).join(seen, ["app_id", "name"])
    automatic = found.select(
        "app_id",
        plan_id(F.col("name"), F.col("occurrence"), normalize).alias("plan_id"),
        F.col("name").alias("label"),
        "period",
        F.array("name").alias("aliases"),
        "occurrence",
        F.lit(True).alias("discovered"),
        F.lit(0).cast("bigint").alias("curated_ord"),
        "first_ord",
        "first_pos",
    )
    listed = kept.select(
        "app_id", "plan_id", "label", "period", "aliases", F.col("occurrence").cast("bigint").alias("occurrence"),
        F.lit(False).alias("discovered"), F.col("curated_ord").cast("bigint").alias("curated_ord"),
        F.lit(0).cast("bigint").alias("first_ord"), F.lit(0).cast("bigint").alias("first_pos"),
    )
    plans = stored(enrich_display(listed.unionByName(automatic), numbered.filter(anchor), pos_range))
    return number_ambiguous_labels(plans, *plan_order())


def plan_order() -> tuple[list[Column], Column]:
    """Order of an app's plans, and the ranges it is numbered in: curated ones, then as they first occur.

    Discovered plans are cut by the market and the range of positions they
    first occur in, so the plans of a large app stay spread.
    """
    order = [F.col(c) for c in ("discovered", "curated_ord", "first_ord", "first_pos", "occurrence")]
    return order, F.when(F.col("discovered"), F.col("first_ord")).otherwise(F.lit(-1).cast("bigint"))


def enrich_display(plans: DataFrame, anchor_items: DataFrame, pos_range: Column | None = None) -> DataFrame:
    """Copy identity columns from the anchor row with the plan's name and number."""
    found = items_by_alias(anchor_items, plans, pos_range).select(
        "app_id", "alias_group", F.col("alias_number").alias("occurrence"), *IDENTITY
    )
    period = F.coalesce(canonical_period(F.col("billing_period")), F.col("period"))
    return (
        plans.withColumn("alias_group", alias_group(F.col("aliases")))
        .join(found, ["app_id", "alias_group", "occurrence"], "left")
        .withColumn("period", period)
        .withColumn("display_group", display_group(F.col("period"), F.col("label"), F.col("aliases")))
        .drop("alias_group")
    )


def enrich_strict(plans: DataFrame, anchor_items: DataFrame, normalize: bool = True) -> DataFrame:
    """Identity and period of a plan from the anchor market, strict rules.

    ``plans``: app_id, plan_id, aliases, occurrence, product_id,
    billing_period.  The anchor row is looked up by product id, else by the
    requested period, else by the first name that occurs.
    """
    wanted = canonical_period(F.col("billing_period"))
    items = anchor_items.select(
        "app_id", "name", "pos", "occurrence",
        F.col("product_id").alias("a_product"),
        canonical_period(F.col("billing_period")).alias("a_period"),
    )
    by_product = items.filter(F.col("a_product").isNotNull()).groupBy(
        F.col("app_id"), F.col("a_product").alias("product_id")
    ).agg(
        F.min(F.struct("pos", "name", "a_product", "a_period")).alias("p_row")
    )
    by_period = items.filter(F.col("a_period").isNotNull()).groupBy(
        F.col("app_id"), F.col("a_period").alias("wanted")
    ).agg(F.min(F.struct("pos", "name", "a_product", "a_period")).alias("w_row"))
    # First name of the plan that occurs at all; a single row wins whatever
    # number the plan asks for, several rows are picked by that number.
    names = plans.select("app_id", "plan_id", "occurrence", F.posexplode("aliases").alias("alias_pos", "name"))
    counts = items.groupBy("app_id", "name").agg(F.count(F.lit(1)).alias("rows"))
    chosen = names.join(counts, ["app_id", "name"]).groupBy("app_id", "plan_id", "occurrence").agg(
        F.min(F.struct("alias_pos", "name", "rows")).alias("best")
    )
    pick = F.when(F.col("best.rows") == 1, F.lit(0).cast("bigint")).otherwise(F.col("occurrence"))
    by_name = chosen.select("app_id", "plan_id", F.col("best.name").alias("name"), pick.alias("occurrence")).join(
        items, ["app_id", "name", "occurrence"]
    ).select("app_id", "plan_id", F.struct("pos", "name", "a_product", "a_period").alias("n_row"))
    row = F.when(F.col("product_id").isNotNull(), F.col("p_row")).otherwise(F.coalesce("w_row", "n_row"))
    joined = (
        plans.withColumn("wanted", wanted)
        .join(by_product, ["app_id", "product_id"], "left")
        .join(by_period, ["app_id", "wanted"], "left")
        .join(by_name, ["app_id", "plan_id"], "left")
        .withColumn("row", row)
    )
    structured = F.coalesce(F.col("wanted"), F.col("row.a_period"))
    return (
        joined.withColumn("match_period", structured)
        .withColumn("product_id", F.coalesce("product_id", "row.a_product"))
        .withColumn(
            "period", F.coalesce(structured, strict_period(F.col("row.name"), normalize), F.lit(PUBLIC))
        )
        .drop("wanted", "p_row", "w_row", "n_row", "row")
    )


def uncovered_items(numbered: DataFrame, plans: DataFrame) -> DataFrame:
    """(name, occurrence) pairs no plan stands for; empty after discovery."""
    covered = plans.select("app_id", F.explode("aliases").alias("name"), "occurrence")
    pairs = numbered.select("app_id", "name", "occurrence").distinct()
    return pairs.join(covered, ["app_id", "name", "occurrence"], "left_anti")
