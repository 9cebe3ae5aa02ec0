"""The comparison of an app's plans across markets, as one plan.

discover on the anchor market -> identity and period -> labels numbered by that
period -> strict match -> one currency -> roll-up, header and issues.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketladder.operators import matching
from marketladder.operators.numbering import number_in_group
from marketladder.operators.plans import discover_plans, enrich_strict, number_ambiguous_labels, plan_order
from marketladder.session import stored


@dataclass
class Comparison:
    """plans: with ``seq``, their order; matches: priced; rollup: with price lists; headers; issues: all of them."""

    plans: DataFrame
    matches: DataFrame
    rollup: DataFrame
    headers: DataFrame
    issues: DataFrame


def strict_plans(anchor_items: DataFrame, curated: DataFrame, pos_range: Column | None = None, normalize: bool = True) -> DataFrame:
    """Plans of the anchor market with product id, match period and labels that tell them apart."""
    found = discover_plans(anchor_items, curated, F.lit(True), pos_range, normalize)
    order, bucket = plan_order()
    labelled = number_ambiguous_labels(enrich_strict(found, anchor_items, normalize), order, bucket)
    return number_in_group(labelled, ["app_id"], order, bucket, "seq")


def compare(
    cells: DataFrame,
    items: DataFrame,
    apps: DataFrame,
    curated: DataFrame,
    markets: DataFrame,
    rates: DataFrame,
    anchor: Column,
    times: dict[str, Column],
    pos_range: Column | None = None,
) -> Comparison:
    """cells, numbered items and apps (app_id, matched_name, developer, icon, store_url, price_source) of a snapshot.

    ``items`` is read several times, so pass a stored table; ``times`` has
    ``generated_at`` and ``rates_updated_at``.
    """
    here = F.col("region") == anchor
    shown = items.join(matching.public_cells(cells).select("app_id", "region"), ["app_id", "region"], "left_semi")
    plans = stored(strict_plans(shown.filter(here), curated, pos_range))
    matches = matching.strict_match(plans, cells, items, anchor, here)
    priced = stored(matching.price_fx(matches, markets, rates).drop("issue"))
    rollup = matching.plan_rollup(plans, priced)
    headers = matching.comparison_document(cells, rollup, priced, here, markets, apps, times)
    return Comparison(plans, priced, rollup, headers, matching.review_issues(priced))
