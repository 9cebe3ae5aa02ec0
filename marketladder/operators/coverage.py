"""How much of the catalog each market shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marketladder.functions.status import evidence_state

# Evidence states and the columns they are counted in.
STATES = {"verified": "verified", "unavailable": "unavailable", "not-public": "not_public", "review": "review"}


def coverage_summary(cells: DataFrame, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """Counts of the evidence states per app, and a total row (null keys)."""
    state = evidence_state(F.col("status"), F.col("item_count"))
    counts = [F.count(F.when(state == name, 1)).alias(column) for name, column in STATES.items()]
    return cells.rollup(F.struct(*keys).alias("k")).agg(*counts, F.count(F.lit(1)).alias("total")).select(
        *[F.col(f"k.{k}").alias(k) for k in keys], *STATES.values(), "total"
    )


def item_range(cells: DataFrame, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """Smallest and largest item count over markets with prices, 0 without any."""
    shown = F.when(F.col("status").startswith("ok-") & (F.col("item_count") > 0), F.col("item_count"))
    zero = F.lit(0).cast("bigint")
    return cells.groupBy(*keys).agg(
        F.coalesce(F.min(shown), zero).alias("min_items"), F.coalesce(F.max(shown), zero).alias("max_items")
    )
