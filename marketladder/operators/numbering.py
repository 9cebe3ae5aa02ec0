"""Ordered numbering that survives hot groups.

``row_number`` over a group puts the whole group into one task.  Here a group
is cut into ranges of its order key first: rows are numbered inside a range and
the number of rows in the earlier ranges, taken from a small pre-aggregated
table, is added.  The result equals ``row_number - 1``; a range holds at most
``width`` distinct order keys however large the group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE = "__range"
BEFORE = "__before"
STRETCH = 4096


def number_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    out: str,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """0-based number of each row of ``keys`` in ``order``.

    ``bucket`` must not decrease along ``order``.  ``per_key`` is an optional
    table with one row per key whose columns are added to every row; it is
    joined to the small range table, so a hot key stays spread over its ranges.
    """
    keys = list(keys)
    rows = df.withColumn(RANGE, bucket)
    ranges = rows.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = _offsets(ranges, keys) if keys else _offsets_of_all(ranges)
    if per_key is not None:
        offsets = offsets.join(per_key, keys, "left")
    local = F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*order))
    numbered = rows.withColumn("__local", local)
    return (
        numbered.join(offsets, [*keys, RANGE])
        .withColumn(out, (F.col("__local") - 1 + F.col(BEFORE)).cast("bigint"))
        .drop(RANGE, BEFORE, "__local")
    )


def _offsets(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the earlier ranges of each key."""
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(*keys, RANGE, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias(BEFORE))


def _offsets_of_all(ranges: DataFrame) -> DataFrame:
    """The same without a key: ranges are summed within stretches of ranges first.

    The one task that orders everything sees a row for each ``STRETCH`` ranges.
    """
    cut = ranges.withColumn("__stretch", F.floor(F.col(RANGE) / F.lit(STRETCH)))
    inside = Window.partitionBy("__stretch").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = cut.groupBy("__stretch").agg(F.sum("__rows").alias("__all"))
    before = stretches.select("__stretch", F.coalesce(F.sum("__all").over(whole), F.lit(0)).alias("__first"))
    placed = cut.withColumn("__inside", F.coalesce(F.sum("__rows").over(inside), F.lit(0))).join(before, "__stretch")
    return placed.select(RANGE, (F.col("__first") + F.col("__inside")).alias(BEFORE))


def position_range(pos: str | Column, width: int = 65_536) -> Column:
    """Range number of a position column."""
    column = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(column / F.lit(width)).cast("bigint")
