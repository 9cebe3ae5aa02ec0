"""Working a costly value out once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out a single time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kept_apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns behind a generator, so that later steps do not repeat them."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
