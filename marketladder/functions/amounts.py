"""Localized price text to numbers, and numbers to the base currency.

Everything here is a native column expression and stays inside whole-stage
code generation.  Money is a double and is only rounded by ``round_cny``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Currencies whose lone comma is always the decimal mark, and
# currencies written without decimals.
DECIMAL_COMMA_CURRENCIES = ["EUR", "TRY", "BRL"]
ZERO_DECIMAL_CURRENCIES = ["VND", "JPY", "KRW", "IDR"]

EPSILON = 2.0**-52


# The steps below rewrite the text one after the other and use the text before
# only once each, so a row costs a handful of replacements.  A decimal mark is
# noted as d (it was a dot) or c (it was a comma), x makes the text no number.


def _kept(text: Column) -> Column:
    """Only digits, dots and commas; x if nothing is left."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.,]", "")
    return F.regexp_replace(kept, "^$", "x")


def _lone_comma_after_thousands(kept: Column) -> Column:
    """A lone comma is the decimal mark when exactly two digits follow."""
    return F.regexp_replace(F.regexp_replace(kept, "^[0-9,]*,[0-9]*,[0-9]{2}$", "x"), "^([0-9]*),([0-9]{2})$", "$1c$2")


def _lone_comma_is_decimal(kept: Column) -> Column:
    """A lone comma is always the decimal mark."""
    return F.regexp_replace(F.regexp_replace(kept, "^[0-9,]*,[0-9]*,[0-9]*$", "x"), "^([0-9]*),([0-9]*)$", "$1c$2")


def _amount(text: Column, lone_comma: Callable[[Column], Column] = _lone_comma_after_thousands) -> Column:
    """Amount of a text: one match reads the usual forms, the steps read all others.

    The usual forms have no mark, or one mark before two digits, which is
    decimal, or one before three, which is dropped.
    """
    usual = F.translate(F.regexp_extract(text, r"^[^0-9.,]*([0-9]+(?:[.,][0-9]{2})?)[^0-9.,]*$", 1), ",", ".")
    marks = "[.,]" if lone_comma is _lone_comma_after_thousands else "[.]"
    grouped = F.translate(F.regexp_extract(text, f"^[^0-9.,]*([0-9]+{marks}[0-9]{{3}})[^0-9.,]*$", 1), ".,", "")
    return F.coalesce(usual.try_cast("double"), grouped.try_cast("double"), _stepwise(_kept(text), lone_comma))


def _stepwise(kept: Column, lone_comma: Callable[[Column], Column]) -> Column:
    """Find the decimal mark, drop the other marks, and read the number."""
    both = F.regexp_replace(kept, "^([0-9.,]*,[0-9.,]*)[.]([0-9]*)$", "$1d$2")
    both = F.regexp_replace(both, "^([0-9.,]*[.][0-9.,]*),([0-9]*)$", "$1c$2")
    comma = lone_comma(both)
    dot = F.regexp_replace(F.regexp_replace(comma, "^[0-9.]*[.][0-9]*[.][0-9]{2}$", "x"), "^([0-9]*)[.]([0-9]{2})$", "$1d$2")
    # The decimal sign twice, or no digit beside it, is no number.
    marked = F.regexp_replace(dot, "^(?:.*[.].*d.*|.*,.*c.*|[^0-9]*[cd][^0-9]*)$", "x")
    return F.concat(F.lit("0"), F.translate(marked, "cd.,", "..")).try_cast("double")


def numeric_price(text: Column) -> Column:
    """Amount without knowing the currency (used for price ratios)."""
    return _amount(text)


def parse_localized_amount(text: Column, currency: Column) -> Column:
    """Amount of a localized price text; null when it is not a number.

    Indonesian prices may be written in thousands or millions; there dots only
    group and a comma is the decimal mark.
    """
    digits = F.regexp_replace(F.translate(_kept(text), ",.", "."), "^[.]+$", "x")
    scaled = F.concat(F.lit("0"), digits).try_cast("double")
    unit = F.when(text.rlike("(?iu)juta"), F.lit(1e6)).otherwise(F.lit(1e3))
    in_words = (currency == "IDR") & text.rlike("(?iu)ribu|juta")
    return F.when(in_words, scaled * unit).otherwise(_amount(text))


def numeric_amount(text: Column, currency: Column) -> Column:
    """Currency-aware amount of a canonical price text taken from a page."""
    whole = F.concat(F.lit("0"), F.translate(_kept(text), ".,", "")).try_cast("double")
    return (
        F.when(currency.isin(ZERO_DECIMAL_CURRENCIES), whole)
        .when(currency.isin(DECIMAL_COMMA_CURRENCIES), _amount(text, _lone_comma_is_decimal))
        .otherwise(_amount(text))
    )


def to_base_currency(amount: Column, units: Column) -> Column:
    """``amount / units``; null unless the rate is finite and positive."""
    usable = units.isNotNull() & ~F.isnan(units) & (units > 0) & (units < float("inf"))
    return F.when(usable, F.try_divide(amount, units))


def round_cny(value: Column) -> Column:
    """Two decimals, halves upwards, the same in every engine."""
    return F.floor((value + F.lit(EPSILON)) * 100 + 0.5).cast("double") / F.lit(100.0)
