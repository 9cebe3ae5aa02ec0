"""Periods, display groups and plan identifiers as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Period labels.
MONTH, YEAR, WEEK, ONCE, PUBLIC = "月付", "年付", "周付", "一次性", "公开项目"
PRIMARY_PERIODS = [MONTH, YEAR, WEEK]

# Structured period codes.
PERIOD_CODES = {
    "MONTHLY": MONTH, "P1M": MONTH,
    "YEARLY": YEAR, "ANNUAL": YEAR, "P1Y": YEAR,
    "WEEKLY": WEEK, "P1W": WEEK,
}

# Words that tell the period of a product name, loose form.
LOOSE_YEAR = r"annual|year|12(?U:\s)*month|全年|年卡|年费|年付|包年"
LOOSE_WEEK = r"weekly|week|7(?U:\s)*day|周卡|周付|一周"
LOOSE_MONTH = r"monthly|month|月卡|月费|月付|1个月|一个月|自動續費月"
LOOSE_ONCE = r"credit|star|券|boost|promote|notabot|package|礼物|加油包|次卡"

# The strict form.
STRICT_YEAR = r"annual|yearly|12(?U:\s)*month|全年|年卡|年费|年付|包年"
STRICT_MONTH = r"monthly|1(?U:\s)*month|月卡|月费|月付|包月"
STRICT_WEEK = r"weekly|1(?U:\s)*week|7(?U:\s)*day|周卡|周付"
STRICT_ONCE = r"credit|coin|gem|token|star|pack|bundle|gift|积分|金币|礼包|次卡"

# Words of subscription names and of one-off purchases.
PRIMARY_WORDS = (
    r"(?iu)(?:monthly|month|annual|yearly|year|weekly|week|subscription|membership|premium|plus|pro\+?"
    r"|family|individual|lifetime|unlimited|premiere|career|business|recruiter|navigator|classic"
    r"|essential|lite|max|ultra|会员|订阅|月付|年付|周付|包月|包年|家庭方案|个人方案)"
)
SECONDARY_WORDS = (
    r"(?iu)(?:credit|coin|gem|token|\bbits?\b|boost|star(?:s| bundle)?|pack|bundle|offer|gift|sticker"
    r"|avatar|hat|pet|skin|ticket|item|moves?|lives?|barrel|cart|chest|pok[ée]coin|keys?|gold|unlock"
    r"|worlds?|story|audio|preset|content|marketplace|snacks?|coffee|flower|meal|charged"
    r"|land on the moon|金币|宝石|积分|代币|礼包|贴纸|头像|道具|解锁)"
)


@F.pandas_udf(T.StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC; Spark has no such function."""
    for part in parts:
        yield part.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def nfkd(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKD; Spark has no such function."""
    for part in parts:
        yield part.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


# The blanks of Unicode, and the byte order mark.
BLANKS = "".join(
    chr(point)
    for point in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)


def strip(text: Column) -> Column:
    """Trim every kind of Unicode blank, not only the plain space."""
    return F.btrim(text, F.lit(BLANKS))


def canonical_period(raw: Column) -> Column:
    """Structured period code to its label, else null."""
    key = F.upper(strip(raw))
    result = F.lit(None).cast("string")
    for label in PRIMARY_PERIODS:
        codes = [code for code, value in PERIOD_CODES.items() if value == label]
        result = F.when(key.isin(codes), F.lit(label)).otherwise(result)
    return result


def first_period(*raw: Column) -> Column:
    """Period from the first field that is present (fields have three names)."""
    return canonical_period(F.coalesce(*raw))


def first_product_id(*raw: Column) -> Column:
    """Product id from the first field present; blank text counts as none."""
    value = strip(F.coalesce(*raw))
    return F.when(value != "", value)


def infer_period(name: Column) -> Column:
    """Loose period of a name: year, week, month, one-off, else public item."""
    text = F.lower(name)
    return (
        F.when(text.rlike(LOOSE_YEAR), YEAR)
        .when(text.rlike(LOOSE_WEEK), WEEK)
        .when(text.rlike(LOOSE_MONTH), MONTH)
        .when(text.rlike(LOOSE_ONCE), ONCE)
        .otherwise(PUBLIC)
    )


def strict_period(name: Column, normalize: bool = True) -> Column:
    """Strict period of a name, null when the name does not tell it."""
    text = F.lower(nfkc(name) if normalize else name)
    return (
        F.when(text.rlike(STRICT_YEAR), YEAR)
        .when(text.rlike(STRICT_MONTH), MONTH)
        .when(text.rlike(STRICT_WEEK), WEEK)
        .when(text.rlike(STRICT_ONCE), ONCE)
    )


def display_group(period: Column, label: Column, aliases: Column) -> Column:
    """``primary`` for subscriptions, ``other`` for the rest."""
    searchable = F.concat(F.coalesce(label, F.lit("")), F.lit(" "), F.array_join(aliases, " "))
    return (
        F.when(period.isin(PRIMARY_PERIODS), "primary")
        .when(period == ONCE, "other")
        .when(searchable.rlike(SECONDARY_WORDS), "other")
        .when(searchable.rlike(PRIMARY_WORDS), "primary")
        .otherwise("other")
    )


def fnv1a_base36(text: Column) -> Column:
    """32-bit FNV-1a over code points, written in base 36."""
    points = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("bigint"))
    folded = F.aggregate(
        points,
        F.lit(0x811C9DC5).cast("bigint"),
        lambda acc, point: (acc.bitwiseXOR(point) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")),
    )
    return F.lower(F.conv(folded.cast("string"), 10, 36))


def slug(name: Column, normalize: bool = True) -> Column:
    """Lower-case letters and digits joined by dashes, at most 42 characters."""
    text = F.lower(nfkd(name) if normalize else name)
    dashed = F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 42)
    return F.when(cut == "", F.lit("item")).otherwise(cut)


def plan_id(name: Column, occurrence: Column, normalize: bool = True) -> Column:
    """Stable id of the plan found for one name and occurrence."""
    hashed = fnv1a_base36(F.concat(name, F.lit("\u0000"), occurrence.cast("string")))
    return F.concat_ws("-", F.lit("auto"), slug(name, normalize), (occurrence + 1).cast("string"), hashed)
