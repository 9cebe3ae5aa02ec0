import random
import re

from pyspark.sql import functions as F

from marketladder.functions import amounts


def number(text):
    if text == "":
        return 0.0
    return float(text) if re.fullmatch(r"\d+\.?\d*|\.\d+", text) else None


def plain(text, comma_is_decimal=False):
    """The rule in words, on one text: the later mark is the decimal mark."""
    kept = re.sub(r"[^0-9.,]", "", text)
    if not kept:
        return None
    comma, dot = kept.rfind(","), kept.rfind(".")
    if comma >= 0 and dot >= 0:
        mark, other = (",", ".") if comma > dot else (".", ",")
        return number(kept.replace(other, "").replace(mark, ".", 1))
    if comma >= 0:
        decimal = comma_is_decimal or len(kept) - comma == 3
        return number(kept.replace(",", ".", 1) if decimal else kept.replace(",", ""))
    if dot >= 0 and len(kept) - dot != 3:
        return number(kept.replace(".", ""))
    return number(kept)


def localized(text, currency):
    kept = re.sub(r"[^0-9.,]", "", text)
    if kept and currency == "IDR" and re.search("ribu|juta", text, re.I):
        value = number(kept.replace(".", "").replace(",", ".", 1))
        return None if value is None else value * (1e6 if re.search("juta", text, re.I) else 1e3)
    return plain(text)


def numeric(text, currency):
    kept = re.sub(r"[^0-9.,]", "", text)
    if kept and currency in ("VND", "JPY", "KRW", "IDR"):
        return number(re.sub("[.,]", "", kept))
    return plain(text, currency in ("EUR", "TRY", "BRL"))


def test_known_amounts(spark):
    cases = [
        ("Rp 349ribu", "IDR", 349_000.0), ("Rp 3,499juta", "IDR", 3_499_000.0), ("4.999.000đ", "VND", 4_999_000.0),
        ("€9,99", "EUR", 9.99), ("Rp 69.000", "IDR", 69_000.0), ("$9.9", "USD", 99.0), ("Rs.13.99", "INR", None),
        ("Rs.139", "INR", 139.0), ("1,234.56", "USD", 1234.56), ("1.234,56", "EUR", 1234.56), ("free", "USD", None),
        ("$", "USD", None), (None, "USD", None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, c string")
    got = [r.a for r in df.select(amounts.parse_localized_amount(F.col("t"), F.col("c")).alias("a")).collect()]
    assert got == [c[2] for c in cases]


def test_random_texts_agree_with_the_rule(spark):
    rng = random.Random(7)
    texts = [
        ("".join(rng.choice("0123456789..,,  $R") for _ in range(rng.randint(0, 9))) + rng.choice(["", "", "ribu", "JUTA"]),
         rng.choice(["USD", "IDR", "EUR", "JPY"]))
        for _ in range(20_000)
    ]
    text, currency = F.col("t"), F.col("c")
    df = spark.createDataFrame(texts, "t string, c string").select(
        "t", "c", amounts.parse_localized_amount(text, currency).alias("a"),
        amounts.numeric_amount(text, currency).alias("b"), amounts.numeric_price(text).alias("p"),
    )
    wrong = [r for r in df.collect() if (r.a, r.b, r.p) != (localized(r.t, r.c), numeric(r.t, r.c), plain(r.t))]
    assert wrong == []


def test_rounding_and_unusable_rates(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (10.0,)], "x double")
    assert [r[0] for r in df.select(amounts.round_cny(F.col("x"))).collect()] == [1.01, 2.68, 10.0]
    rates = spark.createDataFrame([(0.0,), (-1.0,), (float("inf"),), (float("nan"),), (None,), (2.0,)], "u double")
    got = [r[0] for r in rates.select(amounts.to_base_currency(F.lit(10.0), F.col("u"))).collect()]
    assert got == [None, None, None, None, None, 5.0]
