"""Price observations derived from the star-schema test tables.

The same views exist as DuckDB text in ``oracle_base.py``.  ``pos`` is a unique
order key inside a cell (sparse, not dense), so no ranking is needed to make it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketladder.session import small_table

# Units per CNY, in market order.
RATES = {
    "CNY": 1.0, "USD": 0.148493, "HKD": 1.164103, "TWD": 4.714757, "VND": 3875.968992,
    "JPY": 23.235468, "GBP": 0.110004, "EUR": 0.128003, "CAD": 0.205345, "TRY": 7.173601,
    "AUD": 0.206808, "INR": 14.059952, "BRL": 0.758898, "IDR": 2624.671916, "MXN": 2.503129,
    "NZD": 0.253859, "AED": 0.545334, "SAR": 0.556842,
}
CURRENCIES = list(RATES)

CELL = ["snap", "app_id", "region"]

# pos = (order * 8 + line) * 2^22 + mix; this many orders share one range.
ORDERS_PER_RANGE = 4096
POS_RANGE = ORDERS_PER_RANGE * 8 * 2**22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items; how they are split is left to ``spark.sql.files.maxPartitionBytes``."""
    return table(spark, sf_dir, "lineitem")


def region_code(key: Column) -> Column:
    return F.concat(F.lit("m"), F.lpad(key.cast("string"), 2, "0"))


def currency_of(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), F.pmod(key, F.lit(18)).cast("int") + 1)


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, ord, currency, name; one row per nation."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        region_code(F.col("n_nationkey")).alias("region"),
        F.col("n_nationkey").cast("bigint").alias("ord"),
        currency_of(F.col("n_nationkey")).alias("currency"),
        F.col("n_name").alias("market_name"),
    )


def rates(spark: SparkSession) -> DataFrame:
    """currency, units per CNY: the 18 fixed rows."""
    return small_table(spark, list(RATES.items()), "currency string, units double")


def anchor_region(spark: SparkSession, sf_dir: str) -> Column:
    """Code of the anchor market: the lowest nation with a supplier."""
    key = table(spark, sf_dir, "supplier").agg(F.min("s_nationkey").alias("k"))
    return key.select(region_code(F.col("k"))).scalar()


def _price(currency: Column, tier: Column) -> Column:
    whole, less = tier.cast("string"), (tier - 1).cast("string")
    return (
        F.when(currency == "EUR", F.concat(F.lit("€"), less, F.lit(",99")))
        .when(currency == "TRY", F.concat(F.lit("₺"), less, F.lit(",99")))
        .when(currency == "BRL", F.concat(F.lit("R$"), less, F.lit(",99")))
        .when(currency == "VND", F.concat(whole, F.lit(".000đ")))
        .when(currency == "JPY", F.concat(F.lit("¥"), whole, F.lit(",000")))
        .when((currency == "IDR") & (tier % 2 == 0), F.concat(F.lit("Rp "), whole, F.lit("ribu")))
        .when(currency == "IDR", F.concat(F.lit("Rp "), whole, F.lit(".000")))
        .when((currency == "INR") & (tier % 10 == 0), F.concat(F.lit("Rs."), less, F.lit(".99")))
        .when(currency == "INR", F.concat(F.lit("₹"), less, F.lit(".99")))
        .otherwise(F.concat(F.lit("$"), less, F.lit(".99")))
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one observation, before empty cells lose their rows.

    What depends on the supplier or the part alone is worked out on those
    tables, so a line only copies it.
    """
    line = facts(spark, sf_dir)
    key = F.col("s_nationkey")
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", key.cast("bigint").alias("ord"), region_code(key).alias("region"), currency_of(key.cast("bigint")).alias("currency"),
        (region_code(key) == anchor_region(spark, sf_dir)).alias("anchor"),
    )
    app, kind = F.col("p_partkey") % 20, F.col("p_size") % 4
    part = table(spark, sf_dir, "part").select(
        "p_partkey", app.alias("app"), kind.alias("kind"), (app + 100000).cast("string").alias("app_id"),
        F.concat_ws(
            " ", F.trim("p_type"), F.when(kind == 0, "Monthly").when(kind == 1, "Annual").when(kind == 2, "Credits")
        ).alias("name"),
    )
    after = F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz")
    nation, step = F.col("ord"), F.col("step")
    structured = F.col("status") == "ok-structured"
    tier = F.col("l_quantity").cast("int")
    mix = F.pmod(
        F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_quantity").cast("bigint") * 31,
        F.lit(2**22),
    )
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(part, line.l_partkey == part.p_partkey)
        .withColumn("step", (F.col("app") * 31 + nation * 7 + F.when(after, 3).otherwise(0)) % 10)
        .withColumn(
            "status",
            F.when(F.col("anchor"), "ok-structured")
            .when(step == 0, "error:HTTP 404")
            .when(step == 1, "iap-section-missing")
            .when(step == 2, "error:HTTP 503")
            .when(step <= 4, "ok-textPairs")
            .otherwise("ok-structured"),
        )
        .select(
            F.when(after, "after").otherwise("before").alias("snap"),
            "app_id",
            "region",
            "ord",
            "currency",
            "anchor",
            "status",
            F.when(~F.col("anchor") & (step == 4), "error:HTTP 429").alias("identity_status"),
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * F.lit(2**22) + mix).alias("pos"),
            "name",
            _price(F.col("currency"), tier).alias("price"),
            F.when(structured, (F.col("l_partkey") + 600000).cast("string")).alias("product_id"),
            F.when(
                structured & (F.col("l_partkey") % 13 == 0),
                F.concat(F.lit("Offer "), (nation % 2).cast("string")),
            ).alias("offer_name"),
            F.when(structured, F.when(F.col("kind") == 0, "P1M").when(F.col("kind") == 1, "P1Y")).alias("billing_period"),
            F.when(
                structured,
                F.concat(
                    F.lit("F"),
                    (
                        F.col("l_partkey") % 7
                        + F.when((F.col("l_partkey") % 11 == 0) & (nation % 2 == 1), 1).otherwise(0)
                    ).cast("string"),
                ),
            ).alias("family_id"),
        )
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cells that have items."""
    return raw_rows(spark, sf_dir).filter(F.col("status").startswith("ok-"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (snapshot, app, market) with its status and item count."""
    return (
        raw_rows(spark, sf_dir)
        .groupBy(*CELL, "ord", "status", "identity_status")
        .agg(F.count(F.when(F.col("status").startswith("ok-"), 1)).alias("item_count"))
    )


def pos_range() -> Column:
    """Range of the sparse order key, for ``number_in_group``."""
    return F.floor(F.col("pos") / F.lit(POS_RANGE)).cast("bigint")


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable catalog: one app per part; ``place`` is its position in a result list."""
    part = table(spark, sf_dir, "part")
    return part.select(
        (F.col("p_partkey") + 100000).cast("string").alias("app_id"),
        F.col("p_name").alias("app_name"),
        F.col("p_brand").alias("developer"),
        F.col("p_type").alias("category"),
        F.pmod(F.col("p_partkey") * 7, F.lit(1000003)).alias("place"),
    )


def app_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the apps that have observations; some of it is missing."""
    number = F.col("p_partkey") % 20
    grouped = table(spark, sf_dir, "part").groupBy(number.alias("n")).agg(
        *[F.min(c).alias(c) for c in ("p_partkey", "p_name", "p_type", "p_brand")]
    )
    n = F.col("n")
    return grouped.select(
        (n + 100000).cast("string").alias("app_id"), F.when(n % 2 == 0, F.col("p_name")).alias("matched_name"),
        F.when(n % 3 == 0, F.col("p_type")).alias("query"), F.when(n % 5 > 0, F.col("p_brand")).alias("developer"),
        F.concat("p_name", F.lit(".jpg")).alias("icon"),
        F.concat(F.lit("https://example.test/"), F.col("p_partkey").cast("string")).alias("store_url"),
        F.when(n % 4 == 0, "service").alias("price_source"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request and cache events: key, ts, event_id, mode."""
    events = table(spark, sf_dir, "events")
    mode = (
        F.when(F.col("event_type") == "view", "read")
        .when(F.col("event_type") == "click", "manual")
        .when(F.col("event_type") == "purchase", "hot")
        .when(F.col("event_type") == "signup", "put")
        .otherwise("error")
    )
    return events.select(F.col("user_id").alias("key"), "ts", "event_id", mode.alias("mode"), "value")
