"""Snapshot, rate and dimension documents as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketladder.functions.text import strip
from marketladder.session import small_table

ITEM = (
    "struct<name:string,price:string,productId:string,offerName:string,billingPeriod:string,"
    "subscriptionFamilyId:string,isSubscription:boolean>"
)
REGION = f"struct<region:string,status:string,itemCount:int,identityStatus:string,items:array<{ITEM}>>"
APP = (
    "struct<id:string,query:string,matchedName:string,developer:string,icon:string,category:string,`group`:string,"
    "regionalAppIds:map<string,string>,storeUrl:string,priceSource:string,service:string,verifiedAt:string,"
    f"regions:array<{REGION}>>"
)
REPORT = (
    "struct<fallbackCount:int,fallbacks:array<struct<appId:string,region:string,reason:string>>,"
    "deferredApps:array<struct<appId:string,region:string,reason:string>>>"
)
SNAPSHOT = (
    f"generatedAt string, source string, regions array<string>, apps array<{APP}>, updateReport {REPORT}"
)

# Storefronts in display order.
STOREFRONTS = [
    ("cn", "中国", "CNY", 143465, "https://www.apple.com.cn", "China mainland"),
    ("us", "美国", "USD", 143441, "https://www.apple.com", "United States"),
    ("hk", "香港", "HKD", 143463, "https://www.apple.com/hk", "Hong Kong"),
    ("tw", "台湾", "TWD", 143470, "https://www.apple.com/tw", "Taiwan"),
    ("vn", "越南", "VND", 143471, "https://www.apple.com/vn", "Vietnam"),
    ("jp", "日本", "JPY", 143462, "https://www.apple.com/jp", "Japan"),
    ("gb", "英国", "GBP", 143444, "https://www.apple.com/uk", "United Kingdom"),
    ("de", "德国", "EUR", 143443, "https://www.apple.com/de", "Euro 3 (Euro)"),
    ("ca", "加拿大", "CAD", 143455, "https://www.apple.com/ca", "Canada"),
    ("tr", "土耳其", "TRY", 143480, "https://www.apple.com/tr", "Türkiye"),
    ("au", "澳大利亚", "AUD", 143460, "https://www.apple.com/au", "Australia"),
    ("in", "印度", "INR", 143467, "https://www.apple.com/in", "India"),
    ("br", "巴西", "BRL", 143503, "https://www.apple.com/br", "Brazil"),
    ("id", "印度尼西亚", "IDR", 143476, "https://www.apple.com/id", "Indonesia"),
    ("mx", "墨西哥", "MXN", 143468, "https://www.apple.com/mx", "Mexico"),
    ("nz", "新西兰", "NZD", 143461, "https://www.apple.com/nz", "New Zealand"),
    ("ae", "阿联酋", "AED", 143481, "https://www.apple.com/ae", "United Arab Emirates"),
    ("sa", "沙特阿拉伯", "SAR", 143479, "https://www.apple.com/sa", "Saudi Arabia"),
]


def scan_snapshot(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Observation rows of snapshot files.

    Large snapshots are JSON lines (any number of documents, e.g. one app
    each), which Spark splits; ``multi_line`` reads a single pretty-printed
    document per file in one task, ``split_json.scan_snapshot`` in many.
    """
    return explode_snapshot(spark.read.schema(SNAPSHOT).option("multiLine", multi_line).json(path))


def parse_snapshot(documents: DataFrame, column: str) -> DataFrame:
    """Observation rows of snapshot documents held as text in a column."""
    return explode_snapshot(documents.select("*", F.from_json(column, SNAPSHOT).alias("d")).select("*", "d.*").drop("d"))


def explode_snapshot(documents: DataFrame) -> DataFrame:
    """One row per app, market and item; positions in the lists are kept."""
    carried = [c for c in documents.columns if c not in ("generatedAt", "source", "regions", "apps", "updateReport")]
    apps = documents.select(
        *carried, F.col("generatedAt").alias("generated_at"), F.posexplode_outer("apps").alias("app_ord", "a")
    )
    regions = apps.select(
        *carried, "generated_at", "app_ord", "a", F.posexplode_outer("a.regions").alias("region_ord", "r")
    )
    return regions.select(
        *carried, "generated_at", "app_ord", "a", "region_ord", "r", F.posexplode_outer("r.items").alias("pos", "i")
    ).select(*observation(carried))


def observation(carried: list[str]) -> list[str | Column]:
    """Columns of an observation from its app ``a``, market ``r`` and item ``i``."""
    return [
        *carried,
        "generated_at",
        F.coalesce("a.verifiedAt", "generated_at").alias("verified_at"),
        F.col("app_ord").cast("bigint").alias("app_ord"),
        F.col("a.id").alias("app_id"),
        F.col("a.matchedName").alias("app_name"),
        F.col("a.developer").alias("developer"),
        F.col("a.priceSource").alias("price_source"),
        F.col("a.service").alias("service"),
        F.col("a.regionalAppIds").alias("regional_ids"),
        F.col("region_ord").cast("bigint").alias("ord"),
        F.col("r.region").alias("region"),
        F.col("r.status").alias("status"),
        F.col("r.identityStatus").alias("identity_status"),
        F.col("r.itemCount").cast("bigint").alias("item_count"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("i.name").alias("name"),
        F.col("i.price").alias("price"),
        F.col("i.productId").alias("product_id"),
        F.col("i.offerName").alias("offer_name"),
        F.col("i.billingPeriod").alias("billing_period"),
        F.col("i.subscriptionFamilyId").alias("family_id"),
    ]


def scan_fx(documents: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Rate documents to rows (keys, currency, units); unreadable rates are dropped."""
    parsed = F.from_json(column, "result string, base string, rates map<string,double>")
    rows = documents.select(*keys, parsed.alias("d")).select(*keys, F.explode("d.rates").alias("currency", "units"))
    finite = ~F.isnan("units") & (F.abs("units") < float("inf"))
    return rows.filter(F.col("units").isNotNull() & finite)


def missing_currencies(rates: DataFrame, documents: DataFrame, storefronts: DataFrame, keys: list[str]) -> DataFrame:
    """Currencies a storefront needs but a rate document does not have."""
    needed = storefronts.agg(F.collect_set("currency")).scalar()
    wanted = documents.select(*keys, F.explode(needed).alias("currency"))
    return wanted.join(rates.select(*keys, "currency"), [*keys, "currency"], "left_anti")


def require_rates(rates: DataFrame, storefronts: DataFrame) -> DataFrame:
    """Fail when a storefront currency has no rate; both are small dimensions."""
    missing = storefronts.select("currency").distinct().join(rates, "currency", "left_anti")
    names = sorted(row.currency for row in missing.collect())
    if names:
        raise ValueError(f"exchange rates are missing: {', '.join(names)}")
    return rates


def rate_time(text: Column) -> Column:
    """RFC-2822 time of a rate document as a timestamp."""
    day = F.regexp_replace(text, "^[A-Za-z]+, *", "")
    return F.try_to_timestamp(day, F.lit("dd MMM yyyy HH:mm:ss Z"))


def storefronts(spark: SparkSession) -> DataFrame:
    """The market dimension; ``ord`` is the display and tie order."""
    rows = [(i, *row) for i, row in enumerate(STOREFRONTS)]
    return small_table(
        spark,
        rows,
        "ord bigint, region string, name string, currency string, storefront_id bigint, host string, country string",
    )


def plan_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Curated plans from a JSON object of app id to definitions."""
    definition = "array<struct<id:string,label:string,period:string,aliases:array<string>,occurrence:bigint>>"
    text = spark.read.text(path, wholetext=True)
    by_app = text.select(F.explode(F.from_json("value", f"map<string,{definition}>")).alias("app_id", "plans"))
    rows = by_app.select("app_id", F.posexplode("plans").alias("curated_ord", "p"))
    return rows.select(
        "app_id", F.col("p.id").alias("plan_id"), F.col("p.label").alias("label"), F.col("p.period").alias("period"),
        F.col("p.aliases").alias("aliases"), F.coalesce("p.occurrence", F.lit(0).cast("bigint")).alias("occurrence"),
        F.col("curated_ord").cast("bigint").alias("curated_ord"),
    )


def normalize_catalog(entries: DataFrame, column: str) -> DataFrame:
    """Catalog rows given as a bare id or an object; ``problem`` names a broken rule."""
    fields = (
        "id string, query string, `group` string, priceSource string, service string, metadata string, "
        "regionalAppIds string, excludeItemNames string, allowAllEmpty boolean"
    )
    text = F.trim(F.col(column))
    is_object = text.startswith("{")
    bare = F.regexp_replace(text, '^"|"$', "")
    parsed = entries.select("*", F.from_json(column, fields).alias("o"))

    def blank_to_null(c: Column) -> Column:
        return F.when(strip(c) != "", strip(c))

    app_id = strip(F.coalesce(F.when(is_object, F.col("o.id")).otherwise(bare), F.lit("")))
    raw_ids, raw_names = F.col("o.regionalAppIds"), F.col("o.excludeItemNames")
    ids = F.from_json(raw_ids, "map<string,string>")
    names = F.from_json(raw_names, "array<string>")
    rows = parsed.select(
        *entries.columns,
        app_id.alias("app_id"),
        blank_to_null(F.col("o.query")).alias("query"),
        blank_to_null(F.col("o.group")).alias("catalog_group"),
        F.col("o.priceSource").alias("price_source"),
        F.col("o.service").alias("service"),
        F.col("o.metadata").alias("metadata"),
        raw_ids.alias("__raw_ids"),
        raw_names.alias("__raw_names"),
        F.transform_values(
            F.transform_keys(ids, lambda k, _: F.lower(strip(k))), lambda _, v: strip(v)
        ).alias("regional_ids"),
        F.filter(F.transform(names, strip), lambda n: n != "").alias("excluded"),
        F.coalesce("o.allowAllEmpty", F.lit(False)).alias("allow_all_empty"),
    )
    keys, values = F.map_keys("regional_ids"), F.map_values("regional_ids")
    bad_region = F.coalesce(F.exists(keys, lambda k: ~k.rlike("^[a-z]{2}$")), F.lit(False))
    bad_id = F.coalesce(F.exists(values, lambda v: ~v.rlike("^[0-9]+$")), F.lit(False))
    problem = (
        F.when(F.col("app_id") == "", "missing-id")
        .when(F.col("metadata").isNull() & ~F.col("app_id").rlike("^[0-9]+$"), "id-not-numeric")
        .when(F.col("__raw_ids").isNotNull() & ~F.col("__raw_ids").startswith("{"), "regional-ids-not-an-object")
        .when(bad_region, "invalid-region-code")
        .when(bad_id, "invalid-regional-id")
        .when(F.col("__raw_names").isNotNull() & ~F.col("__raw_names").startswith("["), "exclusions-not-a-list")
    )
    return rows.withColumn("problem", problem).drop("__raw_ids", "__raw_names")


def duplicate_ids(catalog: DataFrame) -> DataFrame:
    """Catalog ids listed more than once."""
    return catalog.groupBy("app_id").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1")
