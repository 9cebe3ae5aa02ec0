"""Queries for the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketladder.functions import amounts, plans, status, text
from marketladder.plans import fixtures as fx
from marketladder.plans.oracle_base import CATALOG, OBS, amount, cny
from marketladder.plans.registry import n_rows, query
from marketladder.sources.snapshot import STOREFRONTS, storefronts



def sql_map(expression: str, table: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"(CASE {expression} {whens} ELSE {default} END)"


STORE_VALUES = ", ".join(
    f"({i}, '{c}', '{n}', '{cur}', {sid}, '{h}', '{co}')" for i, (c, n, cur, sid, h, co) in enumerate(STOREFRONTS)
)
STORE = f"store(ord, region, name, currency, storefront_id, host, country) AS (VALUES {STORE_VALUES})"


@query(
    "parse_localized_amount",
    "O16",
    f"WITH {OBS} SELECT currency, price, {amount('price', 'currency')} AS amount, count(*) AS rows FROM obs GROUP BY ALL",
)
def _parse(spark: SparkSession, sf: str) -> DataFrame:
    value = amounts.parse_localized_amount(F.col("price"), F.col("currency"))
    counted = fx.observations(spark, sf).groupBy("currency", "price").agg(n_rows())  # few distinct texts
    return counted.withColumn("amount", value)


@query(
    "numeric_amount",
    "O17",
    f"""WITH {OBS}, k AS (SELECT currency, price, regexp_replace(price, '[^0-9.,]', '', 'g') AS k FROM obs)
    SELECT currency, price, CASE
      WHEN currency IN ('VND', 'JPY', 'KRW', 'IDR') THEN TRY_CAST(regexp_replace(k, '[.,]', '', 'g') AS DOUBLE)
      WHEN currency IN ('EUR', 'TRY', 'BRL') AND instr(k, ',') > 0 AND instr(k, '.') = 0
        THEN TRY_CAST(replace(k, ',', '.') AS DOUBLE)
      ELSE {amount('k', None)} END AS amount, count(*) AS rows
    FROM k GROUP BY ALL""",
)
def _numeric_amount(spark: SparkSession, sf: str) -> DataFrame:
    value = amounts.numeric_amount(F.col("price"), F.col("currency"))
    counted = fx.observations(spark, sf).groupBy("currency", "price").agg(n_rows())  # few distinct texts
    return counted.withColumn("amount", value)


@query(
    "numeric_price",
    "O18",
    f"WITH {OBS} SELECT price, {amount('price', None)} AS amount, count(*) AS rows FROM obs GROUP BY ALL",
)
def _numeric_price(spark: SparkSession, sf: str) -> DataFrame:
    value = amounts.numeric_price(F.col("price"))
    return fx.observations(spark, sf).select("price", value.alias("amount")).groupBy("price", "amount").agg(n_rows())


@query(
    "to_base_currency",
    "O19",
    f"""WITH {OBS} SELECT currency, price, {amount('price', 'currency')} / units AS cny, count(*) AS rows
    FROM obs JOIN fx USING (currency) GROUP BY ALL""",
)
def _to_base(spark: SparkSession, sf: str) -> DataFrame:
    value = amounts.parse_localized_amount(F.col("price"), F.col("currency"))
    return (
        fx.observations(spark, sf)
        .join(fx.rates(spark), "currency")
        .select("currency", "price", amounts.to_base_currency(value, F.col("units")).alias("cny"))
        .groupBy("currency", "price", "cny")
        .agg(n_rows())
    )


@query(
    "round_cny",
    "O20",
    f"SELECT l_extendedprice AS amount, {cny('l_extendedprice / 7.173601')} AS rounded, count(*) AS rows FROM lineitem GROUP BY ALL",
)
def _round(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fx.table(spark, sf, "lineitem")
        .select(
            F.col("l_extendedprice").alias("amount"),
            amounts.round_cny(F.col("l_extendedprice") / 7.173601).alias("rounded"),
        )
        .groupBy("amount", "rounded")
        .agg(n_rows())
    )


PERIOD_SQL = sql_map("upper(trim(raw))", plans.PERIOD_CODES)
RAW_PERIOD_SQL = (
    "CASE p_size % 9 WHEN 0 THEN 'P1M' WHEN 1 THEN ' monthly ' WHEN 2 THEN 'Yearly' WHEN 3 THEN 'annual' "
    "WHEN 4 THEN 'P1Y' WHEN 5 THEN 'weekly' WHEN 6 THEN ' P1W' WHEN 7 THEN 'P3M' END"
)


@query(
    "canonical_period",
    "O21",
    f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {RAW_PERIOD_SQL} END AS a,
        CASE WHEN p_partkey % 3 = 0 THEN {RAW_PERIOD_SQL} END AS b, {RAW_PERIOD_SQL} AS c,
        CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE 'p' || p_partkey END AS pid FROM part),
      s AS (SELECT *, coalesce(a, b, c) AS raw FROM r)
    SELECT p_partkey, {PERIOD_SQL} AS period, CASE WHEN trim(pid) <> '' THEN trim(pid) END AS product_id FROM s""",
)
def _period(spark: SparkSession, sf: str) -> DataFrame:
    codes = ["P1M", " monthly ", "Yearly", "annual", "P1Y", "weekly", " P1W", "P3M"]
    raw = F.get(F.array(*[F.lit(c) for c in codes]), (F.col("p_size") % 9).cast("int"))
    key = F.col("p_partkey")
    named = F.when(key % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("p"), key.cast("string")))
    return fx.table(spark, sf, "part").select(
        "p_partkey",
        plans.first_period(F.when(key % 2 == 0, raw), F.when(key % 3 == 0, raw), raw).alias("period"),
        plans.first_product_id(F.lit(None).cast("string"), named, F.lit("unused")).alias("product_id"),
    )


NAME_SQL = (
    "p_name || CASE p_size % 8 WHEN 0 THEN ' Annual Pass' WHEN 1 THEN ' 12 months' WHEN 2 THEN ' Weekly' "
    "WHEN 3 THEN ' 7 day' WHEN 4 THEN ' 1 Month' WHEN 5 THEN ' 100 Credits' WHEN 6 THEN ' Gold Pack' ELSE '' END"
)


def _names(spark: SparkSession, sf: str) -> DataFrame:
    ends = [" Annual Pass", " 12 months", " Weekly", " 7 day", " 1 Month", " 100 Credits", " Gold Pack", ""]
    end = F.get(F.array(*[F.lit(e) for e in ends]), (F.col("p_size") % 8).cast("int"))
    return fx.table(spark, sf, "part").select("p_partkey", "p_type", F.concat("p_name", end).alias("name"))


def _java_free(pattern: str) -> str:
    """The same word list for DuckDB's regular expressions."""
    return pattern.replace(r"(?U:\s)", r"\s").replace("(?iu)", "(?i)")


INFER_SQL = f"""(CASE WHEN regexp_matches(lower(name), '{_java_free(plans.LOOSE_YEAR)}') THEN '{plans.YEAR}'
  WHEN regexp_matches(lower(name), '{_java_free(plans.LOOSE_WEEK)}') THEN '{plans.WEEK}'
  WHEN regexp_matches(lower(name), '{_java_free(plans.LOOSE_MONTH)}') THEN '{plans.MONTH}'
  WHEN regexp_matches(lower(name), '{_java_free(plans.LOOSE_ONCE)}') THEN '{plans.ONCE}' ELSE '{plans.PUBLIC}' END)"""
STRICT_SQL = f"""(CASE WHEN regexp_matches(lower(name), '{_java_free(plans.STRICT_YEAR)}') THEN '{plans.YEAR}'
  WHEN regexp_matches(lower(name), '{_java_free(plans.STRICT_MONTH)}') THEN '{plans.MONTH}'
  WHEN regexp_matches(lower(name), '{_java_free(plans.STRICT_WEEK)}') THEN '{plans.WEEK}'
  WHEN regexp_matches(lower(name), '{_java_free(plans.STRICT_ONCE)}') THEN '{plans.ONCE}' END)"""


@query(
    "infer_period",
    "O22",
    f"""WITH n AS (SELECT p_partkey, {NAME_SQL} AS name FROM part)
    SELECT p_partkey, name, {INFER_SQL} AS loose, {STRICT_SQL} AS strict FROM n""",
)
def _infer(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select(
        "p_partkey", "name", plans.infer_period(F.col("name")).alias("loose"),
        plans.strict_period(F.col("name")).alias("strict"),
    )


@query(
    "display_group",
    "O23",
    f"""WITH n AS (SELECT p_partkey, p_type, {NAME_SQL} AS name FROM part),
      m AS (SELECT *, {INFER_SQL} AS period, name || ' ' || p_type || ' Plus ' || lower(p_type) AS words FROM n)
    SELECT p_partkey, CASE WHEN period IN ('月付', '年付', '周付') THEN 'primary' WHEN period = '一次性' THEN 'other'
      WHEN regexp_matches(words, '{_java_free(plans.SECONDARY_WORDS)}') THEN 'other'
      WHEN regexp_matches(words, '{_java_free(plans.PRIMARY_WORDS)}') THEN 'primary' ELSE 'other' END AS display_group
    FROM m""",
)
def _group(spark: SparkSession, sf: str) -> DataFrame:
    aliases = F.array(F.concat("p_type", F.lit(" Plus")), F.lower("p_type"))
    return _names(spark, sf).select(
        "p_partkey",
        plans.display_group(plans.infer_period(F.col("name")), F.col("name"), aliases).alias("display_group"),
    )


STATE_SQL = """CASE WHEN status LIKE 'ok-%' AND item_count > 0 THEN 'verified'
  WHEN status IN ('service-unavailable', 'error:HTTP 404') THEN '{}'
  WHEN status IN ('official-price-unpublished', 'official-price-page-missing', 'iap-section-missing')
    OR (status LIKE 'ok-%' AND item_count = 0) THEN '{}' ELSE '{}' END"""
DISPLAY_STATE = STATE_SQL.format("unavailable", "not-public", "review")
DIFF_STATE = STATE_SQL.format("service-unavailable", "official-price-unpublished", "parse-failed")


@query(
    "evidence_state",
    "O24",
    f"WITH {OBS} SELECT snap, app_id, region, {DISPLAY_STATE} AS display_state, {DIFF_STATE} AS diff_state FROM cell",
)
def _state(spark: SparkSession, sf: str) -> DataFrame:
    args = F.col("status"), F.col("item_count")
    return fx.cells(spark, sf).select(
        *fx.CELL, status.evidence_state(*args).alias("display_state"), status.diff_state(*args).alias("diff_state")
    )


@query(
    "region_flags",
    "O25",
    f"""WITH {OBS}, c AS (SELECT *, item_count + CASE WHEN ord % 9 = 4 THEN 1 ELSE 0 END AS declared FROM cell)
    SELECT snap, app_id, region,
      declared = item_count AND CASE WHEN status IN ('iap-section-missing', 'official-price-page-missing', 'error:HTTP 404')
        THEN item_count = 0 ELSE status LIKE 'ok-%' AND item_count > 0 END AS publishable,
      status NOT LIKE 'error:%' AND item_count > 0 AS public,
      (status LIKE 'error:%' AND status <> 'error:HTTP 404') OR status IN ('marker-missing', 'marker-unclosed') AS transient_error,
      status <> 'ok-structured' AND coalesce(identity_status, '') <> '' AS identity_degraded,
      (status LIKE 'error:%' AND status <> 'error:HTTP 404') OR (status <> 'ok-structured' AND coalesce(identity_status, '') <> '') AS retry
    FROM c""",
)
def _flags(spark: SparkSession, sf: str) -> DataFrame:
    declared = F.col("item_count") + F.when(F.col("ord") % 9 == 4, 1).otherwise(0)
    st, count, identity = F.col("status"), F.col("item_count"), F.col("identity_status")
    return fx.cells(spark, sf).select(
        *fx.CELL,
        status.is_publishable(st, declared, count).alias("publishable"),
        status.is_public(st, count).alias("public"),
        status.is_transient_error(st).alias("transient_error"),
        status.is_identity_degraded(st, identity).alias("identity_degraded"),
        status.needs_retry(st, identity).alias("retry"),
    )


SEARCH_KEY_SQL = r"regexp_replace(lower({}), '[\s\p{{P}}\p{{S}}]+', '', 'g')"


@query(
    "normalize_search",
    "O26",
    f"""SELECT p_partkey, {SEARCH_KEY_SQL.format("p_name || ' / ' || p_brand || ' (+' || p_size || ')'")} AS search_key FROM part""",
)
def _search_key(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" / "), "p_brand", F.lit(" (+"), F.col("p_size").cast("string"), F.lit(")"))
    return fx.table(spark, sf, "part").select("p_partkey", text.search_key(raw).alias("search_key"))


ID_TEXT_SQL = """CASE o_orderkey % 6 WHEN 0 THEN (1000000 + o_orderkey)::VARCHAR
  WHEN 1 THEN 'https://apps.apple.com/us/app/x/id' || (1000000 + o_orderkey) || '?l=en'
  WHEN 2 THEN ' ' || (1000000 + o_orderkey) || ' ' WHEN 3 THEN '/id' || (1000000 + o_orderkey) || 'x'
  WHEN 4 THEN o_orderpriority ELSE '/id' || (1000000 + o_orderkey) END"""


@query(
    "parse_app_id",
    "O27",
    f"""WITH t AS (SELECT o_orderkey, trim({ID_TEXT_SQL}) AS v FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_matches(v, '^[0-9]{{6,12}}$') THEN v
      WHEN regexp_extract(v, '/id([0-9]{{6,12}})([/?#]|$)', 1) <> '' THEN regexp_extract(v, '/id([0-9]{{6,12}})([/?#]|$)', 1)
      END AS app_id FROM t""",
)
def _app_id(spark: SparkSession, sf: str) -> DataFrame:
    key = (F.col("o_orderkey") + 1_000_000).cast("string")
    kind = F.col("o_orderkey") % 6
    raw = (
        F.when(kind == 0, key)
        .when(kind == 1, F.concat(F.lit("https://apps.apple.com/us/app/x/id"), key, F.lit("?l=en")))
        .when(kind == 2, F.concat(F.lit(" "), key, F.lit(" ")))
        .when(kind == 3, F.concat(F.lit("/id"), key, F.lit("x")))
        .when(kind == 4, F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit("/id"), key))
    )
    return fx.table(spark, sf, "orders").select("o_orderkey", text.parse_app_id(raw).alias("app_id"))


HASH_SQL = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)),
  lambda acc, c: ((xor(acc, c))::HUGEINT * 16777619 % 4294967296)::BIGINT)"""
BASE36_SQL = "ltrim({}, '0')".format(
    " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // {36**k}) % 36 + 1)::INTEGER, 1)" for k in range(6, -1, -1))
)
SLUG_SQL = r"""substr(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g'), 1, 42)"""


@query(
    "plan_id",
    "O28",
    f"""WITH n AS (SELECT p_partkey, (p_size % 3)::BIGINT AS occurrence, {NAME_SQL} || ' (' || p_brand || ')' AS name FROM part),
      h AS (SELECT *, {HASH_SQL.format("name || chr(0) || occurrence")} AS h FROM n)
    SELECT p_partkey, 'auto-' || {SLUG_SQL.format("name")} || '-' || (occurrence + 1) || '-' || {BASE36_SQL} AS plan_id FROM h""",
)
def _plan_id(spark: SparkSession, sf: str) -> DataFrame:
    brand = fx.table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    name = F.concat("name", F.lit(" ("), "p_brand", F.lit(")"))
    return _names(spark, sf).join(brand, "p_partkey").select(
        "p_partkey", plans.plan_id(name, (F.col("p_size") % 3).cast("bigint")).alias("plan_id")
    )


SOURCE_KIND_SQL = "CASE l_partkey % 4 WHEN 0 THEN 'apple-music' WHEN 1 THEN 'apple-service' WHEN 2 THEN 'app-store' END"
SERVICE_SQL = (
    "CASE WHEN l_partkey % 4 = 1 THEN CASE l_suppkey % 5 WHEN 0 THEN 'icloud-plus' WHEN 1 THEN 'apple-tv-plus' "
    "WHEN 2 THEN 'apple-news-plus' WHEN 3 THEN 'apple-one' ELSE 'apple-arcade' END END"
)


@query(
    "source_url",
    "O29",
    f"""WITH {STORE}, l AS (SELECT (100000 + l_partkey)::VARCHAR AS app_id, {SOURCE_KIND_SQL} AS src, {SERVICE_SQL} AS service,
        l_orderkey % 18 AS ord, CASE WHEN l_partkey % 7 = 0 AND l_orderkey % 18 = 3 THEN '999999' END AS own FROM lineitem),
      j AS (SELECT l.*, region, host, storefront_id, coalesce(own, app_id) AS rid FROM l JOIN store USING (ord))
    SELECT region, service, CASE WHEN coalesce(src, 'app-store') = 'app-store' THEN 'https://apps.apple.com/' || region || '/app/id' || rid
        WHEN src = 'apple-music' THEN host || '/apple-music/'
        WHEN service = 'icloud-plus' THEN 'https://support.apple.com/en-us/108047'
        WHEN region = 'tr' AND service = 'apple-tv-plus' THEN 'https://www.apple.com/tr/tv-home/'
        ELSE host || '/' || CASE service WHEN 'apple-tv-plus' THEN 'apple-tv' WHEN 'apple-news-plus' THEN 'apple-news' ELSE service END || '/' END AS url,
      'itms-apps://apps.apple.com/' || region || '/app/id' || rid AS deep_link,
      'itms-apps://itunes.apple.com/WebObjects/MZStore.woa/wa/resetAndRedirect?dsf=' || storefront_id || '&cc=' || region AS switch_link,
      count(*) AS rows FROM j GROUP BY ALL""",
)
def _source_url(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("l_partkey") % 4
    services = ["icloud-plus", "apple-tv-plus", "apple-news-plus", "apple-one", "apple-arcade"]
    service = F.when(
        kind == 1, F.get(F.array(*[F.lit(s) for s in services]), (F.col("l_suppkey") % 5).cast("int"))
    )
    source = F.when(kind == 0, "apple-music").when(kind == 1, "apple-service").when(kind == 2, "app-store")
    own = F.when(F.col("l_partkey") % 7 == 0, F.create_map(F.lit("tw"), F.lit("999999")))
    rows = (
        fx.table(spark, sf, "lineitem")
        .select(
            (F.col("l_partkey") + 100000).cast("string").alias("app_id"), source.alias("src"),
            service.alias("service"), (F.col("l_orderkey") % 18).alias("ord"), own.alias("own"),
        )
        .join(storefronts(spark), "ord")
    )
    app, region, ids = F.col("app_id"), F.col("region"), F.col("own")
    return (
        rows.select(
            "region", "service",
            text.source_url(F.col("src"), F.col("service"), app, region, F.col("host"), ids).alias("url"),
            text.store_deep_link(app, region, ids).alias("deep_link"),
            text.store_switch_link(region, F.col("storefront_id")).alias("switch_link"),
        )
        .groupBy("region", "service", "url", "deep_link", "switch_link")
        .agg(n_rows())
    )


CATEGORY_SQL = (
    "CASE p_size % 11 WHEN 0 THEN 'Productivity' WHEN 1 THEN 'Business' WHEN 2 THEN 'Social Networking' WHEN 3 THEN 'Entertainment' "
    "WHEN 4 THEN 'Photo & Video' WHEN 5 THEN 'Music' WHEN 6 THEN 'Sports' WHEN 7 THEN 'News' WHEN 8 THEN 'Games' WHEN 9 THEN 'Weather' END"
)
CATEGORIES = [
    "Productivity", "Business", "Social Networking", "Entertainment", "Photo & Video", "Music", "Sports", "News",
    "Games", "Weather",
]


@query(
    "catalog_group",
    "O30",
    f"""WITH c AS (SELECT p_partkey, p_type, {CATEGORY_SQL} AS category FROM part)
    SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_type END,
      {sql_map('category', text.CATEGORY_GROUPS, "'其他应用'")}) AS catalog_group FROM c""",
)
def _catalog_group(spark: SparkSession, sf: str) -> DataFrame:
    category = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("p_size") % 11).cast("int"))
    explicit = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type"))
    return fx.table(spark, sf, "part").select(
        "p_partkey", text.catalog_group(category, explicit).alias("catalog_group")
    )


@query(
    "format_local_time",
    "O31",
    """WITH e AS (SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN ts END, TIMESTAMP '2024-01-15 20:45:10') + INTERVAL 8 HOUR AS t FROM events)
    SELECT event_id, strftime(t, '%Y/%m/%d %H:%M') AS shown,
      year(t) || '年' || month(t) || '月' || day(t) || '日 ' || strftime(t, '%H:%M') AS published FROM e""",
)
def _local_time(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    shown = text.app_time(own, F.lit("2024-01-15 20:45:10").cast("timestamp_ntz"))
    return fx.table(spark, sf, "events").select(
        "event_id", text.format_local_time(shown).alias("shown"), text.format_publish_time(shown).alias("published")
    )


@query(
    "freshness_label",
    "O32",
    f"""WITH a AS (SELECT event_id, greatest(0, (epoch_us(TIMESTAMP '2024-01-29 12:00:00') // 1000) - (epoch_us(ts) // 1000)) AS age FROM events)
    SELECT event_id, CASE WHEN age < 120000 THEN '刚刚' WHEN age < 3600000 THEN (age // 60000) || ' 分钟前'
      WHEN age < 86400000 THEN (age // 3600000) || ' 小时前' ELSE (age // 86400000) || ' 天前' END AS label,
      CASE WHEN age > 604800000 THEN 'stale' ELSE 'snapshot' END AS tone FROM a""",
)
def _freshness(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    return fx.table(spark, sf, "events").select(
        "event_id", text.freshness_label(F.col("ts"), now).alias("label"),
        text.freshness_tone(F.col("ts"), now).alias("tone"),
    )


@query(
    "missing_price_text",
    "O33",
    f"""WITH {OBS}, c AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'apple-music' WHEN 1 THEN 'apple-service' ELSE 'app-store' END AS src,
        {DISPLAY_STATE} AS state FROM cell)
    SELECT snap, app_id, region,
      CASE src WHEN 'apple-music' THEN 'Apple Music 官方方案页' WHEN 'apple-service' THEN 'Apple 官方服务价格页' ELSE 'Apple 商品页' END AS noun,
      CASE src WHEN 'apple-music' THEN '官方价格未公开' WHEN 'apple-service' THEN '官方价格未提供' ELSE '未公开内购' END AS missing,
      CASE WHEN status = 'official-price-page-missing' THEN 'Apple 未提供该地区公开订阅价页面' WHEN state = 'unavailable' THEN '该应用未在此地区上架'
        WHEN state = 'not-public' THEN 'Apple 商品页未公开内购项目' WHEN state = 'verified' THEN '公开项目中未发现此套餐' ELSE '价格待确认' END AS detail,
      CASE state WHEN 'unavailable' THEN '不可用' WHEN 'not-public' THEN '未公开' WHEN 'verified' THEN '未提供' ELSE '待复核' END AS short
    FROM c""",
)
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("ord") % 3
    source = F.when(kind == 0, "apple-music").when(kind == 1, "apple-service").otherwise("app-store")
    state = status.evidence_state(F.col("status"), F.col("item_count"))
    copy = text.source_copy(source)
    return fx.cells(spark, sf).select(
        *fx.CELL, copy["noun"].alias("noun"), copy["missing"].alias("missing"),
        text.missing_detail(F.col("status"), state).alias("detail"), text.missing_short(state).alias("short"),
    )


@query(
    "client_kind",
    "O34",
    """WITH u AS (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'Mozilla MicroMessenger/8' WHEN 1 THEN 'Mozilla (iPhone; x)'
        WHEN 2 THEN 'Mozilla (Macintosh)' WHEN 3 THEN 'app WXWork/4' WHEN 4 THEN 'Mozilla (ipad)' END AS ua,
        CASE WHEN event_id % 2 = 0 THEN 'MacIntel' ELSE 'Linux' END AS platform, (event_id % 7)::BIGINT AS touch FROM events)
    SELECT event_id, CASE WHEN regexp_matches(coalesce(ua, ''), '(?i)MicroMessenger|wxwork') THEN 'wechat'
      WHEN regexp_matches(coalesce(ua, ''), '(?i)iPhone|iPad|iPod') OR (platform = 'MacIntel' AND touch > 1) THEN 'ios' ELSE 'other' END AS kind
    FROM u""",
)
def _client(spark: SparkSession, sf: str) -> DataFrame:
    agents = ["Mozilla MicroMessenger/8", "Mozilla (iPhone; x)", "Mozilla (Macintosh)", "app WXWork/4", "Mozilla (ipad)"]
    agent = F.get(F.array(*[F.lit(a) for a in agents]), (F.col("user_id") % 6).cast("int"))
    platform = F.when(F.col("event_id") % 2 == 0, "MacIntel").otherwise("Linux")
    return fx.table(spark, sf, "events").select(
        "event_id", text.client_kind(agent, platform, F.col("event_id") % 7).alias("kind")
    )
