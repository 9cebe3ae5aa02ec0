"""Search text, identifiers, addresses, labels and time texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marketladder.functions.plans import nfkc, strip

# Category to catalog group.
CATEGORY_GROUPS = {
    "Productivity": "效率工具",
    "Business": "效率工具",
    "Social Networking": "社交平台",
    "Entertainment": "影音娱乐",
    "Photo & Video": "影音娱乐",
    "Music": "影音娱乐",
    "Sports": "体育",
    "News": "资讯阅读",
    "Games": "游戏",
}
DEFAULT_GROUP = "其他应用"

# Page path of each official service.
SERVICE_PATHS = {"apple-tv-plus": "apple-tv", "apple-news-plus": "apple-news"}
ICLOUD_PRICE_PAGE = "https://support.apple.com/en-us/108047"
TURKISH_TV_PAGE = "https://www.apple.com/tr/tv-home/"

DAY_MS, HOUR_MS, MINUTE_MS = 86_400_000, 3_600_000, 60_000


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A small fixed table as one map literal."""
    pairs = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, default)


def search_key(text: Column, normalize: bool = True) -> Column:
    """NFKC, lower case, without blanks, punctuation and symbols."""
    folded = F.lower(nfkc(text) if normalize else text)
    return F.regexp_replace(F.coalesce(folded, F.lit("")), r"(?U)[\s\uFEFF\p{P}\p{S}]+", "")


def parse_app_id(text: Column) -> Column:
    """6-12 digits, or the digits behind ``/id`` of an address."""
    value = strip(text)
    linked = F.regexp_extract(value, r"/id([0-9]{6,12})(?:[/?#]|$)", 1)
    return F.when(value.rlike("^[0-9]{6,12}$"), value).when(linked != "", linked)


def icon_address(template: Column) -> Column:
    """Fill the size, format, crop and quality slots of an icon template."""
    # What each slot gets.
    for slot, value in {"{w}": "512", "{h}": "512", "{f}": "jpg", "{c}": "bb", "{q}": "80"}.items():
        template = F.replace(template, F.lit(slot), F.lit(value))
    return template


def regional_id(app_id: Column, region: Column, regional_ids: Column | None) -> Column:
    if regional_ids is None:
        return app_id
    return F.coalesce(F.try_element_at(regional_ids, region), app_id)


def store_page_url(app_id: Column, region: Column, regional_ids: Column | None = None) -> Column:
    return F.concat(
        F.lit("https://apps.apple.com/"), region, F.lit("/app/id"), regional_id(app_id, region, regional_ids)
    )


def store_deep_link(app_id: Column, region: Column, regional_ids: Column | None = None) -> Column:
    return F.concat(
        F.lit("itms-apps://apps.apple.com/"), region, F.lit("/app/id"), regional_id(app_id, region, regional_ids)
    )


def store_switch_link(region: Column, storefront_id: Column) -> Column:
    return F.concat(
        F.lit("itms-apps://itunes.apple.com/WebObjects/MZStore.woa/wa/resetAndRedirect?dsf="),
        storefront_id.cast("string"),
        F.lit("&cc="),
        region,
    )


def source_url(
    price_source: Column,
    service: Column,
    app_id: Column,
    region: Column,
    host: Column,
    regional_ids: Column | None = None,
) -> Column:
    """Where the price of an app in a market was read."""
    path = lookup(service, SERVICE_PATHS, service)
    return (
        F.when(
            F.coalesce(price_source, F.lit("app-store")) == "app-store",
            store_page_url(app_id, region, regional_ids),
        )
        .when(host.isNull(), F.lit(None).cast("string"))
        .when(price_source == "apple-music", F.concat(host, F.lit("/apple-music/")))
        .when(service == "icloud-plus", ICLOUD_PRICE_PAGE)
        .when((region == "tr") & (service == "apple-tv-plus"), TURKISH_TV_PAGE)
        .otherwise(F.concat(host, F.lit("/"), path, F.lit("/")))
    )


def catalog_group(category: Column, explicit: Column | None = None) -> Column:
    """Group of a category; a configured group wins."""
    inferred = lookup(F.coalesce(category, F.lit("")), CATEGORY_GROUPS, F.lit(DEFAULT_GROUP))
    return inferred if explicit is None else F.coalesce(explicit, inferred)


def _local(ts: Column) -> Column:
    """UTC wall-clock (timestamp without zone) shown in Shanghai."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), ts)


def format_local_time(ts: Column) -> Column:
    return F.date_format(_local(ts), "yyyy/MM/dd HH:mm")


def format_publish_time(ts: Column) -> Column:
    return F.date_format(_local(ts), "yyyy年M月d日 HH:mm")


def app_time(verified_at: Column, snapshot_time: Column) -> Column:
    return F.coalesce(verified_at, snapshot_time)


def age_ms(ts: Column, now: Column) -> Column:
    """Milliseconds from one zone-less timestamp to another, never negative."""
    passed = millis(now) - millis(ts)
    return F.when(passed < 0, F.lit(0).cast("bigint")).otherwise(passed)


def millis(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp since 1970, without any time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def freshness_label(ts: Column, now: Column) -> Column:
    age = age_ms(ts, now)

    def steps(size: int) -> Column:
        return F.floor(age / size).cast("string")

    return (
        F.when(age < 2 * MINUTE_MS, "刚刚")
        .when(age < HOUR_MS, F.concat(steps(MINUTE_MS), F.lit(" 分钟前")))
        .when(age < DAY_MS, F.concat(steps(HOUR_MS), F.lit(" 小时前")))
        .otherwise(F.concat(steps(DAY_MS), F.lit(" 天前")))
    )


def freshness_tone(ts: Column, now: Column) -> Column:
    return F.when(age_ms(ts, now) > 7 * DAY_MS, "stale").otherwise("snapshot")


# Display texts by price source.
SOURCE_COPY = {
    "apple-music": ("Apple Music 官方方案页", "官方价格未公开", "无公开价格"),
    "apple-service": ("Apple 官方服务价格页", "官方价格未提供", "当地未提供"),
    "app-store": ("Apple 商品页", "未公开内购", "无公开内购"),
}


def source_copy(price_source: Column) -> Column:
    """Struct of noun, missing text and status text for a price source."""

    def named(texts: tuple[str, str, str]) -> Column:
        noun, missing, status = texts
        return F.struct(F.lit(noun).alias("noun"), F.lit(missing).alias("missing"), F.lit(status).alias("status"))

    return (
        F.when(price_source == "apple-music", named(SOURCE_COPY["apple-music"]))
        .when(price_source == "apple-service", named(SOURCE_COPY["apple-service"]))
        .otherwise(named(SOURCE_COPY["app-store"]))
    )


def missing_detail(status: Column, state: Column) -> Column:
    """Why a market shows no price, long text."""
    return (
        F.when(status == "official-price-page-missing", "Apple 未提供该地区公开订阅价页面")
        .when(state == "unavailable", "该应用未在此地区上架")
        .when(state == "not-public", "Apple 商品页未公开内购项目")
        .when(state == "verified", "公开项目中未发现此套餐")
        .otherwise("价格待确认")
    )


def missing_short(state: Column) -> Column:
    """Why a market shows no price, short text."""
    return (
        F.when(state == "unavailable", "不可用")
        .when(state == "not-public", "未公开")
        .when(state == "verified", "未提供")
        .otherwise("待复核")
    )


def client_kind(user_agent: Column, platform: Column, touch_points: Column) -> Column:
    """wechat, ios (also a tablet that claims to be a desktop) or other."""
    desktop_tablet = F.coalesce((platform == "MacIntel") & (touch_points > 1), F.lit(False))
    agent = F.coalesce(user_agent, F.lit(""))
    return (
        F.when(agent.rlike("(?i)MicroMessenger|wxwork"), "wechat")
        .when(agent.rlike("(?i)iPhone|iPad|iPod") | desktop_tablet, "ios")
        .otherwise("other")
    )
