from pyspark.sql import functions as F

from marketladder.functions import plans, status, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def fnv(value):
    digits, h = "0123456789abcdefghijklmnopqrstuvwxyz", 0x811C9DC5
    for c in value:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = digits[r] + out
    return out


def test_plan_ids(spark):
    for name, n in [("ChatGPT Plus", 0), ("月卡 Pro+", 3), ("Emoji 😀 pack", 1), ("---", 0), ("Ünïcode", 2)]:
        got = one(spark, plans.plan_id(F.lit(name), F.lit(n).cast("bigint")))
        assert got.endswith(f"-{n + 1}-{fnv(name + chr(0) + str(n))}")
    assert one(spark, plans.plan_id(F.lit("Gold Pass!"), F.lit(0).cast("bigint"))).startswith("auto-gold-pass-1-")
    assert one(spark, plans.slug(F.lit("***"))) == "item"


def test_groups_fold_case_outside_ascii(spark):
    names = F.array(F.lit("x"))
    assert one(spark, plans.display_group(F.lit("公开项目"), F.lit("POKÉCOINS"), names)) == "other"
    assert one(spark, plans.display_group(F.lit("公开项目"), F.lit("Premium"), names)) == "primary"
    assert one(spark, plans.display_group(F.lit("月付"), F.lit("100 Credits"), names)) == "primary"


def test_search_keys_and_ids(spark):
    assert one(spark, text.search_key(F.lit(" Ｃhat　GPT！+ (Pro)"))) == "chatgptpro"
    assert one(spark, text.parse_app_id(F.lit("https://a.test/us/app/example/id123456789?l=en"))) == "123456789"
    assert one(spark, text.parse_app_id(F.lit("123"))) is None
    assert one(spark, text.strip(F.lit("  a b　"))) == "a b"


def test_client_kind(spark):
    def kind(agent, platform="", touch=0):
        return one(spark, text.client_kind(F.lit(agent), F.lit(platform), F.lit(touch)))

    assert kind("x MicroMessenger/8") == "wechat"
    assert kind("x (iPhone)") == "ios"
    assert kind("Macintosh", "MacIntel", 5) == "ios"
    assert kind("Macintosh", "MacIntel", 0) == "other"


def test_source_urls(spark):
    def url(source, service, region, host):
        return one(spark, text.source_url(F.lit(source), F.lit(service), F.lit("1"), F.lit(region), F.lit(host)))

    assert url("apple-service", "icloud-plus", "cn", "h") == "https://support.apple.com/en-us/108047"
    assert url("apple-service", "apple-one", "jp", "https://www.apple.com/jp") == "https://www.apple.com/jp/apple-one/"
    assert url("apple-service", "apple-tv-plus", "us", "https://www.apple.com") == "https://www.apple.com/apple-tv/"
    assert url("apple-service", "apple-tv-plus", "tr", "h") == "https://www.apple.com/tr/tv-home/"
    assert url(None, None, "us", "h") == "https://apps.apple.com/us/app/id1"


def test_publishable(spark):
    def ok(s, declared, actual):
        return one(spark, status.is_publishable(F.lit(s), F.lit(declared), F.lit(actual)))

    assert ok("ok-itemsV3", 1, 1) and ok("error:HTTP 404", 0, 0)
    assert not ok("error:HTTP 500", 0, 0) and not ok("ok-itemsV3", 2, 1) and not ok("ok-itemsV3", 0, 0)
    assert not ok(None, 0, 0)
