import random

import pytest
from pyspark.sql import functions as F

from marketladder.operators import carry, diff

CELL = "app_id string, region string, status string, item_count bigint"
ITEM = "app_id string, region string, pos bigint, name string, price string"


def snapshot(spark, items, status="ok-itemsV3"):
    cells = spark.createDataFrame([("1", "us", status, len(items))], CELL)
    return cells, spark.createDataFrame([("1", "us", i, n, p) for i, (n, p) in enumerate(items)], ITEM)


def compare(spark, before, after):
    (bc, bi), (ac, ai) = before, after
    changes = diff.item_changes(bc, ac, bi, ai)
    return diff.snapshot_diff(bc, ac, changes), changes


def test_reordering_is_no_change(spark):
    a, b = ("Monthly", "$9.99"), ("Annual", "$99.99")
    cells, changes = compare(spark, snapshot(spark, [a, b]), snapshot(spark, [b, a]))
    assert cells.count() == 0 and changes.count() == 0
    assert diff.diff_fingerprint(cells, changes).first().fingerprint == "none"


def test_price_change_is_an_update(spark):
    cells, changes = compare(spark, snapshot(spark, [("Monthly", "$9.99")]), snapshot(spark, [("Monthly", "$10.99")]))
    assert [(r.kind, r.before_price, r.after_price) for r in changes.collect()] == [("updated", "$9.99", "$10.99")]
    r = cells.first()
    assert (r.updated, r.removed, r.added) == (1, 0, 0)
    assert diff.short_lines(cells, changes).first().line == "Monthly $9.99→$10.99"
    assert [tuple(r)[2:] for r in diff.notification_lines(cells, changes).collect()] == [("Monthly $9.99→$10.99", 0)]


def test_states_stay_distinct_and_hide_items(spark):
    cells, _ = compare(spark, snapshot(spark, [], "official-price-page-missing"), snapshot(spark, [], "service-unavailable"))
    assert (cells.first().before_state, cells.first().after_state) == ("official-price-unpublished", "service-unavailable")
    cells, changes = compare(spark, snapshot(spark, [("Monthly", "$9.99")]), snapshot(spark, [], "error:parser-changed"))
    assert (cells.first().after_state, cells.first().removed, changes.count()) == ("parse-failed", 0, 0)


def test_catalog_additions_are_not_changes(spark):
    cells, _ = snapshot(spark, [("Monthly", "$9.99")])
    none = spark.createDataFrame([], CELL)
    assert [(r.type, r.app_id) for r in diff.catalog_diff(none, cells).collect()] == [("app-added", "1")]


def test_pairs_follow_the_multiset_rule(spark):
    rng = random.Random(11)
    for _ in range(3):
        before = [(rng.choice("AB"), rng.choice(["$1", "$2", "$3"])) for _ in range(40)]
        after = [(rng.choice("AB"), rng.choice(["$1", "$2", "$3"])) for _ in range(30)]

        def minus(left, right):
            left_over, rest = [], list(right)
            for row in left:
                if row in rest:
                    rest.remove(row)
                else:
                    left_over.append(row)
            return left_over

        removed, added, expected = minus(before, after), minus(after, before), []
        for name in "AB":
            gone = [p for n, p in removed if n == name]
            new = [p for n, p in added if n == name]
            for i in range(max(len(gone), len(new))):
                expected.append((name, gone[i] if i < len(gone) else None, new[i] if i < len(new) else None))
        _, changes = compare(spark, snapshot(spark, before), snapshot(spark, after))
        got = [(r.name, r.before_price, r.after_price) for r in changes.collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_fingerprint_ignores_neighbours_but_not_order(spark):
    def print_of(before, after):
        return diff.diff_fingerprint(*compare(spark, snapshot(spark, before), snapshot(spark, after))).first().fingerprint

    base = print_of([("A", "$1"), ("B", "$2")], [("A", "$5"), ("B", "$2")])
    moved = print_of([("B", "$2"), ("A", "$1")], [("B", "$2"), ("A", "$5")])
    other = print_of([("A", "$1"), ("B", "$2")], [("A", "$6"), ("B", "$2")])
    assert base == moved and base != other and len(base) == 20
    one = print_of([("A", "$1"), ("B", "$2")], [("A", "$3"), ("B", "$4")])
    two = print_of([("B", "$2"), ("A", "$1")], [("B", "$4"), ("A", "$3")])
    assert one != two


def test_log_is_idempotent_and_whole(spark):
    schema = "entry_id string, published_at string, change_count bigint"
    log = spark.createDataFrame([(f"old-{i}", f"2026-01-01 {i:03d}", 1) for i in range(131)], schema)
    new = spark.createDataFrame([("f1", "2026-03-01", 2), ("old-0", "2026-03-01", 2), ("none", "2026-03-02", 1)], schema)
    once = diff.append_change_log(log, new)
    assert once.count() == 132 and diff.latest_n(once).count() == 30 and diff.latest_n(once).first().entry_id == "f1"
    twice = diff.append_change_log(once, new.withColumn("published_at", F.lit("2026-04-01")))
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}


def test_message_about_a_change(spark):
    cells, changes = compare(spark, snapshot(spark, [("Monthly", "$9.99")]), snapshot(spark, [("Monthly", "$10.99")]))
    names = spark.createDataFrame([("1", "Example")], "app_id string, matched_name string")
    named = diff.name_apps(cells, names, names)
    lines = [r.line for r in diff.notification(named, changes).orderBy("place").collect()]
    assert lines == ["发现 1 个应用/地区发生变化：", "Example / US：Monthly $9.99→$10.99", "系统会短时复查；两次结果一致后自动发布。"]
    many = named.withColumn("region", F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string"))))
    lines = [r.line for r in diff.notification(many, changes.filter("false")).orderBy("place").collect()]
    assert len(lines) == 11 and lines[9] == "另有 2 处变化" and lines[1] == "Example / 1：内容变化"
    texts = [r[0] for r in spark.range(2).select(diff.published_line(F.col("id") * 3)).collect()]
    assert texts == ["本次检查未发现订阅变动，网站数据无需更新。", "已确认并上线 3 个应用/地区的订阅变化。"]


def test_malformed_log_rows_are_dropped(spark):
    columns = "entry_id string, type string, app_id string, app_name string, region string, before_state string, after_state string, kind string, name string, before_price string, after_price string, status string"
    rows = [
        ("e", "region-items-changed", "1", "A", "us", None, None, "updated", "N", "$1", "$2", "internal"),
        ("e", "region-items-changed", "1", "A", "us", None, None, "updated", "N", "$1", None, "internal"),
        ("e", "region-items-changed", "1", "A", "us", None, None, "removed", None, "$1", None, "internal"),
        ("e", None, "1", "A", "us", None, None, None, None, None, None, None),
        ("e", "app-added", "1", "A", None, None, None, None, None, None, None, None),
        ("e", "app-added", "2", None, None, None, None, None, None, None, None, None),
    ]
    kept = diff.well_formed_changes(spark.createDataFrame(rows, columns))
    assert kept.count() == 2 and "status" not in kept.columns


REGION = "app_id string, region string, status string, identity_status string, declared bigint, actual bigint"


def resolve(spark, candidate, previous=None):
    old = spark.createDataFrame([("1", "us", *previous)] if previous else [], REGION)
    return carry.resolve_fallback(spark.createDataFrame([("1", "us", *candidate)], REGION), old).first()


def test_fallback(spark):
    r = resolve(spark, ("error:HTTP 500", None, 0, 0), ("ok-itemsV3", None, 1, 1))
    assert (r.choice, r.reason, r.status) == ("previous", "error:HTTP 500", "ok-itemsV3")
    assert resolve(spark, ("error:parser-changed", None, 0, 0)).choice == "defer"
    r = resolve(spark, ("ok-textPairs", "error:HTTP 429", 1, 1), ("ok-structured", None, 1, 1))
    assert (r.choice, r.reason) == ("previous", "identity:error:HTTP 429")
    r = resolve(spark, ("ok-textPairs", "catalog-iap-view-missing", 1, 1))
    assert (r.choice, r.reason) == ("candidate", None)


def test_verified_time_only_moves_without_fallback(spark):
    now = spark.createDataFrame([("1", None), ("2", None), ("3", None)], "app_id string, verified_at string")
    old = spark.createDataFrame([("1", "old-1"), ("2", None)], "app_id string, verified_at string")
    held = spark.createDataFrame([("1",), ("2",)], "app_id string")
    out = carry.stamp_verified(now, old, held, F.lit("run"), F.lit("snapshot"))
    assert {r.app_id: r.verified_at for r in out.collect()} == {"1": "old-1", "2": "snapshot", "3": "run"}


SUMMARY = "app_id string, source string, plan_count bigint, structured_plans bigint, unresolved_plans bigint, degraded_regions bigint"


@pytest.mark.parametrize(
    ("previous", "candidate", "expected"),
    [
        (("live", 2, 2, 0, 0), ("live", 2, 0, 2, 1), ("retain", "curated-identity-degraded")),
        (None, ("live", 2, 0, 2, 1), ("reject", "curated-identity-degraded")),
        (("live", 2, 2, 0, 0), ("live", 2, 0, 0, 0), ("retain", "structured-identity-regressed")),
        (("live", 2, 2, 0, 1), ("live", 2, 2, 0, 2), ("retain", "regional-identity-degraded")),
        (("snapshot", 2, 1, 0, 0), ("live", 2, 0, 0, 5), ("accept", "identity-quality-accepted")),
    ],
)
def test_record_selection(spark, previous, candidate, expected):
    old = spark.createDataFrame([("1", *previous)] if previous else [], SUMMARY)
    r = carry.select_record(old, spark.createDataFrame([("1", *candidate)], SUMMARY)).first()
    assert (r.action, r.reason) == expected


def test_metadata_groups(spark):
    inline = F.when(F.col("app_id") == "1", F.struct(F.lit("N").alias("matched_name"), F.lit("D").alias("developer"), F.lit("Games").alias("category")))
    catalog = spark.createDataFrame([("1",), ("2",)], "app_id string").select(
        "app_id", inline.alias("inline"), F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("string").alias("configured_group"), F.when(F.col("app_id") == "1", "own").alias("inline_group"),
    )
    found = spark.createDataFrame([("2", "M", "E", "Music")], "app_id string, matched_name string, developer string, category string")
    out = carry.resolve_metadata(catalog, found, found.filter("false")).collect()
    assert {r.app_id: (r.origin, r.query, r.catalog_group) for r in out} == {"1": ("inline", "N", "own"), "2": ("lookup", "M", "影音娱乐")}
