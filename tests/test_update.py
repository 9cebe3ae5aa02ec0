from pyspark.sql import functions as F

from marketladder.operators import quality
from marketladder.plans import publish
from marketladder.plans.publish import publish_marker, published
from marketladder.plans.update import update

CELLS = "app_id string, region string, ord bigint, status string, identity_status string, item_count bigint"
ITEMS = "app_id string, region string, pos bigint, name string, price string, product_id string"
APPS = "app_id string, ord bigint, matched_name string, developer string, icon string, price_source string, category string, catalog_group string, verified_at string"
LOG = "entry_id string, published_at string, change_count bigint"
LOG_CHANGES = "entry_id string, type string, app_id string, app_name string, region string, before_state string, after_state string, kind string, name string, before_price string, after_price string"


def app(number, verified):
    return (str(number), number, "A", "D", "i", "app-store", "Games", "游戏", verified)


def snapshot(spark, prices, failed=()):
    """Two markets of three apps; ``failed`` cells could not be fetched."""
    cells, items = [], []
    for number in (1, 2, 3):
        for ord_, region in enumerate(("us", "ph")):
            if (number, region) in failed:
                cells.append((str(number), region, ord_, "error:HTTP 500", None, 0))
                continue
            cells.append((str(number), region, ord_, "ok-structured", None, 1))
            items.append((str(number), region, 0, "Plan", prices.get((number, region), "$1.00"), f"12345{number}"))
    return {"cells": spark.createDataFrame(cells, CELLS), "items": spark.createDataFrame(items, ITEMS)}


def test_an_update_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    regions = spark.createDataFrame([(0, "us"), (1, "ph")], "ord bigint, region string")
    config = {
        "apps": spark.createDataFrame([(str(n), n, None, None, False) for n in (1, 2, 3)], "app_id string, ord bigint, price_source string, catalog_group string, allow_all_empty boolean"),
        "regions": regions,
    }
    header = spark.createDataFrame([("2026-07-14T00:00:00Z", quality.SOURCE)], "generated_at string, source string")
    rates = spark.createDataFrame([("USD", 0.14)], "currency string, units double")
    previous = snapshot(spark, {})
    # App 3 is new and cannot be fetched in one market; app 2 fails in one market.
    previous = {k: v.filter("app_id <> '3'") for k, v in previous.items()}
    previous["apps"] = spark.createDataFrame([app(1, "t0"), app(2, "t0")], APPS)
    previous["log"] = spark.createDataFrame([("old", "2026-01-01", 1)], LOG)
    previous["log_changes"] = spark.createDataFrame([("old", "app-added", "7", "Seven", None, None, None, None, None, None, None)], LOG_CHANGES)
    candidate = snapshot(spark, {(1, "us"): "$2.00"}, failed={(2, "ph"), (3, "ph")})
    candidate |= {"apps": spark.createDataFrame([app(n, None) for n in (1, 2, 3)], APPS), "header": header, "regions": regions}

    done = update(candidate, previous, config, rates, root, "run-1", 1, "2026-07-14", "t0")
    assert done.published and done.violations.count() == 0
    assert {r.app_id: r.verified_at for r in published(spark, root, "apps").collect()} == {"1": "2026-07-14", "2": "t0"}
    changes = [(r.app_id, r.region, r.kind, r.before_price, r.after_price) for r in published(spark, root, "changes").collect()]
    assert changes == [("1", "us", "updated", "$1.00", "$2.00")]
    assert published(spark, root, "items").count() == 4
    log = published(spark, root, "log").orderBy(F.desc("published_at")).collect()
    assert [r.change_count for r in log] == [1, 1] and log[1].entry_id == "old"

    kept = {(r.entry_id, r.app_name, r.kind, r.after_price) for r in published(spark, root, "log_changes").collect()}
    assert kept == {("old", "Seven", None, None), (log[0].entry_id, "A", None, None), (log[0].entry_id, "A", "updated", "$2.00")}
    assert {(r.kind, r.app_id, r.reason) for r in published(spark, root, "report_cells").collect()} == {
        ("fallback", "2", "error:HTTP 500"), ("deferred", "3", "error:HTTP 500")
    }

    # A second update keeps the changes of the first.
    state = {name: published(spark, root, name) for name in ("cells", "items", "apps", "log", "log_changes")}
    later = snapshot(spark, {(1, "us"): "$3.00"}, failed={(3, "ph")})
    later |= {name: candidate[name] for name in ("apps", "header", "regions")}
    assert update(later, state, config, rates, root, "run-1b", 2, "2026-07-15", "t0").published
    again = [(r.app_name, r.after_price) for r in published(spark, root, "log_changes").filter("kind IS NOT NULL").collect()]
    assert sorted(again) == [("A", "$2.00"), ("A", "$3.00")] and published(spark, root, "log").count() == 3

    # Items that do not agree with the declared count break a rule.
    false = snapshot(spark, {(1, "us"): "$4.00"}, failed={(3, "ph")}) | {name: candidate[name] for name in ("apps", "header", "regions")}
    gone = previous | {"cells": previous["cells"].withColumn("item_count", F.lit(2).cast("bigint"))}
    false["cells"] = false["cells"].withColumn("item_count", F.when(F.col("item_count") > 0, 2).otherwise(0).cast("bigint"))
    wrong = update(false, gone, config, rates, root, "run-1c", 3, "2026-07-16", "t0")
    assert not wrong.published

    # A broken candidate leaves the published state as it is.
    candidate["items"] = candidate["items"].withColumn("price", F.lit("free"))
    broken = update(candidate, previous, config, rates, root, "run-2", 4, "2026-07-15", "t0")
    assert not broken.published and {r.rule for r in broken.violations.collect()} == {"V18"}
    assert [r.after_price for r in published(spark, root, "changes").collect()] == ["$3.00"]


def test_marker_depends_on_both_times(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "s string, r string")
    ids = [r[0] for r in df.select(publish_marker(F.col("s"), F.col("r"))).collect()]
    assert ids[0] == ids[2] != ids[1] and len(ids[0]) == 20


def test_one_version_has_one_writer(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: publish.commit(spark, root, 1, f"run-{n}"), range(8)))
    assert sum(won) == 1 and publish.head(spark, root) == (1, f"run-{won.index(True)}")
    assert not publish.commit(spark, root, 1, "late")
    (tmp_path / "versions" / f"{2:020d}").write_text("")  # a writer was lost here
    assert publish.head(spark, root) == (2, f"run-{won.index(True)}")
    assert publish.commit(spark, root, 3, "next") and publish.head(spark, root) == (3, "next")


def test_the_second_writer_validates_against_the_first(spark, tmp_path):
    root, one = str(tmp_path), spark.range(1)
    seen = []

    def validate(present):
        seen.append(present)
        if present is None:  # meanwhile another writer publishes
            assert publish.publish(root, "other", 1, {"t": spark.range(7)}, one.limit(0))
            return one.limit(0)
        return one.limit(0) if allowed else one

    allowed = False
    assert publish.publish_next(spark, root, "mine", {"t": one}, validate) is None
    assert seen == [None, "other"] and published(spark, root, "t").count() == 7
    allowed = True
    assert publish.publish_next(spark, root, "mine", {"t": one}, validate) == 2
    assert published(spark, root, "t").count() == 1
