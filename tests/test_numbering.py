import random

from pyspark.sql import functions as F

from marketladder.operators import diff, items, state
from marketladder.operators.numbering import number_in_group, position_range


def test_numbers_equal_row_number_whatever_the_width(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), p) for p in rng.sample(range(5000), 900)]  # one key owns most rows
    df = spark.createDataFrame(data, "k string, pos bigint")
    expected = {}
    for key in "ab":
        for n, p in enumerate(sorted(p for k, p in data if k == key)):
            expected[(key, p)] = n
    for width in (1, 7, 1000, 10**6):
        out = number_in_group(df, ["k"], ["pos"], position_range("pos", width), "n").collect()
        assert {(r.k, r.pos): r.n for r in out} == expected


def test_bag_difference_on_a_hot_item(spark):
    rng = random.Random(5)
    keys = ["app_id", "region", "name", "price"]

    def side(n):
        return [("1", "us", "N", rng.choice(["$1", "$1", "$1", "$2"]), p) for p in rng.sample(range(10_000), n)]

    left, right = side(700), side(400)
    schema = "app_id string, region string, name string, price string, pos bigint"
    out = diff.bag_difference(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), keys, position_range("pos", 50)
    )
    remaining, expected = [r[3] for r in right], []
    for row in sorted(left, key=lambda r: r[4]):
        if row[3] in remaining:
            remaining.remove(row[3])
        else:
            expected.append((row[3], row[4]))
    assert sorted((r.price, r.pos) for r in out.collect()) == sorted(expected)


def test_top_one_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("1", "us", "p", "N", "$1", 0)], "app_id string, region string, product_id string, name string, price string, pos bigint")
    plan = items.dedupe_by_product(df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    requests = spark.range(10).selectExpr("id AS key", "CAST(timestamp_seconds(id) AS timestamp_ntz) AS ts", "id AS event_id")
    assert "WindowGroupLimit" in state.rate_cap(requests, 3)._jdf.queryExecution().toString()


def test_normalize_items_keeps_the_first(spark, rows):
    data = [("1", "us", 0, " A ", "$1"), ("1", "us", 1, "A", "$1"), ("1", "us", 2, "", "$1"), ("1", "us", 3, "A ", "$2")]
    df = spark.createDataFrame(data, "app_id string, region string, pos bigint, name string, price string")
    assert rows(items.normalize_items(df), "name", "price", "pos") == [("A", "$1", 0), ("A", "$2", 3)]


def test_upper_median_of_ratios(spark):
    data = []
    for i, second in enumerate(["$6.00", "$20.00", "$8.00", "$12.00"]):
        data += [("1", f"r{i}", "N", 0, "$1.00"), ("1", f"r{i}", "N", 1, second)]
    df = spark.createDataFrame(data, "app_id string, region string, name string, occurrence bigint, price string")
    assert items.price_ratio_median(df).first().ratio == 12.0


def test_exclusions_ignore_case(spark):
    df = spark.createDataFrame([("1", "Pro"), ("1", "Lite"), ("2", "Pro")], "app_id string, name string")
    listed = spark.createDataFrame([("1", "PRO")], "app_id string, name string")
    assert items.exclude_items(df, listed).orderBy("app_id").select(F.concat("app_id", "name")).collect() == [
        ("1Lite",), ("2Pro",)
    ]
