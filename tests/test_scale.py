"""Work that grew in one task, or was done again and again, on larger tables."""

import datetime
import random

from pyspark.sql import functions as F

from marketladder.functions import amounts
from marketladder.operators import search, search_index
from marketladder.plans import fixtures, q_matching, q_quality, q_search

APPS = "app_id string, app_name string, developer string, place int"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, folder):
    """A few orders of a few parts as the star schema's files."""
    day = datetime.datetime(1998, 7, 2)
    lines = [(o, o % 6, o % 4, 1, float(1 + o % 50), day - datetime.timedelta(days=o % 3)) for o in range(60)]
    spark.createDataFrame(
        lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"
    ).write.parquet(f"{folder}/lineitem.parquet")
    parts = [(p, f"old ring {p}", f"Brand#{p}", "SMALL", p) for p in range(6)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(s, s + 1) for s in range(4)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(n, f"N{n}") for n in range(6)], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def test_a_catalog_in_one_file_is_dealt_out_before_terms_multiply_it(spark):
    apps = spark.createDataFrame([("1", "Twin", "", 1)], APPS).coalesce(1)
    number = spark.conf.get("spark.sql.shuffle.partitions")
    for function in (search.search_rank, search.search_curated, search.resolve_unique):
        plan = plan_of(function(apps, ["twin", "x"]))
        assert plan.index("Generate inline") < plan.index("RepartitionByExpression"), function
        assert f"], {number}" in plan


def test_only_matching_rows_stay_beside_a_term(spark):
    rows = [("1", "Twin A", "Maker", 3), ("2", "Other", "Twin Ltd", 2), ("3", "Third", None, None), ("3", "Third b", "", 1), (None, "No id", "", 9)]
    apps = spark.createDataFrame(rows, APPS)
    got = {}
    for r in search.search_rank(apps, ["twin", "nothing", "nothing", "no id"], limit=3).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((r.app_id, r.app_name, r.score, r["rank"]))
    assert got == {
        "twin": [("1", "Twin A", 1, 1), ("2", "Other", 4, 2)],
        "nothing": [("3", "Third", 9, 1), ("2", "Other", 9, 2), ("1", "Twin A", 9, 3)],
        "no id": [(None, "No id", 0, 1)],
    }
    assert "score" in plan_of(search.search_rank(apps, ["twin"])) and "Union" in plan_of(search.search_rank(apps, ["twin"]))


def test_postings_of_a_catalog_are_many_files(spark, monkeypatch):
    monkeypatch.setattr(search_index, "TASK_ROWS", 10, raising=False)
    apps = spark.createDataFrame([(str(n), f"app {n}", "maker", n) for n in range(40)], APPS).coalesce(1)
    index = search_index.build(apps)
    assert len(index.postings.inputFiles()) == 4
    assert index.rows.count() == 40


def test_terms_are_made_in_many_tasks(spark, tmp_path):
    assert "RepartitionByExpression" in plan_of(q_search.wanted(spark, tables(spark, tmp_path)))


def test_log_rows_are_dealt_out_before_they_are_counted(spark, tmp_path):
    flagged = q_matching._known(spark, tables(spark, tmp_path))
    plan = plan_of(flagged)
    assert plan.index("Aggregate [l_orderkey") < plan.index("RepartitionByExpression [l_orderkey")
    assert flagged.agg(F.sum("rows")).first()[0] == 60


def test_texts_of_parts_and_suppliers_are_made_once_each(spark, tmp_path):
    plan = plan_of(fixtures.observations(spark, tables(spark, tmp_path)))
    joins = plan.index("Join Inner")
    assert "lpad" not in plan[:joins] and "concat_ws" not in plan[:joins]


def test_rules_of_a_snapshot_read_stored_tables(spark, tmp_path):
    candidate, _, previous = q_quality.snapshot_tables(spark, tables(spark, tmp_path))
    for table in (candidate["cells"], candidate["items"], previous["cells"]):
        assert "Join" not in plan_of(table)


def test_usual_amounts_are_read_by_one_match_with_the_same_value(spark):
    pick = random.Random(7)
    texts = ["".join(pick.choice("0123456789.,.,$€ dcRx\n") for _ in range(pick.randint(0, 9))) for _ in range(4000)]
    texts += ["$12.99", "12,99 €", "¥12,000", "12.000đ", "$0.99", ".99", "12.", "1,234.56", "1.234,56", "1,2345", "12,00,00", "١٢", "", "9" * 400, "12\n", "12,99\n5"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for lone_comma in (amounts._lone_comma_after_thousands, amounts._lone_comma_is_decimal):
        slow = amounts._stepwise(amounts._kept(F.col("t")), lone_comma)
        differing = rows.filter(~slow.eqNullSafe(amounts._amount(F.col("t"), lone_comma))).collect()
        assert differing == []
    assert "[0-9]{2})?)[^0-9.,]*$" in plan_of(rows.select(amounts.numeric_price(F.col("t"))))
