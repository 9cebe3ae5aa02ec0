import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketladder.operators import quality, search, state
from marketladder.streaming import state as streams

START = datetime(2024, 1, 1)
SCHEMA = "key bigint, ts timestamp_ntz, event_id bigint"


def make(seed, n, minutes):
    """One key owns most requests; some share a time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if rng.random() < 0.7 else rng.randint(2, 5)
        rows.append((key, START + timedelta(seconds=rng.randint(0, minutes * 60)), i))
    return rows


def greedy(rows, seconds):
    out, last = set(), {}
    for key, ts, event_id in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or (ts - last[key]).total_seconds() >= seconds:
            last[key] = ts
            out.add((key, event_id))
    return out


def test_cooldown_agrees_with_the_greedy_rule(spark):
    for seed, n, minutes, seconds in [(1, 800, 3000, 1800), (2, 900, 40, 60), (3, 400, 9000, 1800), (4, 300, 2, 7200), (5, 50, 20000, 60)]:
        rows = make(seed, n, minutes)
        got = state.cooldown(spark.createDataFrame(rows, SCHEMA), seconds)
        assert {(r.key, r.event_id) for r in got.collect()} == greedy(rows, seconds)


def test_cooldown_runs_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = make(6, 500, 600)
        got = state.cooldown(spark.createDataFrame(rows, SCHEMA), 300)
        assert {(r.key, r.event_id) for r in got.collect()} == greedy(rows, 300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cooldown_composes_blocks_in_a_tree(spark):
    """One hot key over hundreds of blocks, two and three neighbours composed at a time: no task sees a key's whole chain."""
    for seed, n, minutes, seconds, fan in [(21, 900, 9000, 60, 2), (22, 700, 4000, 30, 3), (23, 300, 40_000, 300, 2)]:
        rows = make(seed, n, minutes)
        got = state.cooldown(spark.createDataFrame(rows, SCHEMA), seconds, fan)
        assert {(r.key, r.event_id) for r in got.collect()} == greedy(rows, seconds)


def test_composed_maps_do_as_one_after_the_other():
    rng = random.Random(3)
    for _ in range(300):
        times = [sorted(rng.sample(range(a, a + 40), rng.randint(1, 6))) for a in (0, 40, 80)]
        maps = []
        for own in times:  # every row an entry, each chain followed
            leave = []
            for at in own:
                while any(x >= at + 7 for x in own):
                    at = next(x for x in own if x >= at + 7)
                leave.append(at)
            maps.append((own, leave))
        whole = state._composed(state._composed(maps[0], maps[1], 7), maps[2], 7)
        other = state._composed(maps[0], state._composed(maps[1], maps[2], 7), 7)
        for start in [None, *range(130)]:
            last, at = None, start
            for own in maps:
                found = state._first_reaching(*own, at)
                last, at = (last, at) if found is None else (found, found + 7)
            assert state._first_reaching(*whole, start) == state._first_reaching(*other, start) == last


def test_lookup_does_not_depend_on_the_bucket(spark):
    rng = random.Random(9)
    rows = make(9, 300, 600)
    kinds = list(state.TTL_SECONDS)
    puts = [(k, t, i, rng.choice(kinds), float(i)) for k, t, i in rows[::3]]
    reads = [r for i, r in enumerate(rows) if i % 3]
    expected = {}
    for key, ts, event_id in reads:
        before = [p for p in puts if p[0] == key and (p[1], p[2]) <= (ts, event_id)]
        last = max(before, key=lambda p: (p[1], p[2]), default=None)
        alive = last and (ts - last[1]).total_seconds() < state.TTL_SECONDS[last[3]]
        expected[event_id] = last[4] if alive else None
    put_frame = spark.createDataFrame(puts, SCHEMA + ", kind string, payload double")
    for seconds in ([60], [3600, 10], [10**7], [86400, 3600, 60]):
        got = state.lookup_ttl(put_frame, spark.createDataFrame(reads, SCHEMA), seconds)
        assert {r.event_id: r.payload for r in got.collect()} == expected


def test_seeds_and_records(spark):
    now = F.lit("2026-08-30 12:00:00").cast("timestamp_ntz")
    schema = "key bigint, generated_at timestamp_ntz, payload double"
    hour = datetime(2026, 8, 30)
    records = [(1, None, 0.0), (2, hour + timedelta(hours=11), 0.0), (3, hour + timedelta(hours=9), 0.0)]
    seeds = [(k, hour + timedelta(hours=10), 1.0) for k in (1, 2, 3, 4)] + [(5, hour - timedelta(days=8), 1.0), (6, None, 1.0)]
    out = state.merge_latest(spark.createDataFrame(records, schema), spark.createDataFrame(seeds, schema), now)
    assert {r.key: r.origin for r in out.collect()} == {1: "seed", 2: "record", 3: "seed", 4: "seed"}


CLOSING = (-1, START + timedelta(days=30), -1)


@pytest.fixture
def few_tasks(spark):
    """Each task of a stateful operator starts a Python worker in each micro-batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_streams_agree_with_the_batch_forms(spark, tmp_path, few_tasks):
    """Several micro-batches that overlap by up to 40 minutes, with a watermark of an hour."""
    rng = random.Random(12)
    rows = sorted(make(12, 240, 300), key=lambda r: r[1] + timedelta(minutes=rng.randint(0, 40)))
    log = spark.createDataFrame(rows, SCHEMA)
    for part in [rows[at : at + 60] for at in range(0, 240, 60)] + [[CLOSING], [CLOSING]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert max(r[1] for r in rows[:60]) > min(r[1] for r in rows[60:120])

    def stream():
        return streams.request_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, files_per_trigger=1)

    def ids(df, *columns):
        return {tuple(r) for r in df.filter("event_id >= 0").select(*columns).collect()}

    got = streams.run_to_table(streams.cooldown_stream(stream()), str(tmp_path / "cooldown"))
    assert ids(got, "key", "event_id") == ids(state.cooldown(log), "key", "event_id")
    got = streams.run_to_table(streams.rate_cap_stream(stream(), 5, 600), str(tmp_path / "cap"))
    assert ids(got, "event_id", "place") == ids(state.rate_cap(log, 5, 600), "event_id", "place")
    put = F.col("event_id") % 3 == 0
    kind, payload = F.when(put, "search-hit"), F.when(put, F.col("event_id").cast("double"))
    marked = stream().select("key", "ts", "at_ms", "event_id", put.alias("is_put"), kind.alias("kind"), payload.alias("payload"))
    got = streams.run_to_table(streams.lookup_stream(marked), str(tmp_path / "lookup"))
    puts = log.filter(put).select("key", "ts", "event_id", F.lit("search-hit").alias("kind"), F.col("event_id").cast("double").alias("payload"))
    assert ids(got, "event_id", "payload") == ids(state.lookup_ttl(puts, log.filter(~put)), "event_id", "payload")


def test_a_late_read_does_not_see_a_later_put(spark, tmp_path, few_tasks):
    at = lambda minute: START + timedelta(minutes=minute)
    schema = SCHEMA + ", is_put boolean, kind string, payload double"
    put = lambda m, i: (1, at(m), i, True, "search-hit", float(m))
    parts = [[put(30, 1)], [put(20, 2), (1, at(10), 3, False, None, None), (1, at(31), 4, False, None, None)]]
    for part in [*parts, [(*CLOSING, False, None, None)], [(*CLOSING, False, None, None)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = streams.request_stream(spark, str(tmp_path / "in"), "*.parquet", schema, files_per_trigger=1)
    got = streams.run_to_table(streams.lookup_stream(log), str(tmp_path / "out")).filter("event_id > 0").collect()
    assert {r.event_id: r.payload for r in got} == {3: None, 4: 30.0}


def merged(spark, tmp_path, records, parts, now="2024-01-02 00:00:00"):
    """The table after a micro-batch for each part of seeds, and the log of changes."""
    root = str(tmp_path / "table")
    streams.start_records(spark.createDataFrame(records, streams.RECORD), root)
    schema = "key bigint, generated_at timestamp_ntz, event_id bigint, payload double"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.merge_latest_stream(source, root, now, str(tmp_path / "checkpoint")).awaitTermination()
    changes = sorted(tuple(r) for r in spark.read.schema(streams.CHANGE).parquet(f"{root}/changes").select("key", "event_id", "payload").collect())
    return {r.key: r.payload for r in streams.current_records(spark, root).collect()}, changes


def test_merging_emits_only_what_changed(spark, tmp_path, few_tasks):
    hour = lambda h: START + timedelta(hours=h)
    records = [(k, hour(5), 0.0) for k in range(200)] + [(400, None, 0.0)]
    parts = [[(1, hour(4), 1, 1.0), (2, hour(6), 2, 1.0), (3, hour(5), 9, 9.0)], [(1, hour(7), 3, 2.0), (2, hour(5), 4, 2.0)], [(1, hour(8), 5, 3.0)], [(300, hour(1), 6, 3.0), (400, hour(0), 7, 4.0)]]
    got, changes = merged(spark, tmp_path, records, parts)
    assert got == {k: 0.0 for k in range(200)} | {1: 3.0, 2: 1.0, 300: 3.0, 400: 4.0}
    assert changes == [(1, 3, 2.0), (1, 5, 3.0), (2, 2, 1.0), (300, 6, 3.0), (400, 7, 4.0)]


def test_refused_seeds_change_nothing(spark, tmp_path, few_tasks):
    """An old seed of a key without a record, an undated one, then good ones; of equally old seeds the larger event wins."""
    old, at = datetime(2023, 1, 1), START + timedelta(hours=1)
    parts = [[(2, old, 1, 1.0)], [(2, None, 2, 2.0)], [(2, at, 4, 4.0)], [(2, at, 3, 3.0)], [(2, at, 5, 5.0)]]
    got, changes = merged(spark, tmp_path, [(1, START, 0.0)], parts)
    assert got == {1: 0.0, 2: 5.0} and changes == [(2, 4, 4.0), (2, 5, 5.0)]


def test_seeds_merge_into_an_empty_table(spark, tmp_path, few_tasks):
    assert merged(spark, tmp_path, [], [[(7, START, 1, None)]]) == ({7: None}, [(7, 1, None)])


def test_a_stream_equals_the_batch_form_at_any_bucket(spark, tmp_path, few_tasks):
    """A hot key, late rows, ties; buckets of a second, a minute and longer than the interval."""
    rng = random.Random(31)
    rows = sorted(make(31, 200, 240) + [(1, START + timedelta(minutes=9), 900 + i) for i in range(5)], key=lambda r: r[1] + timedelta(minutes=rng.randint(0, 40)))
    log = spark.createDataFrame(rows, SCHEMA)
    for part in [rows[at : at + 70] for at in range(0, len(rows), 70)] + [[CLOSING], [CLOSING]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    expected = {(r.key, r.event_id) for r in state.cooldown(log, 300).collect()}
    for bucket_ms in (60_000, 3_600_000):
        stream = streams.request_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, files_per_trigger=1)
        got = streams.run_to_table(streams.cooldown_stream(stream, 300, bucket_ms), str(tmp_path / f"out{bucket_ms}"))
        assert {(r.key, r.event_id) for r in got.filter("event_id >= 0").collect()} == expected


def test_a_stream_keeps_its_state_by_shares_of_the_keys(spark, tmp_path, few_tasks):
    """Many keys with few rows, a missing key, ids that a double cannot hold: three shares, as the batch form decides."""
    big = 2**60
    rows = [(k, START + timedelta(minutes=(k * 7 + i * 25) % 2000), big + k * 3 + i) for k in range(150) for i in range(3)]
    rows = sorted([*rows, (None, START + timedelta(minutes=5), big - 1)], key=lambda r: r[1])
    log = spark.createDataFrame(rows, SCHEMA)
    for part in [rows[:200], rows[200:], [CLOSING], [CLOSING]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.request_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, files_per_trigger=1)
    got = streams.run_to_table(streams.cooldown_stream(stream, 1800, shares=3), str(tmp_path / "cooldown"))
    expected = {(r.key, r.event_id) for r in state.cooldown(log, 1800).collect()} | {(None, big - 1)}  # the batch form leaves out a missing key
    assert {(r.key, r.event_id) for r in got.filter("event_id >= 0").collect()} == expected
    put = F.col("event_id") % 3 == 1
    marked = stream.select("key", "ts", "at_ms", "event_id", put.alias("is_put"), F.when(put, "search-hit").alias("kind"), F.when(put, 1.5).alias("payload"))
    got = streams.run_to_table(streams.lookup_stream(marked, shares=3), str(tmp_path / "lookup")).filter("event_id >= 0")
    puts = log.filter(put).select("key", "ts", "event_id", F.lit("search-hit").alias("kind"), F.lit(1.5).alias("payload"))
    asked = {(r.key, r.event_id, r.payload) for r in state.lookup_ttl(puts, log.filter(~put)).collect()}
    assert any(r[2] for r in asked) and {(r.key, r.event_id, r.payload) for r in got.collect()} == asked | {(None, big - 1, None)}


def test_an_undated_record_is_as_old_as_can_be(spark):
    records = spark.createDataFrame([(1, None), (2, START)], "key bigint, generated_at timestamp_ntz")
    now = F.lit(START + timedelta(hours=1)).cast("timestamp_ntz")
    got = {r.key: (r.age, r.tier, r.refresh, r.answer) for r in state.cache_tier(records, now, F.lit("read"), F.lit(False), F.lit(False)).collect()}
    assert got == {1: (None, "expired", True, "pending"), 2: (3600, "fresh", False, "ready")}


def test_of_several_names_of_an_app_the_best_counts(spark):
    rows = [("1", "Gemini", "", 2), ("1", "Alpha gemini assistant", "", 1), ("2", "Twin B", "", 2), ("3", "Twin A", "", 5)]
    apps = spark.createDataFrame(rows, "app_id string, app_name string, developer string, place int")
    assert [(r.app_name, r.score) for r in search.resolve_unique(apps, ["gemini"]).collect()] == [("Gemini", 0)]
    ranked = search.search_rank(apps, ["twin"]).orderBy("rank").collect()
    assert [r.app_name for r in ranked] == ["Twin B", "Twin A"]  # result order, not the alphabet
    plan = search.search_rank(apps, ["twin"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("ArrowEvalPython")  # names are normalized below the terms


def test_ambiguous_names_resolve_to_nothing(spark):
    rows = [("1", "Notion Mail", "", 1), ("2", "Notion Calendar", "", 2), ("3", "Google Gemini", "Google", 3)]
    apps = spark.createDataFrame(rows, "app_id string, app_name string, developer string, place int")
    got = {r.query: r.app_id for r in search.resolve_unique(apps, ["notion", "gemini", "x"]).collect()}
    assert got == {"gemini": "3"}
    assert {r.query: r.app_id for r in search.search_curated(apps, ["notion", "google", "2"]).collect()} == {"google": "3", "2": "2"}


def clean(spark):
    """A snapshot that breaks no rule."""
    regions = spark.createDataFrame([(0, "us"), (1, "ph")], "ord bigint, region string")
    config = spark.createDataFrame([("1", 0, None, None, False), ("2", 1, None, None, False)], "app_id string, ord bigint, price_source string, catalog_group string, allow_all_empty boolean")
    apps = spark.createDataFrame([("1", 0, "A", "D", "i", "app-store", "Games", "游戏")], "app_id string, ord bigint, matched_name string, developer string, icon string, price_source string, category string, catalog_group string")
    cells = spark.createDataFrame([("1", "us", 0, "ok-structured", 1, 1), ("1", "ph", 1, "error:HTTP 404", 0, 0)], "app_id string, region string, place bigint, status string, declared bigint, actual bigint")
    found = spark.createDataFrame([("1", "us", "ok-structured", 0, "N", "$1", "123456")], "app_id string, region string, status string, pos bigint, name string, price string, product_id string")
    header = spark.createDataFrame([("2026-07-14T00:00:00.000Z", quality.SOURCE)], "generated_at string, source string")
    deferred = spark.createDataFrame([("2",)], "app_id string")
    candidate = {"header": header, "apps": apps, "regions": regions, "cells": cells, "items": found, "deferred": deferred}
    previous = {"apps": config.filter("app_id = '1'"), "cells": cells.select("app_id", "declared")}
    return candidate, {"apps": config, "regions": regions}, previous


def test_rules_are_silent_on_a_clean_snapshot(spark):
    assert quality.validate_snapshot(*clean(spark)).collect() == []


def test_rules_fire_on_broken_ones(spark):
    candidate, config, previous = clean(spark)
    candidate["items"] = candidate["items"].withColumn("price", F.lit("free")).withColumn("product_id", F.lit("x"))
    candidate["deferred"] = spark.createDataFrame([("2",), ("9",)], "app_id string")
    candidate["cells"] = candidate["cells"].withColumn("status", F.lit("error:HTTP 500"))
    broken = {r.rule for r in quality.validate_snapshot(candidate, config, previous).collect()}
    assert broken == {"V03", "V13", "V18", "V19"}
