"""Keyed state over request logs, in batch form: tiers, caps, cooldowns, lookups.

A key may own any share of the rows, so no operator here gathers a key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketladder.functions.text import millis
from marketladder.session import stored

HOUR = 3600
# Ages in seconds.
FRESH, STALE, HOT, MANUAL = 12 * HOUR, 7 * 24 * HOUR, 3 * HOUR, HOUR // 2
# Time to live per kind of stored value, in seconds.
TTL_SECONDS = {
    "record": 7 * 24 * HOUR,
    "search-hit": 6 * HOUR,
    "search-miss": 60,
    "negative": 6 * HOUR,
    "failure": 60,
    "rate-bucket": 120,
}
BLOCK_INTERVALS = 16
FAN = 256  # blocks, or parents of blocks, whose maps are composed by one task
NEVER = 1 << 62  # the age of what has no date


def age_seconds(ts: Column, now: Column) -> Column:
    """Whole seconds between two zone-less timestamps, never negative; null if undated."""
    seconds = F.floor((millis(now) - millis(ts)) / 1000).cast("bigint")
    return F.when(seconds < 0, F.lit(0).cast("bigint")).otherwise(seconds)


def cache_tier(
    records: DataFrame, now: Column, mode: Column, degraded: Column, incomplete: Column
) -> DataFrame:
    """fresh / stale / expired, and whether the record should be refreshed.

    An undated record is older than any limit; its shown age stays null.
    """
    shown = age_seconds(F.col("generated_at"), now)
    age = F.coalesce(shown, F.lit(NEVER))
    tier = F.when(age <= FRESH, "fresh").when(age <= STALE, "stale").otherwise("expired")
    normal = (age > FRESH) | incomplete | (degraded & (age > HOT))
    refresh = F.when(mode == "hot", age > HOT).otherwise(normal)
    return records.select(
        "*", shown.alias("age"), tier.alias("tier"), refresh.alias("refresh"),
        F.when(incomplete & (age <= STALE), "pending").when(age > STALE, "pending").otherwise("ready").alias("answer"),
    )


def merge_latest(records: DataFrame, seeds: DataFrame, now: Column) -> DataFrame:
    """A seed replaces an absent, undated or strictly older record.

    Both: key, generated_at, payload, one row per key.  Seeds older than seven
    days are ignored.
    """
    young = seeds.filter(age_seconds(F.col("generated_at"), now) <= STALE)
    new = young.select("key", F.struct("generated_at", "payload").alias("s"))
    old = records.select("key", F.struct("generated_at", "payload").alias("r"))
    newer = F.col("s").isNotNull() & (
        F.col("r").isNull() | F.col("r.generated_at").isNull() | (F.col("s.generated_at") > F.col("r.generated_at"))
    )
    return (
        old.join(new, "key", "full")
        .withColumn("w", F.when(newer, F.col("s")).otherwise(F.col("r")))
        .select(
            "key", F.col("w.generated_at").alias("generated_at"), F.col("w.payload").alias("payload"),
            F.when(newer, "seed").otherwise("record").alias("origin"),
        )
    )


def latest_per_key(rows: DataFrame, payload: str) -> DataFrame:
    """Newest row per key; combined map-side."""
    last = F.max(F.struct("ts", "event_id", payload))
    return rows.groupBy("key").agg(last.alias("l")).select(
        "key", F.col("l.ts").alias("generated_at"), F.col(f"l.{payload}").alias("payload")
    )


def time_bucket(ts: Column, seconds: int) -> Column:
    """Number of the tumbling bucket, counted from the epoch."""
    return F.floor(millis(ts) / F.lit(seconds * 1000)).cast("bigint")


def rate_cap(requests: DataFrame, n: int = 60, seconds: int = 60) -> DataFrame:
    """The first n requests of every tumbling bucket.

    The limit is applied inside each input partition before the shuffle, so a
    crowded bucket sends at most n rows per partition.
    """
    order = Window.partitionBy("bucket").orderBy("ts", "event_id")
    return (
        requests.withColumn("bucket", time_bucket(F.col("ts"), seconds))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .withColumn("place", F.col("place").cast("bigint"))
    )


def rate_summary(requests: DataFrame, n: int = 60, seconds: int = 60) -> DataFrame:
    """Requests, passed and refused per bucket; combined map-side."""
    return (
        requests.groupBy(time_bucket(F.col("ts"), seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("passed", F.least(F.col("requests"), F.lit(n).cast("bigint")))
        .withColumn("refused", F.col("requests") - F.col("passed"))
    )


def _runs(key: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Run number of each row; rows of one (key, block) are adjacent."""
    change = np.ones(len(key), dtype=bool)
    change[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
    return np.cumsum(change) - 1


def _whole_runs(batches: Iterator[pd.DataFrame], block: str = "block") -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no run of one key and one value of ``block`` is split."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        run = _runs(batch["key"].to_numpy(), batch[block].to_numpy())
        if held:
            tail, head = held[-1].iloc[-1], batch.iloc[0]
            continues = tail["key"] == head["key"] and tail[block] == head[block]
            if continues and run[-1] == 0:
                held.append(batch)
                continue
            if not continues:
                yield pd.concat(held, ignore_index=True)
                held = []
        whole = run < run[-1]
        if whole.any():
            yield pd.concat([*held, batch[whole]], ignore_index=True)
            held = []
        held.append(batch[~whole])
    if held:
        yield pd.concat(held, ignore_index=True)


def _jumps(batch: pd.DataFrame, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Run numbers, and for each row the next row an interval later (-1: none)."""
    run = _runs(batch["key"].to_numpy(), batch["block"].to_numpy())
    at = batch["at_ms"].to_numpy()
    span = int(at.max() - at.min()) + interval + 1
    line = run.astype(np.int64) * span + (at - at.min())
    target = np.searchsorted(line, line + interval)
    inside = target < len(line)
    same = inside.copy()
    same[inside] = run[target[inside]] == run[inside]
    return run, np.where(same, target, -1)


def _first_reaching(until: list[int], leave: list[int], start: int | None) -> int | None:
    """Where a chain that may enter from ``start`` on leaves a map of steps; None if it finds no row there."""
    at = 0 if start is None else bisect_left(until, start)
    return leave[at] if at < len(until) else None


def _composed(first: tuple[list[int], list[int]], then: tuple[list[int], list[int]], interval: int) -> tuple[list[int], list[int]]:
    """The map of two neighbouring stretches of time as one; neighbouring steps that leave by the same row are one."""
    until, leave = list(first[0]), []
    for last in first[1]:
        further = _first_reaching(*then, last + interval)
        leave.append(last if further is None else further)
    behind = bisect_right(then[0], until[-1]) if until else 0  # entries that find no row in the first stretch
    until += then[0][behind:]
    leave += then[1][behind:]
    ends = [i for i in range(len(until)) if i + 1 == len(until) or leave[i] != leave[i + 1]]
    return [until[i] for i in ends], [leave[i] for i in ends]


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, list[int], list[int]]]]]:
    """Each parent's rows, sorted, and the maps of its children in order of time: (child, untils, leaves)."""
    for batch in _whole_runs(batches, "parent"):
        run = _runs(batch["key"].to_numpy(), batch["parent"].to_numpy())
        for _, rows in batch.groupby(run, sort=False):
            children: list[tuple[int, list[int], list[int]]] = []
            for child, until, leave in zip(rows["block"].tolist(), rows["until"].tolist(), rows["leave"].tolist()):
                if not children or children[-1][0] != child:
                    children.append((child, [], []))
                children[-1][1].append(until)
                children[-1][2].append(leave)
            yield rows, children


def _entry_times(table: DataFrame, interval: int, fan: int) -> DataFrame:
    """From which time on each block may be entered: key, block, since; blocks without an accepted row are left out.

    A prefix composition over aligned parents of ``fan`` blocks: upwards, the
    maps of the children of a parent are composed into one; downwards, a parent
    that is entered from some time on tells its children theirs.  A task holds
    one parent's steps, whatever share of the log a key owns; there are as many
    levels as the logarithm of the number of blocks.
    """
    schema = table.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    key_type = table.schema["key"].dataType.simpleString()
    ends = table.agg(F.min("block").alias("low"), F.max("block").alias("high")).first()
    low, blocks = ends.low or 0, (ends.high or 0) - (ends.low or 0) + 1

    def by_parent(steps: DataFrame) -> DataFrame:
        return steps.withColumn("parent", F.floor(F.col("block") / F.lit(fan)).cast("bigint"))

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, children in _nodes(batches):
            until, leave = children[0][1:]
            for child in children[1:]:
                until, leave = _composed((until, leave), child[1:], interval)
            yield pd.DataFrame({"key": [rows["key"].iloc[0]] * len(until), "block": rows["parent"].iloc[0], "until": until, "leave": leave})

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, children in _nodes(batches):
            start = rows["since"].iloc[0]
            start = None if pd.isna(start) else int(start)
            found: list[tuple[int, int | None]] = []
            for child, until, leave in children:
                last = _first_reaching(until, leave, start)
                if last is not None:
                    found.append((child, start))
                    start = last + interval
            since = pd.array([s for _, s in found], dtype="Int64")
            yield pd.DataFrame({"key": [rows["key"].iloc[0]] * len(found), "block": [c for c, _ in found], "since": since})

    sort = ("key", "parent", "block", "until")
    levels = [table.withColumn("block", F.col("block") - F.lit(low))]
    while blocks > fan:
        levels[-1] = levels[-1] if len(levels) == 1 else stored(levels[-1])  # read on the way up and down
        up = by_parent(levels[-1]).repartition("key", "parent").sortWithinPartitions(*sort)
        levels.append(up.mapInPandas(compose, schema))
        blocks = -(-blocks // fan)
    since: DataFrame | None = None
    for steps in reversed(levels):
        rows = by_parent(steps)
        if since is None:
            rows = rows.withColumn("since", F.lit(None).cast("bigint"))
        else:
            rows = rows.join(since.withColumnRenamed("block", "parent"), ["key", "parent"])
        since = rows.repartition("key", "parent").sortWithinPartitions(*sort).mapInPandas(enter, f"key {key_type}, block bigint, since bigint")
    return since.withColumn("block", F.col("block") + F.lit(low))


def cooldown(requests: DataFrame, seconds: int = MANUAL, fan: int = FAN) -> DataFrame:
    """Requests accepted at least ``seconds`` after the key's last accepted one.

    Time is cut into blocks of sixteen intervals.  1. Equal (key, millisecond)
    rows are combined.  2. Per block, each row a chain may enter by gets the
    row the chain leaves by; chains soon meet, so neighbours that leave by the
    same row are combined and a block's map is a few steps.  3. The maps are
    composed in a tree, ``fan`` neighbours at a time, which gives the time from
    which each block is entered.  4. Every block is walked from there.  A block
    holds at most one row per millisecond of its span, and step 3 the few steps
    of ``fan`` blocks, whatever share of the log a key owns.
    """
    interval = seconds * 1000
    span = interval * BLOCK_INTERVALS
    distinct = (
        requests.withColumn("at_ms", millis(F.col("ts")))
        .groupBy("key", "at_ms")
        .agg(F.min("event_id").alias("event_id"))
        .withColumn("block", F.floor(F.col("at_ms") / F.lit(span)).cast("bigint"))
    )
    key_type = distinct.schema["key"].dataType.simpleString()

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _whole_runs(batches):
            run, jump = _jumps(batch, interval)
            at = batch["at_ms"].to_numpy()
            early = at - batch["block"].to_numpy() * span < interval
            # the first row behind the early ones of its run is an entry too
            previous_early = np.concatenate(([False], early[:-1]))
            starts = np.concatenate(([True], run[1:] != run[:-1]))
            candidate = early | (~early & (starts | previous_early))
            place = np.flatnonzero(candidate)
            last = place.copy()
            for _ in range(BLOCK_INTERVALS):
                step = jump[last]
                last = np.where(step >= 0, step, last)
            ends = np.ones(len(place), bool)  # the last of neighbours that leave by the same row
            ends[:-1] = (last[1:] != last[:-1]) | (run[place][1:] != run[place][:-1])
            yield pd.DataFrame(
                {
                    "key": batch["key"].to_numpy()[place][ends],
                    "block": batch["block"].to_numpy()[place][ends],
                    "until": at[place][ends],
                    "leave": at[last][ends],
                }
            )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _whole_runs(batches):
            _, jump = _jumps(batch, interval)
            taken = np.zeros(len(batch), dtype=bool)
            run = _runs(batch["key"].to_numpy(), batch["block"].to_numpy())
            late = np.flatnonzero(batch["at_ms"].to_numpy() >= batch["since"].to_numpy())
            current = late[np.unique(run[late], return_index=True)[1]]  # the first row of each block from then on
            while len(current):
                taken[current] = True
                step = jump[current]
                current = step[step >= 0]
            yield batch.loc[taken, ["key", "at_ms", "event_id"]]

    by_block = distinct.repartition("key", "block")
    table = by_block.sortWithinPartitions("key", "block", "at_ms").mapInPandas(
        entries, f"key {key_type}, block bigint, until bigint, leave bigint"
    )
    entered = _entry_times(stored(table), interval, fan).withColumn("since", F.coalesce("since", F.lit(-(2**62))))
    return (
        distinct.join(entered, ["key", "block"])
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "at_ms")
        .mapInPandas(walk, f"key {key_type}, at_ms bigint, event_id bigint")
    )


def last_before(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: Sequence[Column], values: dict[str, Column]
) -> DataFrame:
    """For each row the last non-null value at or before it, per key.

    A key is cut into buckets of its order, each cut again by the next of
    ``buckets``.  Inside the smallest a window finds the last value; from
    earlier ones it is carried over small tables, one level at a time, with a
    row per bucket.  So a task holds the rows of one smallest bucket, or the
    buckets within one larger, whatever share of the log a key owns.
    """
    keys, names = list(keys), list(values)
    levels = [f"__b{i}" for i in range(len(buckets))]
    rows = rows.withColumns(dict(zip(levels, buckets))).withColumns(values)
    at = F.struct(*order)
    last = [F.max(F.when(F.col(n).isNotNull(), F.struct(at.alias("at"), F.col(n).alias("v")))).alias(f"__l_{n}") for n in names]
    inside = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select(
        *[c for c in rows.columns if c not in names], *[F.last(n, ignorenulls=True).over(inside).alias(n) for n in names]
    )
    latest = rows.groupBy(*keys, *levels).agg(*last)
    for depth in reversed(range(len(levels))):
        outer = [*keys, *levels[:depth]]
        earlier = Window.partitionBy(*outer).orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        carried = latest.select(
            *outer, levels[depth], *[F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in names]
        )
        filled = filled.join(carried, [*outer, levels[depth]])
        for n in names:
            filled = filled.withColumn(n, F.coalesce(F.col(n), F.col(f"__c_{n}.v"))).drop(f"__c_{n}")
        latest = latest.groupBy(*outer).agg(*[F.max(f"__l_{n}").alias(f"__l_{n}") for n in names])
    return filled.drop(*levels)


def ttl_of(kind: Column) -> Column:
    seconds = F.lit(None).cast("bigint")
    for name, ttl in TTL_SECONDS.items():
        seconds = F.when(kind == name, F.lit(ttl).cast("bigint")).otherwise(seconds)
    return seconds


def time_levels(ts: Column, seconds: Sequence[int] = (6 * HOUR, 10)) -> list[Column]:
    """Buckets of time, each length a part of the one before."""
    return [time_bucket(ts, s) for s in seconds]


def lookup_ttl(puts: DataFrame, reads: DataFrame, bucket_seconds: Sequence[int] = (6 * HOUR, 10)) -> DataFrame:
    """Each read sees the latest earlier put of its key, unless it has expired.

    puts: key, ts, event_id, kind, payload; reads: key, ts, event_id.
    """
    stored = F.struct(F.col("ts").alias("put_ts"), F.col("kind").alias("kind"), F.col("payload").alias("payload"))
    log = puts.select("key", "ts", "event_id", "kind", "payload", F.lit(True).alias("is_put")).unionByName(
        reads.select(
            "key", "ts", "event_id", F.lit(None).cast("string").alias("kind"),
            F.lit(None).cast(puts.schema["payload"].dataType).alias("payload"), F.lit(False).alias("is_put"),
        )
    )
    seen = last_before(
        log, ["key"], ["ts", "event_id"], time_levels(F.col("ts"), bucket_seconds),
        {"stored": F.when(F.col("is_put"), stored)},
    ).filter(~F.col("is_put"))
    alive = age_seconds(F.col("stored.put_ts"), F.col("ts")) < ttl_of(F.col("stored.kind"))
    return seen.select(
        "key", "ts", "event_id",
        F.when(alive, F.col("stored.kind")).alias("kind"),
        F.when(alive, F.col("stored.payload")).alias("payload"),
        F.coalesce(alive, F.lit(False)).alias("hit"),
    )


def serve_decision(
    log: DataFrame, manual_allowed: DataFrame, bucket_seconds: Sequence[int] = (6 * HOUR, 10)
) -> DataFrame:
    """Answer of each read: ready fresh or stale, pending, or an error.

    log: key, ts, event_id, mode (read, hot, manual, put, error), usable,
    degraded (of a put), error (word of a marker).  A stored usable record
    always beats an error marker; storing a usable record clears the marker.
    ``manual_allowed``: key, event_id of manual requests the cooldown accepts.
    """
    record = F.when(
        F.col("mode") == "put", F.struct(F.col("ts").alias("at"), F.col("usable"), F.col("degraded"))
    )
    clears = (F.col("mode") == "put") & F.col("usable")
    marker = F.when(
        (F.col("mode") == "error") | clears,
        F.struct(F.col("ts").alias("at"), F.when(F.col("mode") == "error", F.col("error")).alias("word")),
    )
    seen = last_before(
        log, ["key"], ["ts", "event_id"], time_levels(F.col("ts"), bucket_seconds), {"record": record, "marker": marker}
    ).filter(F.col("mode").isin("read", "hot", "manual"))
    age = age_seconds(F.col("record.at"), F.col("ts"))
    known = F.coalesce(F.col("record.usable") & (age <= STALE), F.lit(False))
    marker_age = age_seconds(F.col("marker.at"), F.col("ts"))
    life = F.when(F.col("marker.word") == "refresh-failed", TTL_SECONDS["failure"]).otherwise(TTL_SECONDS["negative"])
    failed = F.coalesce(F.col("marker.word").isNotNull() & (marker_age < life), F.lit(False))
    normal = (age > FRESH) | (F.col("record.degraded") & (age > HOT))
    allowed = manual_allowed.select("key", "event_id", F.lit(True).alias("__allowed"))
    mode = F.col("mode")
    refresh = (
        F.when(mode == "manual", F.coalesce("__allowed", F.lit(False)))
        .when(mode == "hot", age > HOT)
        .otherwise(normal)
    )
    error = ~F.col("known") & F.col("failed") & (mode != "manual")
    return (
        seen.join(allowed, ["key", "event_id"], "left")
        .withColumn("known", known)
        .withColumn("failed", failed)
        .select(
            "key", "event_id", "mode",
            F.when(error & (F.col("marker.word") == "refresh-failed"), 503).when(error, 422)
            .when(F.col("known"), 200).otherwise(202).cast("bigint").alias("http_status"),
            F.when(error, "error").when(F.col("known") & (age <= FRESH), "ready-fresh")
            .when(F.col("known"), "ready-stale").otherwise("pending").alias("answer"),
            F.when(error, F.lit(False)).when(F.col("known"), refresh).otherwise(F.lit(True)).alias("refresh_started"),
        )
    )
