"""The keyed-state rules as Structured Streaming operators.

Requests: key, ts (timestamp with a watermark), at_ms (event time in
milliseconds), event_id.  Rows may arrive out of order within the watermark's
delay: a row is decided on when the watermark has passed it, so the results are
those of the batch forms.  Rows wait under a share of the keys until a bucket of
time has passed; of a key itself one row is kept of what was decided before, and
it expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from marketladder.functions.text import millis
from marketladder.operators.state import MANUAL, STALE, TTL_SECONDS, age_seconds

MEMORY = "append"


def request_stream(
    spark: SparkSession, folder: str, pattern: str, schema: str, late: str = "1 hour", files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a request stream with a watermark.

    How much a micro-batch takes is the caller's to limit.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    source = reader.parquet(folder)
    return source.withColumn("at_ms", millis(F.col("ts"))).withColumn("ts", F.timestamp_millis("at_ms")).withWatermark(
        "ts", late
    )


def _arrived(parts: Iterator[pd.DataFrame], columns: list[str], held: pd.DataFrame, late: bool) -> pd.DataFrame:
    """The held rows and, unless the call is a timeout, the new ones, in the order of event time."""
    found = [held] if late else [held, *[p[columns] for p in parts]]
    return pd.concat([f for f in found if len(f)] or [held]).sort_values(["at_ms", "event_id"], ignore_index=True)


def rate_cap_stream(requests: DataFrame, n: int = 60, seconds: int = 60) -> DataFrame:
    """First n requests of every bucket by time, then id.

    Each task first keeps the n first rows a bucket of what it reads, so a
    crowded bucket gets at most n rows a task; its state holds n rows.  A bucket
    is answered when the watermark has passed its end.
    """
    size = seconds * 1000
    columns = ["at_ms", "event_id"]

    def shorten(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for part in parts:
            rows = part if kept is None else pd.concat([kept, part])
            kept = rows.sort_values(columns).groupby("bucket", sort=False).head(n)
        if kept is not None:
            yield kept

    def first(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(columns, state.get)) if state.exists else {c: [] for c in columns}, dtype="int64")
        best = _arrived(parts, columns, held, state.hasTimedOut).head(n)
        end = (int(key[0]) + 1) * size
        if state.hasTimedOut:
            state.remove()
            place = np.arange(1, len(best) + 1)
            yield pd.DataFrame({"event_id": best["event_id"], "bucket": int(key[0]), "place": place})
        else:
            state.update((best["at_ms"].tolist(), best["event_id"].tolist()))
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    bucket = F.floor(F.col("at_ms") / F.lit(size)).cast("bigint")
    rows = requests.select("ts", "at_ms", "event_id", bucket.alias("bucket"))
    return rows.mapInPandas(shorten, rows.schema).groupBy("bucket").applyInPandasWithState(
        first, "event_id bigint, bucket bigint, place bigint", "at_ms array<bigint>, event_id array<bigint>", MEMORY,
        GroupStateTimeout.EventTimeTimeout,
    )


# ---- state under a share of the keys, handed on by bucket of time ----------------------------------------------------

#: Milliseconds of a bucket of time: waiting rows are decided on when the watermark has passed their bucket.
STREAM_BUCKET = 10 * 60_000
#: Shares the keys are dealt into.  A micro-batch calls once a share, so few rows a key and bucket cost no call each.
STREAM_SHARES = 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Fixed value: the state store that list state, timers and expiry need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Deciding(StatefulProcessor):
    """Rows of a share of the keys, appended as they arrive and decided on, in order, once the watermark has passed their bucket.

    Of a key one row is carried over from what was decided before; it is dropped
    when nothing can refer to it any more.  One timer a share is set: the end of
    its first waiting bucket, or the end of all that is carried.
    """

    carries: str  # key and at_ms first
    expiry: int  # milliseconds after which no row can refer to a carried one

    def __init__(self, fields: str, bucket_ms: int):
        self.fields, self.bucket_ms = fields, bucket_ms
        self.names = [f.split()[0] for f in fields.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.fields)
        self.carried = handle.getListState("carried", self.carries)
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def decide(self, rows: pd.DataFrame, carried: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What the rows, with the carried row of each key, give; and what is carried on."""
        raise NotImplementedError

    def ends(self, rows: pd.DataFrame) -> np.ndarray:
        return (rows["at_ms"].to_numpy("int64") // self.bucket_ms + 1) * self.bucket_ms

    def wake(self, at: int) -> None:
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            self.rows.appendList(_plain(part[self.names]))
            end = int(self.ends(part).min())
            first = end if first is None else min(first, end)
        held = self.timer.get()[0] if self.timer.exists() else None
        if first is not None and (held is None or first < held):
            if held is not None:
                self.handle.deleteTimer(held)
            self.wake(first)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows, carried = _frame(self.rows, self.fields), _frame(self.carried, self.carries)
        due = self.ends(rows) <= now
        waiting = rows[~due]
        if due.any():
            found, carried = self.decide(rows[due], carried)
            yield found
        carried = carried[carried["at_ms"].to_numpy("int64") + self.expiry + self.bucket_ms > now]
        for state, kept in ((self.rows, waiting), (self.carried, carried)):
            state.put(_plain(kept)) if len(kept) else state.clear()
        if len(waiting):
            self.wake(int(self.ends(waiting).min()))
        elif len(carried):
            self.wake(int(carried["at_ms"].max()) + self.expiry + self.bucket_ms)
        else:
            self.timer.clear()

    def close(self) -> None:
        pass


def _frame(state: Any, fields: str) -> pd.DataFrame:
    """Rows of a list state."""
    kinds = dict(f.split() for f in fields.split(", "))
    rows = pd.DataFrame(list(state.get()), columns=list(kinds), dtype=object)
    return rows.astype({f: {"bigint": "int64", "boolean": "boolean"}.get(kind, object) for f, kind in kinds.items()})


def _plain(rows: pd.DataFrame) -> list[tuple]:
    return list(rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None))


def _key_starts(keys: pd.Series) -> np.ndarray:
    """Where another key begins among sorted keys; a missing key is one too."""
    codes = pd.factorize(keys, use_na_sentinel=False)[0]
    return np.flatnonzero(np.diff(codes, prepend=-1))


class Accepting(Deciding):
    """Takes a row at least an interval after the last one it took."""

    carries = "key string, at_ms bigint"

    def __init__(self, interval: int, fields: str, bucket_ms: int):
        super().__init__(fields, bucket_ms)
        self.interval = self.expiry = interval

    def decide(self, rows: pd.DataFrame, carried: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        # The carried row, already taken, comes first of its key.
        met = pd.concat([carried.assign(event_id=None, taken=1), rows.assign(taken=0)], ignore_index=True).astype({"event_id": "Int64"})
        met = met.sort_values(["key", "taken", "at_ms", "event_id"], ascending=[True, False, True, True], ignore_index=True)
        times, starts = met["at_ms"].to_numpy("int64"), _key_starts(met["key"])
        taken, last = [], []
        for at, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(met)]):
            own, begin, step = times[at:stop], at, 0
            while step < len(own):  # one step for each accepted request
                at = begin + step
                taken.append(at)
                step = max(step + 1, int(np.searchsorted(own, own[step] + self.interval)))
            last.append(at)
        new = met.iloc[taken]
        return new[new["taken"] == 0][["key", "at_ms", "event_id"]], met.iloc[last][["key", "at_ms"]]


class Answering(Deciding):
    """Answers a read with the last put before it, unless that has expired."""

    carries = "key string, at_ms bigint, kind string, payload double"

    def __init__(self, ttl: dict[str, int], fields: str, bucket_ms: int):
        super().__init__(fields, bucket_ms)
        self.ttl, self.expiry = ttl, max(ttl.values())

    def decide(self, rows: pd.DataFrame, carried: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        puts = pd.array([True] * len(carried), dtype="boolean")
        met = pd.concat([carried.assign(event_id=None, is_put=puts, new=0), rows.assign(new=1)], ignore_index=True).astype({"event_id": "Int64"})
        met = met.sort_values(["key", "new", "at_ms", "event_id"], ignore_index=True)  # the carried put comes first of its key
        put = met["is_put"].fillna(False).to_numpy(bool)
        read = met["event_id"].notna().to_numpy() & ~put
        starts = _key_starts(met["key"])
        sizes = np.diff(starts, append=len(met))
        place = np.maximum.accumulate(np.where(put, np.arange(len(met)), -1))
        some = place >= np.repeat(starts, sizes)
        seen = met.iloc[np.maximum(place, 0)].reset_index(drop=True)
        age = (met["at_ms"].to_numpy("int64") - seen["at_ms"].to_numpy("int64")) // 1000 * 1000
        hit = some & (age < seen["kind"].map(self.ttl).to_numpy(dtype="float64", na_value=0))
        found = pd.DataFrame({
            "key": met["key"], "event_id": met["event_id"], "kind": np.where(hit, seen["kind"], None),
            "payload": np.where(hit, seen["payload"].astype(object), None), "hit": hit,
        })[read]
        last = starts + sizes - 1
        return found, seen.iloc[last[some[last]]][["key", "at_ms", "kind", "payload"]]


def _by_share(rows: DataFrame, processor: Deciding, result: str, shares: int) -> DataFrame:
    """Keys and ids travel as text: whole numbers beside missing ones would be doubles in pandas."""
    dealt = rows.withColumns({
        "share": F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int"), "key": F.col("key").cast("string"), "event_id": F.col("event_id").cast("string"),
    })
    decided = dealt.select("share", "ts", *processor.names).groupBy("share").transformWithStateInPandas(processor, result, "append", "EventTime")
    return decided.withColumn("key", F.col("key").cast("bigint"))


def cooldown_stream(
    requests: DataFrame, seconds: int = MANUAL, bucket_ms: int = STREAM_BUCKET, shares: int = STREAM_SHARES
) -> DataFrame:
    """Requests at least ``seconds`` after the key's last accepted one.

    Keys are dealt into shares.  A micro-batch appends to the waiting rows of a
    share; of a key itself the state is the last accepted time, until it can't
    refuse anything any more.
    """
    fields = "key string, at_ms bigint, event_id string"
    return _by_share(requests, Accepting(seconds * 1000, fields, bucket_ms), "key string, at_ms bigint, event_id bigint", shares)


def lookup_stream(log: DataFrame, bucket_ms: int = STREAM_BUCKET, shares: int = STREAM_SHARES) -> DataFrame:
    """Each read sees the latest earlier put of its key unless it has expired.

    log: key, ts, at_ms, event_id, is_put, kind, payload.  A read is answered
    when the watermark has passed its bucket, so a put that arrives after the
    read is seen if it is earlier, and a later one is not.  Keys are dealt into
    shares, to whose waiting rows a micro-batch appends; of a key itself the
    state is its last put, until no read can see it any more.
    """
    fields = "key string, at_ms bigint, event_id string, is_put boolean, kind string, payload double"
    ttl = {kind: seconds * 1000 for kind, seconds in TTL_SECONDS.items()}
    result = "key string, event_id bigint, kind string, payload double, hit boolean"
    return _by_share(log, Answering(ttl, fields, bucket_ms), result, shares)


# ---- merging into a record table -----------------------------------------------------------------------------------

RECORD = "key bigint, generated_at timestamp_ntz, payload double"
CHANGE = "key bigint, generated_at timestamp_ntz, event_id bigint, payload double"


class Merging(StatefulProcessor):
    """The newest record of a key; a seed that replaces it is a change.

    A seed replaces an older or undated record; of equally old seeds the larger
    event wins.  The state expires after the age from which on seeds are
    refused, since then any seed that is taken is newer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at_us bigint, event_id bigint, payload double", ttlDurationMs=STALE * 1000)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        first = initialState.iloc[0]
        if not pd.isna(first["at_us"]):  # an undated record is replaced by any seed
            self.newest.update((int(first["at_us"]), None, None))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.newest.get() if self.newest.exists() else None
        best = held
        for part in rows:
            for at, event, payload in zip(part["at_us"].tolist(), part["event_id"].tolist(), part["payload"].tolist()):
                payload = None if pd.isna(payload) else payload
                if best is None or at > best[0] or (at == best[0] and best[1] is not None and event > best[1]):
                    best = (at, event, payload)
        if best is not held:
            self.newest.update(best)
            yield pd.DataFrame({"key": [key[0]], "at_us": [best[0]], "event_id": [best[1]], "payload": [best[2]]})

    def close(self) -> None:
        pass


def start_records(records: DataFrame, root: str) -> None:
    """A record table that streams of seeds can be merged into; an empty one too."""
    records.select("key", "generated_at", "payload").write.parquet(f"{root}/records")


def current_records(spark: SparkSession, root: str) -> DataFrame:
    """The record table as it is now: its first records and what changed since; the last change of a key counts."""
    first = spark.read.schema(RECORD).parquet(f"{root}/records").withColumn("event_id", F.lit(None).cast("bigint"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/changes/_spark_metadata")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        first = first.unionByName(spark.read.schema(CHANGE).parquet(f"{root}/changes"))
    newest = first.groupBy("key").agg(F.max(F.struct("generated_at", "event_id", "payload")).alias("l"))
    return newest.select("key", "l.generated_at", "l.payload")


def merge_changes(seeds: DataFrame, records: DataFrame, now: str) -> DataFrame:
    """The changes that a stream of seeds makes to a record table, in order for each key: ``CHANGE`` rows.

    seeds: key, generated_at, event_id, payload.  Undated seeds and those older
    than a week at ``now`` are refused.  A task sends one seed a key and batch
    of rows on, so a hot key's seeds are combined before they meet.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = age_seconds(F.col("generated_at"), F.lit(now).cast("timestamp_ntz"))
    young = seeds.filter(age <= STALE).select("key", micros(F.col("generated_at")).alias("at_us"), "event_id", "payload")

    def newest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.sort_values(["at_us", "event_id"]).drop_duplicates("key", keep="last")

    first = records.groupBy("key").agg(F.max(micros(F.col("generated_at"))).alias("at_us"))
    changes = young.mapInPandas(newest, young.schema).groupBy("key").transformWithStateInPandas(
        Merging(), "key bigint, at_us bigint, event_id bigint, payload double", "append", "ProcessingTime", initialState=first.groupBy("key"),
    )
    return changes.select("key", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("generated_at"), "event_id", "payload")


def merge_latest_stream(seeds: DataFrame, root: str, now: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of seeds into the table that ``start_records`` began: its changes are appended to the table's log."""
    spark = seeds.sparkSession
    with state_store(spark, idle_batches=False):
        changes = merge_changes(seeds, spark.read.schema(RECORD).parquet(f"{root}/records"), now)
        return (
            changes.writeStream.format("parquet").outputMode("append").option("path", f"{root}/changes")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


@contextmanager
def state_store(spark: SparkSession, idle_batches: bool = True) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own settings are put back.

    Without ``idle_batches`` there are no micro-batches without rows: where
    state expires by the clock, a run over what is available would never end.
    """
    wanted = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what its source holds now and read what it wrote."""
    with state_store(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/rows")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
