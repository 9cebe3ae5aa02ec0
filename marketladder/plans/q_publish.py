"""Queries for publishing and for the streaming forms of the state rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketladder.functions import status
from marketladder.operators import quality, state
from marketladder.plans import fixtures as fx, publish
from marketladder.plans.oracle_base import OBS, REQ
from marketladder.plans.q_matching import ROLLUP, STRICT, compared
from marketladder.plans.q_quality import snapshot_tables
from marketladder.plans.q_state import AGE, COOLDOWN, HOUR_CAP, KIND_SQL, LATEST, NOW, TTL_SQL, kind
from marketladder.plans.registry import n_rows, query
from marketladder.session import checkpoint_folder, stored
from marketladder.streaming import state as streams

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/marketladder/{uuid.uuid4().hex}"


def mended(spark: SparkSession, sf: str, candidate: dict) -> dict:
    """The candidate with every market of every app, safe states, and each item once."""
    key = F.when(F.col("product_id") != "", F.col("product_id")).otherwise(F.concat_ws("\u0000", F.lit("named"), "name", "price"))
    first = Window.partitionBy("app_id", "region", "__key").orderBy("pos", "name", "price")
    items = candidate["items"].withColumn("__key", key).withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    counts = items.groupBy("app_id", "region").agg(F.count(F.lit(1)).alias("n"))
    market = candidate["regions"].agg(F.collect_list(F.struct(F.col("ord").alias("place"), "region"))).scalar()
    grid = candidate["apps"].select("app_id", F.inline(market))  # the market dimension is bounded
    cells = candidate["cells"].select("app_id", "region", "status")
    joined = grid.join(cells, ["app_id", "region"], "left").join(counts, ["app_id", "region"], "left")
    full, safe = F.col("n") > 0, F.col("status").isin(status.SAFE_EMPTY)
    number = F.coalesce("n", F.lit(0))
    state_of = F.when(full | safe, F.col("status")).otherwise(status.NOT_FOUND)
    checked = joined.select("app_id", "region", "place", state_of.alias("status"), number.alias("declared"), number.alias("actual"))
    return candidate | {"cells": stored(checked), "items": stored(items.drop("__key", "__n"))}


@query(
    "publish_gate",
    "O94",
    f"""WITH {OBS}, newer AS (SELECT DISTINCT app_id, region, CASE WHEN coalesce(product_id, '') <> '' THEN product_id ELSE 'named ' || name || chr(1) || price END AS key FROM obs WHERE snap = 'after'),
    n AS (SELECT 'cells' AS name, (SELECT count(DISTINCT app_id) FROM cell WHERE snap = 'after') * (SELECT count(*) FROM nation) AS rows
      UNION ALL SELECT 'items', count(*) FROM newer UNION ALL SELECT 'rates', count(*) FROM fx),
    broken AS (SELECT concat_ws(',', CASE WHEN (SELECT count(*) FROM cell WHERE snap = 'after') < (SELECT rows FROM n WHERE name = 'cells') THEN 'V12' END,
      CASE WHEN EXISTS (FROM cell WHERE snap = 'after' AND status = 'error:HTTP 503') THEN 'V13' END,
      CASE WHEN (SELECT count(*) FROM obs WHERE snap = 'after') > (SELECT rows FROM n WHERE name = 'items') THEN 'V20' END) AS broken)
    SELECT broken = '' AS first_try, 1::BIGINT AS second_try, FALSE AS rival_try, broken, name, rows FROM n CROSS JOIN broken""",
)
def _gate(spark: SparkSession, sf: str) -> DataFrame:
    """All rules hold back a broken candidate; the mended one passes them all; a rival's same version is refused."""
    candidate, configured, previous = snapshot_tables(spark, sf)
    root = new_folder(spark)

    def tables(snap: dict) -> dict[str, DataFrame]:
        return {"cells": snap["cells"], "items": snap["items"], "rates": fx.rates(spark)}

    violations = stored(quality.validate_snapshot(candidate, configured, previous))
    first = publish.publish(root, "run-1", 1, tables(candidate), violations)
    whole = mended(spark, sf, candidate)
    passed = quality.validate_snapshot(whole, configured, previous)
    second = publish.publish_next(spark, root, "run-2", tables(whole), lambda present: passed)
    rival = publish.commit(spark, root, 1, "run-3")
    broken = F.concat_ws(",", F.array_sort(F.collect_set("rule")))  # at most one entry a rule
    result = None
    for name in ("cells", "items", "rates"):
        part = publish.published(spark, root, name).agg(n_rows()).select(
            F.lit(first).alias("first_try"), F.lit(second).cast("bigint").alias("second_try"), F.lit(rival).alias("rival_try"),
            F.lit(violations.agg(broken).first()[0]).alias("broken"), F.lit(name).alias("name"), "rows",
        )
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "publish_marker",
    "O95",
    """SELECT o_orderkey, substr(sha256('{"snapshotGeneratedAt":"' || strftime(o_orderdate, '%Y-%m-%d') || '","ratesUpdatedAt":"' || o_orderpriority || '"}'), 1, 20) AS marker FROM orders""",
)
def _marker(spark: SparkSession, sf: str) -> DataFrame:
    time = F.date_format("o_orderdate", "yyyy-MM-dd")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", publish.publish_marker(time, F.col("o_orderpriority")).alias("marker")
    )


@query(
    "write_comparison",
    "O96",
    f"""WITH {OBS}, {STRICT}, {ROLLUP}, h AS (SELECT app_id, count(*) AS n FROM cell WHERE snap = 'after' GROUP BY ALL),
    i AS (SELECT app_id, count(*) AS n FROM judged WHERE why IS NOT NULL GROUP BY ALL)
    SELECT app_id, 'header' AS kind, 1::BIGINT AS rows, 0::BIGINT AS prices FROM h
    UNION ALL SELECT app_id, 'plan', count(*), sum(available)::BIGINT FROM rolled GROUP BY app_id UNION ALL SELECT app_id, 'issue', n, 0 FROM i""",
)
def _documents(spark: SparkSession, sf: str) -> DataFrame:
    _, found = compared(spark, sf)
    path = new_folder(spark)
    publish.write_comparison(found.headers, found.rollup, found.issues, path)
    prices = F.coalesce(F.size(F.from_json("document", "prices array<struct<region:string>>")["prices"]), F.lit(0))
    read = publish.read_comparison(spark, path).withColumn("n", F.greatest(prices, F.lit(0)))
    return read.groupBy("app_id", "kind").agg(n_rows(), F.sum("n").alias("prices"))


PARTS = 6


def arrivals(spark: SparkSession, sf: str) -> str:
    """The events as files of a folder, as they might arrive: several, overlapping by up to 40 minutes.

    All files are written at once, a task a file, and then dated in the order of
    their parts, by which a file stream reads them.  Two closing rows, days
    later, let the watermark pass the last event.
    """
    folder = new_folder(spark)
    events = fx.table(spark, sf, "events")
    first, last = (F.min("ts"), F.max("ts"))
    span = events.agg(first.alias("first"), last.alias("last")).select(
        streams.millis(F.col("first")).alias("first"), streams.millis(F.col("last")).alias("last")
    ).first()
    late = F.pmod(F.col("event_id") * 7919, F.lit(40 * 60_000))
    place = (streams.millis(F.col("ts")) + late - span.first) / F.lit(max(span.last - span.first, 1))
    names = [f.split()[0] for f in EVENTS.split(", ")]
    parts = events.select(*names, F.least(F.floor(place * PARTS), F.lit(PARTS - 1)).cast("int").alias("part"))
    closing = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props"),
        F.timestamp_millis(F.lit(span.last) + (F.col("id") + 1) * 3 * 86_400_000).cast("timestamp_ntz").alias("ts"),
        (F.lit(PARTS) + F.col("id")).cast("int").alias("part"),
    )
    rows = parts.unionByName(closing.select(*parts.columns))
    rows.repartition(PARTS + 2, "part").write.partitionBy("part").parquet(f"{folder}/events")
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    written = store.globStatus(hadoop.Path(f"{folder}/events/part=*/*.parquet"))
    begin = min(f.getModificationTime() for f in written) - 1000 * (PARTS + 2)
    for file in written:  # one for each part
        part = int(file.getPath().getParent().getName().split("=")[1])
        store.setTimes(file.getPath(), begin + 1000 * part, -1)
    return f"{folder}/events"


def request_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The requests as a stream of several micro-batches."""
    source = streams.request_stream(spark, arrivals(spark, sf), "*.parquet", EVENTS, files_per_trigger=1)
    return source.withColumnRenamed("user_id", "key")


def answered(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """What the stream wrote, without the closing rows."""
    return streams.run_to_table(stream, new_folder(spark)).filter("event_id >= 0")


@query(
    "rate_cap_stream",
    "O89",
    f"""WITH {REQ}, b AS (SELECT *, epoch_us(ts) // 3600000000 AS bucket FROM req)
    SELECT event_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY epoch_us(ts) // 1000, event_id) AS place FROM b QUALIFY place <= {HOUR_CAP}""",
)
def _cap_stream(spark: SparkSession, sf: str) -> DataFrame:
    capped = streams.rate_cap_stream(request_stream(spark, sf), HOUR_CAP, state.HOUR)
    return answered(capped, spark)


@query("cooldown_stream", "O90", f"WITH {COOLDOWN.format(req=REQ, where='', interval=1_800_000)} SELECT * FROM accepted")
def _cooldown_stream(spark: SparkSession, sf: str) -> DataFrame:
    return answered(streams.cooldown_stream(request_stream(spark, sf)), spark)


@query(
    "lookup_ttl_stream",
    "O91",
    f"""WITH {REQ}, log AS (SELECT *, CASE WHEN mode = 'put' THEN {{'ts': ts, 'kind': {KIND_SQL}, 'value': value}} END AS st FROM req),
    f AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY key ORDER BY epoch_us(ts) // 1000, event_id) AS l FROM log),
    g AS (SELECT key, event_id, l.kind AS kind, l.value AS payload, (epoch_us(ts) // 1000 - epoch_us(l.ts) // 1000) // 1000 AS age FROM f WHERE mode <> 'put'),
    h AS (SELECT *, coalesce(age < {TTL_SQL}, FALSE) AS hit FROM g)
    SELECT key, event_id, CASE WHEN hit THEN kind END AS kind, CASE WHEN hit THEN payload END AS payload, hit FROM h""",
)
def _lookup_stream(spark: SparkSession, sf: str) -> DataFrame:
    put = F.col("event_type") == "signup"
    log = request_stream(spark, sf).select(
        "key", "ts", "at_ms", "event_id", put.alias("is_put"), F.when(put, kind()).alias("kind"),
        F.when(put, F.col("value")).alias("payload"),
    )
    return answered(streams.lookup_stream(log), spark)


@query(
    "merge_latest_stream",
    "O85",
    f"""WITH {REQ}, {LATEST}, young AS (SELECT * FROM seed WHERE {AGE} <= 604800),
    j AS (SELECT coalesce(r.key, s.key) AS key, r.ts AS rt, r.payload AS rp, s.ts AS st, s.payload AS sp,
        s.key IS NOT NULL AND (r.key IS NULL OR r.ts IS NULL OR s.ts > r.ts) AS newer FROM rec r FULL JOIN young s ON r.key = s.key)
    SELECT key, (epoch_us(CASE WHEN newer THEN st ELSE rt END) // 1000) AS generated_ms, CASE WHEN newer THEN sp ELSE rp END AS payload FROM j""",
)
def _merge_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of several micro-batches merged into a table that has records already."""
    root = new_folder(spark)
    records = state.latest_per_key(fx.requests(spark, sf).filter("mode = 'put'"), "value")
    streams.start_records(records.withColumn("generated_at", F.when(F.col("key") % 9 != 0, F.col("generated_at"))), root)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(arrivals(spark, sf))
    seeds = source.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("key"), F.col("ts").alias("generated_at"), "event_id", F.col("value").alias("payload")
    )
    streams.merge_latest_stream(seeds, root, NOW, f"{root}/checkpoint").awaitTermination()
    merged = streams.current_records(spark, root)
    return merged.select("key", streams.millis(F.col("generated_at")).alias("generated_ms"), "payload")
