"""Queries for keyed state over the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketladder.functions.text import millis
from marketladder.operators import state
from marketladder.plans import fixtures as fx
from marketladder.plans.oracle_base import REQ
from marketladder.plans.registry import query

NOW = "2024-01-31 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


AGE = f"((epoch_us(TIMESTAMP '{NOW}') // 1000) - (epoch_us(ts) // 1000)) // 1000"


@query(
    "cache_tier",
    "O84",
    f"""WITH {REQ}, r AS (SELECT event_id, mode, CASE WHEN key % 11 <> 0 THEN {AGE} END AS shown,
        CASE WHEN key % 11 <> 0 THEN {AGE} ELSE 1000000000000 END AS age, key % 7 = 0 AS degraded, key % 5 = 0 AS incomplete FROM req)
    SELECT event_id, shown AS age, CASE WHEN age <= 43200 THEN 'fresh' WHEN age <= 604800 THEN 'stale' ELSE 'expired' END AS tier,
      CASE WHEN mode = 'hot' THEN age > 10800 ELSE age > 43200 OR incomplete OR (degraded AND age > 10800) END AS refresh,
      CASE WHEN age > 604800 OR incomplete THEN 'pending' ELSE 'ready' END AS answer FROM r""",
)
def _tier(spark: SparkSession, sf: str) -> DataFrame:
    dated = F.when(F.col("key") % 11 != 0, F.col("ts"))  # some records have no date
    records = fx.requests(spark, sf).withColumn("generated_at", dated).drop("ts")
    tiers = state.cache_tier(records, now(), F.col("mode"), F.col("key") % 7 == 0, F.col("key") % 5 == 0)
    return tiers.select("event_id", "age", "tier", "refresh", "answer")


LATEST = """rec AS (SELECT key, CASE WHEN key % 9 <> 0 THEN max(ts) END AS ts, arg_max(value, (ts, event_id)) AS payload FROM req WHERE mode = 'put' GROUP BY key),
seed AS (SELECT key, max(ts) AS ts, arg_max(value, (ts, event_id)) AS payload FROM req WHERE mode = 'hot' GROUP BY key)"""


@query(
    "merge_latest",
    "O85",
    f"""WITH {REQ}, {LATEST}, young AS (SELECT * FROM seed WHERE {AGE} <= 604800),
    j AS (SELECT coalesce(r.key, s.key) AS key, r.ts AS rt, r.payload AS rp, s.ts AS st, s.payload AS sp,
        s.key IS NOT NULL AND (r.key IS NULL OR r.ts IS NULL OR s.ts > r.ts) AS newer FROM rec r FULL JOIN young s ON r.key = s.key)
    SELECT key, (epoch_us(CASE WHEN newer THEN st ELSE rt END) // 1000) AS generated_ms, CASE WHEN newer THEN sp ELSE rp END AS payload,
      CASE WHEN newer THEN 'seed' ELSE 'record' END AS origin FROM j""",
)
def _merge(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.requests(spark, sf)
    records = state.latest_per_key(log.filter("mode = 'put'"), "value").withColumn(
        "generated_at", F.when(F.col("key") % 9 != 0, F.col("generated_at"))
    )
    seeds = state.latest_per_key(log.filter("mode = 'hot'"), "value")
    merged = state.merge_latest(records, seeds, now())
    return merged.select("key", millis(F.col("generated_at")).alias("generated_ms"), "payload", "origin")


# The busiest minute holds four requests, so the cap is tried on hours.
HOUR_CAP = 15


@query(
    "rate_cap",
    "O89",
    f"""WITH {REQ}, b AS (SELECT *, (epoch_us(ts) // 1000) // 3600000 AS bucket FROM req)
    SELECT event_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) AS place FROM b QUALIFY place <= {HOUR_CAP}""",
)
def _cap(spark: SparkSession, sf: str) -> DataFrame:
    return state.rate_cap(fx.requests(spark, sf), HOUR_CAP, 3600).select("event_id", "bucket", "place")


@query(
    "rate_summary",
    "O89",
    f"""WITH {REQ} SELECT (epoch_us(ts) // 1000) // 3600000 AS bucket, count(*) AS requests, least(count(*), {HOUR_CAP}) AS passed, greatest(count(*) - {HOUR_CAP}, 0) AS refused FROM req GROUP BY ALL""",
)
def _cap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return state.rate_summary(fx.requests(spark, sf), HOUR_CAP, 3600)


# Accepted requests of a key: the first, then each time the first one at least
# the interval after the last accepted.
COOLDOWN = """RECURSIVE {req}, d AS (SELECT key, (epoch_us(ts) // 1000) AS at_ms, min(event_id) AS event_id FROM req {where} GROUP BY ALL),
chain(key, at_ms) AS (SELECT key, min(at_ms) FROM d GROUP BY key
  UNION ALL SELECT c.key, (SELECT min(d.at_ms) FROM d WHERE d.key = c.key AND d.at_ms >= c.at_ms + {interval}) FROM chain c
  WHERE EXISTS (SELECT 1 FROM d WHERE d.key = c.key AND d.at_ms >= c.at_ms + {interval})),
accepted AS (SELECT d.key, d.at_ms, d.event_id FROM chain JOIN d ON d.key = chain.key AND d.at_ms = chain.at_ms)"""


@query("cooldown", "O90", f"WITH {COOLDOWN.format(req=REQ, where='', interval=43_200_000)} SELECT * FROM accepted")
def _cooldown(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve hours instead of thirty minutes, so that the rule often refuses."""
    return state.cooldown(fx.requests(spark, sf), 12 * state.HOUR)


@query(
    "cooldown_half_hour",
    "O90",
    f"WITH {COOLDOWN.format(req=REQ, where='', interval=1_800_000)} SELECT * FROM accepted",
)
def _cooldown_short(spark: SparkSession, sf: str) -> DataFrame:
    return state.cooldown(fx.requests(spark, sf))


KINDS = list(state.TTL_SECONDS)
KIND_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
TTL_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {s}" for k, s in state.TTL_SECONDS.items()) + " END"


def kind() -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 6).cast("int"))


@query(
    "lookup_ttl",
    "O91",
    f"""WITH {REQ}, log AS (SELECT *, CASE WHEN mode = 'put' THEN {{'ts': ts, 'kind': {KIND_SQL}, 'value': value}} END AS st FROM req),
    f AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id) AS l FROM log),
    g AS (SELECT key, event_id, (epoch_us(ts) // 1000) AS ms, l.kind AS kind, l.value AS payload, ((epoch_us(ts) // 1000) - (epoch_us(l.ts) // 1000)) // 1000 AS age FROM f WHERE mode <> 'put'),
    h AS (SELECT *, coalesce(age < {TTL_SQL}, FALSE) AS hit FROM g)
    SELECT key, event_id, CASE WHEN hit THEN kind END AS kind, CASE WHEN hit THEN payload END AS payload, hit FROM h""",
)
def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.requests(spark, sf)
    puts = log.filter("mode = 'put'").select("key", "ts", "event_id", kind().alias("kind"), F.col("value").alias("payload"))
    reads = log.filter("mode <> 'put'").select("key", "ts", "event_id")
    return state.lookup_ttl(puts, reads).drop("ts")


@query(
    "serve_decision",
    "O93",
    f"""WITH {COOLDOWN.format(req=REQ, where="WHERE mode = 'manual'", interval=1_800_000)},
    log AS (SELECT *, event_id % 4 <> 0 AS usable, event_id % 3 = 0 AS degraded, CASE WHEN event_id % 2 = 0 THEN 'refresh-failed' ELSE 'no-comparable-plans' END AS word FROM req),
    m AS (SELECT *, CASE WHEN mode = 'put' THEN {{'t0': ts, 'usable': usable, 'degraded': degraded}} END AS r,
        CASE WHEN mode = 'error' THEN {{'t0': ts, 'word': word}} WHEN mode = 'put' AND usable THEN {{'t0': ts, 'word': NULL::VARCHAR}} END AS e FROM log),
    f AS (SELECT *, last_value(r IGNORE NULLS) OVER w AS lr, last_value(e IGNORE NULLS) OVER w AS le FROM m WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
    g AS (SELECT key, event_id, mode, ((epoch_us(ts) // 1000) - (epoch_us(lr.t0) // 1000)) // 1000 AS age, lr.usable AS us, lr.degraded AS dg,
        le.word AS word, ((epoch_us(ts) // 1000) - (epoch_us(le.t0) // 1000)) // 1000 AS eage FROM f WHERE mode IN ('read', 'hot', 'manual')),
    h AS (SELECT g.*, coalesce(us AND age <= 604800, FALSE) AS known, coalesce(word IS NOT NULL AND eage < CASE WHEN word = 'refresh-failed' THEN 60 ELSE 21600 END, FALSE) AS failed,
        a.event_id IS NOT NULL AS allowed FROM g LEFT JOIN accepted a ON a.key = g.key AND a.event_id = g.event_id),
    i AS (SELECT *, NOT known AND failed AND mode <> 'manual' AS err FROM h)
    SELECT key, event_id, mode, CASE WHEN err THEN CASE WHEN word = 'refresh-failed' THEN 503 ELSE 422 END WHEN known THEN 200 ELSE 202 END::BIGINT AS http_status,
      CASE WHEN err THEN 'error' WHEN known AND age <= 43200 THEN 'ready-fresh' WHEN known THEN 'ready-stale' ELSE 'pending' END AS answer,
      CASE WHEN err THEN FALSE WHEN NOT known THEN TRUE WHEN mode = 'manual' THEN allowed WHEN mode = 'hot' THEN age > 10800
        ELSE age > 43200 OR (dg AND age > 10800) END AS refresh_started FROM i""",
)
def _serve(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("event_id")
    log = fx.requests(spark, sf).select(
        "key", "ts", "event_id", "mode", (number % 4 != 0).alias("usable"), (number % 3 == 0).alias("degraded"),
        F.when(number % 2 == 0, "refresh-failed").otherwise("no-comparable-plans").alias("error"),
    )
    return state.serve_decision(log, state.cooldown(log.filter("mode = 'manual'")))
