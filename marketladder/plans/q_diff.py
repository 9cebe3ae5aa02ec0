"""Queries for snapshot differences, the change log and carried-forward data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketladder.operators import carry, diff
from marketladder.plans import fixtures as fx
from marketladder.plans.oracle_base import OBS
from marketladder.plans.q_functions import DIFF_STATE
from marketladder.plans.q_matching import IDENTITY, PAGES, newer_cells, summaries
from marketladder.plans.registry import n_rows, query
from marketladder.session import stored

CELL = ["app_id", "region"]


def sides(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Cells and items of the older and the newer snapshot."""
    cells = stored(fx.cells(spark, sf))
    items = stored(fx.observations(spark, sf).select("snap", "app_id", "region", "pos", "name", "price"))
    both = {}
    for snap in ("before", "after"):
        mine = F.col("snap") == snap
        both[f"{snap}_cells"] = cells.filter(mine).drop("snap")
        both[f"{snap}_items"] = items.filter(mine).drop("snap")
    return both


def changes(side: dict[str, DataFrame]) -> DataFrame:
    return diff.item_changes(
        side["before_cells"], side["after_cells"], side["before_items"], side["after_items"], fx.pos_range()
    )


BAG = """lefts AS (SELECT * FROM obs WHERE snap = '{0}'), rights AS (SELECT app_id, region, name, price, count(*) AS c FROM obs WHERE snap = '{1}' GROUP BY ALL),
bag AS (SELECT app_id, region, pos, name, price FROM (SELECT l.*, coalesce(r.c, 0) AS c,
    row_number() OVER (PARTITION BY l.app_id, l.region, l.name, l.price ORDER BY l.pos) AS n FROM lefts l
    LEFT JOIN rights r USING (app_id, region, name, price)) WHERE n > c)"""


@query("bag_difference", "O73", f"WITH {OBS}, {BAG.format('before', 'after')} SELECT * FROM bag")
def _bag(spark: SparkSession, sf: str) -> DataFrame:
    side = sides(spark, sf)
    rows = diff.bag_difference(side["before_items"], side["after_items"], pos_range=fx.pos_range())
    return rows.select(*CELL, "pos", "name", "price")


CHANGES = f"""st AS (SELECT *, {DIFF_STATE} AS state FROM cell),
both_cells AS (SELECT b.app_id, b.region, b.item_count AS before_count, a.item_count AS after_count, b.state AS before_state, a.state AS after_state,
    b.status AS before_status, a.status AS after_status FROM st b JOIN st a ON b.app_id = a.app_id AND b.region = a.region AND b.snap = 'before' AND a.snap = 'after'),
ver AS (SELECT app_id, region FROM both_cells WHERE before_state = 'verified' AND after_state = 'verified'),
bi AS (SELECT app_id, region, pos, name, price, row_number() OVER (PARTITION BY app_id, region, name, price ORDER BY pos) AS n FROM obs JOIN ver USING (app_id, region) WHERE snap = 'before'),
ai AS (SELECT app_id, region, pos, name, price, row_number() OVER (PARTITION BY app_id, region, name, price ORDER BY pos) AS n FROM obs JOIN ver USING (app_id, region) WHERE snap = 'after'),
bc AS (SELECT app_id, region, name, price, count(*) AS c FROM bi GROUP BY ALL), ac AS (SELECT app_id, region, name, price, count(*) AS c FROM ai GROUP BY ALL),
gone AS (SELECT app_id, region, name, price, pos, row_number() OVER (PARTITION BY app_id, region, name ORDER BY pos) AS k FROM bi LEFT JOIN ac USING (app_id, region, name, price) WHERE n > coalesce(c, 0)),
come AS (SELECT app_id, region, name, price, pos, row_number() OVER (PARTITION BY app_id, region, name ORDER BY pos) AS k FROM ai LEFT JOIN bc USING (app_id, region, name, price) WHERE n > coalesce(c, 0)),
chg AS (SELECT coalesce(g.app_id, c.app_id) AS app_id, coalesce(g.region, c.region) AS region, coalesce(g.name, c.name) AS name,
    CASE WHEN c.price IS NULL THEN 'removed' WHEN g.price IS NULL THEN 'added' ELSE 'updated' END AS kind,
    g.price AS before_price, c.price AS after_price, coalesce(g.pos, c.pos) AS seq
  FROM gone g FULL JOIN come c ON g.app_id = c.app_id AND g.region = c.region AND g.name = c.name AND g.k = c.k),
per AS (SELECT app_id, region, count(*) FILTER (kind = 'updated') AS updated, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'added') AS added FROM chg GROUP BY ALL),
dif AS (SELECT 'region-items-changed' AS type, b.*, coalesce(updated, 0) AS updated, coalesce(removed, 0) AS removed, coalesce(added, 0) AS added
  FROM both_cells b LEFT JOIN per USING (app_id, region) WHERE per.app_id IS NOT NULL OR before_state <> after_state)"""


@query("pair_updates", "O74", f"WITH {OBS}, {CHANGES} SELECT * FROM chg")
def _pair(spark: SparkSession, sf: str) -> DataFrame:
    return changes(sides(spark, sf))


@query(
    "catalog_diff",
    "O75",
    """WITH b AS (SELECT DISTINCT (l_partkey % 300)::VARCHAR AS app_id, l_suppkey::VARCHAR AS region FROM lineitem WHERE l_returnflag <> 'A' AND l_partkey % 300 < 290),
      a AS (SELECT DISTINCT (l_partkey % 300)::VARCHAR AS app_id, l_suppkey::VARCHAR AS region FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey % 300 >= 10),
      u AS (SELECT coalesce(a.app_id, b.app_id) AS app_id, coalesce(a.region, b.region) AS region, b.app_id IS NOT NULL AS old, a.app_id IS NOT NULL AS new
        FROM b FULL JOIN a ON a.app_id = b.app_id AND a.region = b.region),
      s AS (SELECT app_id, bool_or(old) AS o, bool_or(new) AS n FROM u GROUP BY ALL)
    SELECT CASE WHEN n THEN 'app-added' ELSE 'app-removed' END AS type, app_id, NULL AS region,
      coalesce(CASE WHEN o AND app_id::INTEGER % 3 > 0 THEN 'Old ' || app_id END, CASE WHEN n AND app_id::INTEGER % 2 > 0 THEN 'New ' || app_id END, app_id) AS app_name FROM s WHERE NOT (o AND n)
    UNION ALL SELECT CASE WHEN new THEN 'region-added' ELSE 'region-removed' END, app_id, region, CASE WHEN app_id::INTEGER % 2 > 0 THEN 'New ' || app_id END
      FROM u JOIN s USING (app_id) WHERE o AND n AND NOT (old AND new)""",
)
def _catalog_diff(spark: SparkSession, sf: str) -> DataFrame:
    line = fx.table(spark, sf, "lineitem").withColumn("app", F.col("l_partkey") % 300)
    pair = [F.col("app").cast("string").alias("app_id"), F.col("l_suppkey").cast("string").alias("region")]
    before = line.filter("l_returnflag <> 'A' AND app < 290").select(*pair)
    newer = line.filter("l_returnflag <> 'R' AND app >= 10").select(*pair)
    number = F.col("app_id").cast("int")

    def names(rows: DataFrame, word: str, apart: int) -> DataFrame:
        """Some apps have no name."""
        name = F.when(number % apart > 0, F.concat(F.lit(word), "app_id"))
        return rows.select("app_id").distinct().withColumn("matched_name", name)

    return diff.name_apps(diff.catalog_diff(before, newer), names(before, "Old ", 3), names(newer, "New ", 2))


@query("snapshot_diff", "O76", f"WITH {OBS}, {PAGES}, {CHANGES} SELECT dif.*, matched_name AS app_name FROM dif LEFT JOIN app_page USING (app_id)")
def _snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    side = sides(spark, sf)
    found = diff.snapshot_diff(side["before_cells"], side["after_cells"], changes(side))
    pages = fx.app_pages(spark, sf)
    return diff.name_apps(found, pages.withColumn("matched_name", F.col("query")), pages)


@query(
    "snapshot_diff_itself",
    "O76",
    f"WITH {OBS} SELECT 0::BIGINT AS changed_cells, count(*) AS rows FROM obs WHERE snap = 'before'",
)
def _no_diff(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot compared with itself in another order shows no change."""
    side = sides(spark, sf)
    cells, items = side["before_cells"], side["before_items"]
    shuffled = items.withColumn("pos", F.xxhash64("pos").bitwiseAND(F.lit(2**62 - 1)))
    none = diff.snapshot_diff(cells, cells, diff.item_changes(cells, cells, items, shuffled, fx.pos_range()))
    count = items.agg(n_rows())
    return none.agg(F.count(F.lit(1)).alias("changed_cells")).withColumn("rows", count.scalar())


# Fingerprint per app: hashes of rows, summed in four 60-bit words.
WORDS = ", ".join(f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT::HUGEINT) AS w{i}" for i in range(4))
FINGERPRINT = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY app_id, region, kind ORDER BY seq) - 1 AS place FROM chg),
digests AS (SELECT app_id, 1 AS cell, sha256(concat_ws(chr(0), type, app_id, region, before_count, after_count, before_status, after_status)) AS d FROM dif
  UNION ALL SELECT app_id, 0, sha256(concat_ws(chr(0), kind, app_id, region, name, coalesce(before_price, chr(1)), coalesce(after_price, chr(1)), place)) FROM placed),
sums AS (SELECT app_id, sum(cell)::BIGINT AS change_count, count(*) AS n, {WORDS} FROM digests GROUP BY ALL),
prints AS (SELECT app_id, change_count, change_count > 0 AS changed,
    CASE WHEN change_count > 0 THEN substr(sha256(concat_ws('|', n, w0, w1, w2, w3)), 1, 20) ELSE 'none' END AS fingerprint FROM sums)"""


@query("diff_fingerprint", "O77", f"WITH {OBS}, {CHANGES}, {FINGERPRINT} SELECT * FROM prints")
def _fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(sides(spark, sf))


def fingerprints(side: dict[str, DataFrame]) -> DataFrame:
    """One fingerprint per app."""
    rows = stored(changes(side))
    cells = diff.snapshot_diff(side["before_cells"], side["after_cells"], rows)
    keyed = cells.withColumn("__app", F.col("app_id")), rows.withColumn("__app", F.col("app_id"))
    seq_range = F.floor(F.col("seq") / F.lit(fx.POS_RANGE)).cast("bigint")
    return diff.diff_fingerprint(*keyed, ["__app"], seq_range).withColumnRenamed("__app", "app_id")


# A second pass over the same change, disturbed for apps of odd number.
SECOND = """second AS (SELECT app_id, changed AND app_id::INTEGER % 5 <> 0 AS changed,
    CASE WHEN app_id::INTEGER % 5 = 0 THEN 'none' WHEN app_id::INTEGER % 2 = 1 THEN reverse(fingerprint) ELSE fingerprint END AS fingerprint FROM prints)"""


def second_pass(first: DataFrame) -> DataFrame:
    number = F.col("app_id").cast("int")
    return first.select(
        "app_id", (F.col("changed") & (number % 5 != 0)).alias("changed"),
        F.when(number % 5 == 0, "none").when(number % 2 == 1, F.reverse("fingerprint")).otherwise(F.col("fingerprint"))
        .alias("fingerprint"),
    )


@query(
    "confirm_change",
    "O78",
    f"""WITH {OBS}, {CHANGES}, {FINGERPRINT}, {SECOND} SELECT app_id, p.changed AND s.changed AND p.fingerprint <> 'none' AND p.fingerprint = s.fingerprint AS confirmed,
      s.fingerprint FROM prints p JOIN second s USING (app_id)""",
)
def _confirm(spark: SparkSession, sf: str) -> DataFrame:
    first = stored(fingerprints(sides(spark, sf)))
    return diff.confirm_change(first, second_pass(first), ["app_id"])


LOG = """log AS (SELECT 'e' || o_orderkey AS entry_id, o_orderdate::TIMESTAMP AS published_at, o_custkey % 4 AS change_count FROM orders WHERE o_orderstatus <> 'P'),
fresh AS (SELECT 'e' || o_orderkey AS entry_id, o_orderdate::TIMESTAMP + INTERVAL 1 DAY AS published_at, o_custkey % 4 AS change_count FROM orders WHERE o_orderstatus <> 'F')"""


def logs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("entry_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("published_at"), (F.col("o_custkey") % 4).alias("change_count"),
        "o_orderstatus",
    )
    later = F.col("published_at") + F.expr("INTERVAL 1 DAY")
    log = orders.filter("o_orderstatus <> 'P'").drop("o_orderstatus")
    return log, orders.filter("o_orderstatus <> 'F'").drop("o_orderstatus").withColumn("published_at", later)


def shown_log(entries: DataFrame) -> DataFrame:
    return entries.select("entry_id", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "change_count")


@query(
    "latest_n",
    "O72",
    f"""WITH {LOG} SELECT entry_id, strftime(published_at, '%Y-%m-%d') AS day, change_count FROM log WHERE change_count > 0 ORDER BY published_at DESC, entry_id DESC LIMIT 30""",
)
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    log, _ = logs(spark, sf)
    return shown_log(diff.latest_n(log, 30))


@query(
    "append_change_log",
    "O79",
    f"""WITH {LOG}, u AS (SELECT * FROM log UNION ALL SELECT * FROM fresh WHERE entry_id NOT IN (SELECT entry_id FROM log))
    SELECT entry_id, strftime(published_at, '%Y-%m-%d') AS day, change_count FROM u WHERE change_count > 0""",
)
def _append(spark: SparkSession, sf: str) -> DataFrame:
    log, fresh = logs(spark, sf)
    return shown_log(diff.append_change_log(log, fresh))


@query(
    "append_log_changes",
    "O79",
    f"""WITH {OBS}, {PAGES}, {CHANGES}, named AS (SELECT d.*, matched_name AS app_name, CASE WHEN d.app_id::INTEGER % 4 = 0 THEN 'old' ELSE 'new' END AS entry_id
        FROM dif d LEFT JOIN app_page USING (app_id)),
      rows AS (SELECT entry_id, type, app_id, app_name, region, before_state, after_state, NULL AS kind, NULL AS name, NULL AS before_price, NULL AS after_price FROM named
        UNION ALL SELECT entry_id, type, n.app_id, app_name, n.region, before_state, after_state, kind, name, before_price, after_price FROM named n JOIN chg USING (app_id, region))
    SELECT entry_id, type, app_id, app_name, region, before_state, after_state, kind, name, count(*) AS rows FROM rows WHERE app_name IS NOT NULL GROUP BY ALL""",
)
def _log_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The changes of an entry the log has, and those of a new one; a repeated entry adds nothing."""
    side = sides(spark, sf)
    rows = stored(changes(side))
    pages = fx.app_pages(spark, sf)
    cells = diff.name_apps(diff.snapshot_diff(side["before_cells"], side["after_cells"], rows), pages, pages)
    entry = F.when(F.col("app_id").cast("int") % 4 == 0, "old").otherwise("new")
    found = stored(diff.entry_changes(entry, cells, rows))
    log = spark.range(1).select(F.lit("old").alias("entry_id"))
    both = diff.append_log_changes(log, found.filter("entry_id = 'old'"), found)
    return both.groupBy(*[c for c in both.columns if "price" not in c]).agg(n_rows())


@query(
    "notification",
    "O80",
    f"""WITH {OBS}, {PAGES}, {CHANGES}, c AS (SELECT dif.*, coalesce(matched_name, dif.app_id) AS app_name, row_number() OVER (ORDER BY app_id, region) AS place FROM dif LEFT JOIN app_page USING (app_id)),
      t AS (SELECT *, row_number() OVER (PARTITION BY app_id, region, kind ORDER BY seq, name) AS n,
        CASE kind WHEN 'updated' THEN name || ' ' || before_price || '→' || after_price WHEN 'added' THEN '新增 ' || name || ' ' || after_price ELSE '移除 ' || name || ' ' || before_price END AS s FROM chg),
      p AS (SELECT app_id, region, max(s) FILTER (kind = 'updated' AND n = 1) AS u1, max(s) FILTER (kind = 'updated' AND n = 2) AS u2,
        max(s) FILTER (kind = 'added' AND n = 1) AS a1, max(s) FILTER (kind = 'removed' AND n = 1) AS r1 FROM t GROUP BY ALL),
      l AS (SELECT place, app_name || ' / ' || upper(region) || '：' || concat_ws('，', CASE WHEN before_state <> after_state THEN '状态 ' || before_state || '→' || after_state END, u1, u2,
        CASE WHEN updated > 2 THEN '另有 ' || (updated - 2) || ' 个套餐调价' END, a1, CASE WHEN added > 1 THEN '另新增 ' || (added - 1) || ' 项' END,
        r1, CASE WHEN removed > 1 THEN '另移除 ' || (removed - 1) || ' 项' END) AS line FROM c LEFT JOIN p USING (app_id, region) WHERE place <= 8)
    SELECT 0::BIGINT AS place, '发现 ' || count(*) || ' 个应用/地区发生变化：' AS line FROM c UNION ALL SELECT * FROM l
    UNION ALL SELECT 9, '另有 ' || (count(*) - 8) || ' 处变化' FROM c HAVING count(*) > 8 UNION ALL SELECT 10, '系统会短时复查；两次结果一致后自动发布。'""",
)
def _notification(spark: SparkSession, sf: str) -> DataFrame:
    side = sides(spark, sf)
    rows = stored(changes(side))
    pages = fx.app_pages(spark, sf).withColumn("matched_name", F.coalesce("matched_name", "app_id"))
    found = diff.snapshot_diff(side["before_cells"], side["after_cells"], rows)
    return diff.notification(stored(diff.name_apps(found, pages, pages)), rows)


@query(
    "change_detail_lines",
    "O80",
    f"""WITH {OBS}, {CHANGES} SELECT app_id, region, kind, seq, CASE kind WHEN 'updated' THEN '「' || name || '」' || before_price || ' → ' || after_price
      WHEN 'removed' THEN '移除「' || name || ' · ' || before_price || '」' ELSE '新增「' || name || ' · ' || after_price || '」' END AS line FROM chg""",
)
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return diff.detail_lines(changes(sides(spark, sf)))


@query(
    "change_summary",
    "O80",
    f"""WITH {OBS}, {CHANGES}, t AS (SELECT *, row_number() OVER (PARTITION BY app_id, region, kind ORDER BY seq, name) AS n,
        CASE kind WHEN 'updated' THEN name || ' ' || before_price || '→' || after_price WHEN 'added' THEN '新增 ' || name || ' ' || after_price ELSE '移除 ' || name || ' ' || before_price END AS s FROM chg),
      p AS (SELECT app_id, region, max(s) FILTER (kind = 'updated' AND n = 1) AS u1, max(s) FILTER (kind = 'updated' AND n = 2) AS u2,
        max(s) FILTER (kind = 'added' AND n = 1) AS a1, max(s) FILTER (kind = 'removed' AND n = 1) AS r1 FROM t GROUP BY ALL)
    SELECT app_id, region, concat_ws('，', CASE WHEN before_state <> after_state THEN '状态 ' || before_state || '→' || after_state END, u1, u2,
      CASE WHEN updated > 2 THEN '另有 ' || (updated - 2) || ' 个套餐调价' END, a1, CASE WHEN added > 1 THEN '另新增 ' || (added - 1) || ' 项' END,
      r1, CASE WHEN removed > 1 THEN '另移除 ' || (removed - 1) || ' 项' END) AS line FROM dif LEFT JOIN p USING (app_id, region)""",
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    side = sides(spark, sf)
    rows = stored(changes(side))
    return diff.short_lines(diff.snapshot_diff(side["before_cells"], side["after_cells"], rows), rows)


@query(
    "change_cell_lines",
    "O80",
    f"""WITH {OBS}, {CHANGES} SELECT app_id, region, concat_ws('；', CASE WHEN before_count <> after_count THEN '套餐 ' || before_count || ' → ' || after_count END,
      CASE WHEN before_state <> after_state THEN '状态 ' || before_state || ' → ' || after_state END) AS line FROM dif""",
)
def _cell_lines(spark: SparkSession, sf: str) -> DataFrame:
    side = sides(spark, sf)
    return diff.cell_lines(diff.snapshot_diff(side["before_cells"], side["after_cells"], changes(side)))


# Carry-forward. The declared count is wrong in one market, so that some
# populated cells are not publishable.
DECLARED = "item_count + CASE WHEN ord % 9 = 4 AND snap = 'after' THEN 1 ELSE 0 END"
PUBLISHABLE = f"""({DECLARED} = item_count AND CASE WHEN status IN ('iap-section-missing', 'official-price-page-missing', 'error:HTTP 404')
  THEN item_count = 0 ELSE status LIKE 'ok-%' AND item_count > 0 END)"""
RESOLVED = f"""pc AS (SELECT *, {PUBLISHABLE} AS pub FROM cell),
res0 AS (SELECT c.app_id, c.region, c.ord, c.pub, c.status AS cs, c.item_count AS ci, c.identity_status AS cid, p.status AS ps, p.item_count AS pi,
    coalesce(p.status = 'ok-structured', FALSE) AND c.status <> 'ok-structured' AND coalesce(c.identity_status, '') <> '' AS keep
  FROM pc c LEFT JOIN pc p ON p.snap = 'before' AND p.pub AND p.app_id = c.app_id AND p.region = c.region WHERE c.snap = 'after'),
res1 AS (SELECT *, CASE WHEN pub AND NOT keep THEN 'candidate' WHEN ps IS NOT NULL THEN 'previous' ELSE 'defer' END AS choice FROM res0),
res AS (SELECT app_id, region, choice, CASE WHEN pub AND keep THEN 'identity:' || cid WHEN NOT pub THEN cs END AS reason,
    CASE choice WHEN 'candidate' THEN cs WHEN 'previous' THEN ps END AS status, CASE choice WHEN 'candidate' THEN ci WHEN 'previous' THEN pi END AS item_count FROM res1)"""


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    wrong = (F.col("ord") % 9 == 4) & (F.col("snap") == "after")
    cells = fx.cells(spark, sf).select(
        "snap", *CELL, "status", "identity_status",
        (F.col("item_count") + F.when(wrong, 1).otherwise(0)).alias("declared"), F.col("item_count").alias("actual"),
    )
    return carry.resolve_fallback(cells.filter("snap = 'after'"), cells.filter("snap = 'before'"))


@query("resolve_fallback", "O41", f"WITH {OBS}, {RESOLVED} SELECT * FROM res")
def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf)


METADATA = """cat AS (SELECT (100000 + p_partkey)::VARCHAR AS app_id, p_partkey AS k, p_name AS n, p_brand AS b, p_type AS t FROM part),
md AS (SELECT app_id, CASE WHEN k % 7 = 0 THEN 'inline' WHEN k % 3 = 0 THEN 'lookup' WHEN k % 2 = 0 THEN 'previous' ELSE 'deferred' END AS origin, k, n, b, t FROM cat)"""


@query(
    "resolve_metadata",
    "O42",
    f"""WITH {METADATA} SELECT app_id, origin, coalesce(CASE WHEN k % 5 = 0 THEN 'q' || k END, CASE WHEN origin <> 'deferred' THEN origin || ' ' || n END) AS query,
      CASE WHEN origin <> 'deferred' THEN origin || ' ' || n END AS matched_name, CASE WHEN origin <> 'deferred' THEN b END AS developer,
      CASE WHEN origin <> 'deferred' THEN t END AS category, CASE WHEN origin <> 'deferred' THEN CASE WHEN k % 4 = 0 THEN 'G' || k ELSE '其他应用' END END AS catalog_group FROM md""",
)
def _resolve_metadata(spark: SparkSession, sf: str) -> DataFrame:
    part = fx.table(spark, sf, "part").withColumn("app_id", (F.col("p_partkey") + 100000).cast("string"))
    key = F.col("p_partkey")

    def named(origin: str) -> list:
        return [
            F.concat(F.lit(f"{origin} "), "p_name").alias("matched_name"), F.col("p_brand").alias("developer"),
            F.col("p_type").alias("category"),
        ]

    text = key.cast("string")
    catalog = part.select(
        "app_id", F.when(key % 7 == 0, F.struct(*named("inline"))).alias("inline"),
        F.when(key % 5 == 0, F.concat(F.lit("q"), text)).alias("query"),
        F.when(key % 4 == 0, F.concat(F.lit("G"), text)).alias("configured_group"),
    )
    found = part.filter(key % 3 == 0).select("app_id", *named("lookup"))
    previous = part.filter(key % 2 == 0).select("app_id", *named("previous"))
    return carry.resolve_metadata(catalog, found, previous)


@query(
    "drop_deferred",
    "O42",
    f"""WITH {OBS}, {RESOLVED} SELECT * FROM res WHERE app_id NOT IN (SELECT app_id FROM res WHERE choice = 'defer')""",
)
def _drop_deferred(spark: SparkSession, sf: str) -> DataFrame:
    return carry.drop_deferred(resolved(spark, sf))


@query(
    "run_report",
    "O61",
    f"""WITH {OBS}, {RESOLVED} SELECT CASE choice WHEN 'previous' THEN 'fallback' ELSE 'deferred' END AS kind, reason, count(*) AS cells, count(DISTINCT app_id) AS apps
    FROM res WHERE choice <> 'candidate' GROUP BY ALL""",
)
def _report(spark: SparkSession, sf: str) -> DataFrame:
    return carry.run_report(resolved(spark, sf))


@query(
    "report_cells",
    "O61",
    f"""WITH {OBS}, {RESOLVED} SELECT CASE choice WHEN 'previous' THEN 'fallback' ELSE 'deferred' END AS kind, app_id, region, reason FROM res WHERE choice <> 'candidate'""",
)
def _report_cells(spark: SparkSession, sf: str) -> DataFrame:
    return carry.report_cells(resolved(spark, sf))


@query(
    "stamp_verified",
    "O81",
    """WITH cur AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN '2026-01-0' || (p_partkey % 9 + 1) END AS v FROM part),
      held AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
      prev AS (SELECT p_partkey AS k, coalesce(CASE WHEN p_partkey % 3 = 0 THEN '2026-02-0' || (p_partkey % 9 + 1) END, '2026-03-01') AS v FROM part WHERE p_partkey % 10 <> 0)
    SELECT (100000 + cur.k)::VARCHAR AS app_id, CASE WHEN held.k IS NOT NULL THEN coalesce(prev.v, cur.v, '2026-03-01') ELSE '2026-04-01' END AS verified_at
    FROM cur LEFT JOIN held USING (k) LEFT JOIN prev USING (k)""",
)
def _stamp(spark: SparkSession, sf: str) -> DataFrame:
    part = fx.table(spark, sf, "part").withColumn("app_id", (F.col("p_partkey") + 100000).cast("string"))
    key = F.col("p_partkey")
    digit = (key % 9 + 1).cast("string")
    current = part.select("app_id", F.when(key % 4 == 0, F.concat(F.lit("2026-01-0"), digit)).alias("verified_at"))
    previous = part.filter(key % 10 != 0).select(
        "app_id", F.when(key % 3 == 0, F.concat(F.lit("2026-02-0"), digit)).alias("verified_at")
    )
    held = fx.table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_linenumber = 1").select(
        (F.col("l_partkey") + 100000).cast("string").alias("app_id")
    )
    return carry.stamp_verified(current, previous, held, F.lit("2026-04-01"), F.lit("2026-03-01"))


@query(
    "retain_subset",
    "O82",
    """SELECT (100000 + p_partkey)::VARCHAR AS app_id, p_name, coalesce(CASE WHEN p_partkey % 4 = 0 THEN '2026-01-02' END, '2026-03-01') AS verified_at
    FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)""",
)
def _retain(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    snapshot = fx.table(spark, sf, "part").select(
        (key + 100000).cast("string").alias("app_id"), "p_name", F.when(key % 4 == 0, "2026-01-02").alias("verified_at")
    )
    ids = fx.table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(
        (F.col("l_partkey") + 100000).cast("string").alias("app_id")
    )
    return carry.retain_subset(snapshot, ids, F.lit("2026-03-01"))


BATCHES = """app AS (SELECT l_partkey AS k, max(l_quantity > 49)::BOOLEAN AS changed, max(l_discount > 0.095 AND l_quantity < 3)::BOOLEAN AS failed, count(*) AS n FROM lineitem GROUP BY ALL),
b1 AS (SELECT k // 4 AS batch, bool_or(failed) AS failed, bool_or(changed) AS changed, 'f' || sum(n) AS fp FROM app GROUP BY ALL),
b2 AS (SELECT batch, batch % 11 = 0 AS failed, batch % 7 <> 0 AS changed, CASE WHEN batch % 5 = 0 THEN 'other' ELSE fp END AS fp FROM b1),
acc0 AS (SELECT b1.batch, b1.failed AS f1, NOT b1.failed AND b1.changed AS needs, b2.failed AS f2, b2.changed AS c2, b1.fp = b2.fp AS same FROM b1 JOIN b2 USING (batch)),
acc AS (SELECT batch, needs AND NOT f2 AND c2 AND same AS confirmed, f1 OR (needs AND f2) AS failed,
    needs AND NOT (f1 OR f2) AND NOT (c2 AND same) AS mismatch FROM acc0),
taken AS (SELECT *, CASE WHEN confirmed THEN 'second' WHEN failed OR mismatch THEN 'previous' ELSE 'first' END AS take,
    CASE WHEN confirmed THEN 'confirmed-change' WHEN failed THEN 'fallback' WHEN mismatch THEN 'unconfirmed' ELSE 'verified-unchanged' END AS status FROM acc)"""


def batches(spark: SparkSession, sf: str) -> DataFrame:
    apps = fx.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.max(F.col("l_quantity") > 49).alias("changed"),
        F.max((F.col("l_discount") > 0.095) & (F.col("l_quantity") < 3)).alias("failed"), F.count(F.lit(1)).alias("n"),
    )
    first = apps.groupBy(carry.batch_of(F.col("l_partkey"), 4).alias("batch")).agg(
        F.max("failed").alias("failed"), F.max("changed").alias("changed"),
        F.concat(F.lit("f"), F.sum("n").cast("string")).alias("fingerprint"),
    )
    first, batch = stored(first), F.col("batch")
    second = first.select(
        "batch", (batch % 11 == 0).alias("failed"), (batch % 7 != 0).alias("changed"),
        F.when(batch % 5 == 0, "other").otherwise(F.col("fingerprint")).alias("fingerprint"),
    )
    return carry.accept_batches(first, second)


@query("accept_batches", "O83", f"WITH {BATCHES} SELECT * FROM taken")
def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return carry.batch_status(batches(spark, sf))


@query(
    "stitch_batches",
    "O83",
    f"""WITH {BATCHES} SELECT (100000 + p_partkey)::VARCHAR AS app_id, take AS taken_from, CASE take WHEN 'first' THEN p_name WHEN 'second' THEN p_brand ELSE p_type END AS content
    FROM part JOIN taken ON p_partkey // 4 = batch""",
)
def _stitch(spark: SparkSession, sf: str) -> DataFrame:
    part = fx.table(spark, sf, "part")
    key = F.col("p_partkey")

    def run(content: str) -> DataFrame:
        return part.select(
            carry.batch_of(key, 4).alias("batch"), (key + 100000).cast("string").alias("app_id"),
            F.col(content).alias("content"),
        )

    taken = stored(batches(spark, sf))
    return carry.stitch_batches(taken, run("p_name"), run("p_brand"), run("p_type")).drop("batch")


RECORDS = f"""{IDENTITY}, su AS (SELECT rec.*, coalesce(plan_count, 0) AS pc, coalesce(structured_plans, 0) AS sp, coalesce(unresolved_plans, 0) AS up FROM rec LEFT JOIN counted USING (app_id)),
oldr AS (SELECT app_id, CASE WHEN app_id::INTEGER % 4 = 0 THEN 'snapshot' ELSE 'live' END AS source, pc, sp, CASE WHEN app_id::INTEGER % 3 = 0 THEN up ELSE 0 END AS up, degraded_regions - 1 AS dg FROM su WHERE app_id::INTEGER % 10 <> 9),
newr AS (SELECT app_id, CASE WHEN app_id::INTEGER % 5 = 1 THEN 0 ELSE sp END AS sp, CASE WHEN app_id::INTEGER % 2 = 0 THEN up ELSE 0 END AS up, degraded_regions - app_id::INTEGER % 3 AS dg FROM su)"""


@query(
    "select_record",
    "O86",
    f"""WITH {OBS}, {RECORDS}, j AS (SELECT n.*, coalesce(NOT (o.source = 'snapshot' AND o.sp < o.pc) AND o.up = 0, FALSE) AS usable, o.sp AS osp, o.dg AS odg FROM newr n LEFT JOIN oldr o USING (app_id))
    SELECT app_id, CASE WHEN up > 0 THEN CASE WHEN usable THEN 'retain' ELSE 'reject' END WHEN usable AND ((osp > 0 AND sp = 0) OR dg > odg) THEN 'retain' ELSE 'accept' END AS action,
      CASE WHEN up > 0 THEN 'curated-identity-degraded' WHEN usable AND osp > 0 AND sp = 0 THEN 'structured-identity-regressed' WHEN usable AND dg > odg THEN 'regional-identity-degraded'
        ELSE 'identity-quality-accepted' END AS reason FROM j""",
)
def _select_record(spark: SparkSession, sf: str) -> DataFrame:
    now, number = stored(summaries(spark, sf)), F.col("app_id").cast("int")
    previous = now.filter(number % 10 != 9).select(
        "app_id", F.when(number % 4 == 0, "snapshot").otherwise("live").alias("source"), "plan_count",
        "structured_plans", F.when(number % 3 == 0, F.col("unresolved_plans")).otherwise(0).alias("unresolved_plans"),
        (F.col("degraded_regions") - 1).alias("degraded_regions"),
    )
    candidate = now.select(
        "app_id", F.when(number % 5 == 1, 0).otherwise(F.col("structured_plans")).alias("structured_plans"),
        F.when(number % 2 == 0, F.col("unresolved_plans")).otherwise(0).alias("unresolved_plans"),
        (F.col("degraded_regions") - number % 3).alias("degraded_regions"),
    )
    return carry.select_record(previous, candidate)


@query(
    "retry_targets",
    "O87",
    f"""WITH {OBS} SELECT app_id, region, status, row_number() OVER (PARTITION BY app_id ORDER BY ord, region) AS attempt FROM cell
    WHERE snap = 'after' AND ((status LIKE 'error:%' AND status <> 'error:HTTP 404') OR (status <> 'ok-structured' AND coalesce(identity_status, '') <> '')) QUALIFY attempt <= 6""",
)
def _retry(spark: SparkSession, sf: str) -> DataFrame:
    return carry.retry_targets(newer_cells(spark, sf)).select(*CELL, "status", "attempt")


@query(
    "upsert_regions",
    "O88",
    f"""WITH {OBS}, b AS (SELECT * FROM cell WHERE snap = 'before'), r AS (SELECT * FROM cell WHERE snap = 'after' AND status = 'ok-structured')
    SELECT b.app_id, b.region, b.ord, CASE WHEN r.app_id IS NOT NULL THEN r.status ELSE b.status END AS status,
      CASE WHEN r.app_id IS NOT NULL THEN r.identity_status ELSE b.identity_status END AS identity_status,
      CASE WHEN r.app_id IS NOT NULL THEN r.item_count ELSE b.item_count END AS item_count, r.app_id IS NOT NULL AS replaced
    FROM b LEFT JOIN r ON r.app_id = b.app_id AND r.region = b.region""",
)
def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.cells(spark, sf)
    good = cells.filter("snap = 'after' AND status = 'ok-structured'")
    return carry.upsert_regions(cells.filter("snap = 'before'"), good)


@query(
    "classify_outcome",
    "O92",
    f"""WITH {OBS}, a AS (SELECT app_id, region, status, item_count, CASE ord % 3 WHEN 0 THEN 'us-anchor-unavailable' WHEN 1 THEN 'us-plans-unavailable' ELSE 'timeout' END AS error FROM cell WHERE snap = 'after'),
      o AS (SELECT *, CASE WHEN error NOT IN ('us-anchor-unavailable', 'us-plans-unavailable') THEN 'refresh-failed' WHEN status = 'iap-section-missing' THEN 'web-iap-not-public'
        WHEN status = 'error:HTTP 404' OR (status LIKE 'ok-%' AND item_count > 0) THEN 'no-comparable-plans' ELSE 'refresh-failed' END AS outcome FROM a)
    SELECT *, CASE WHEN outcome = 'refresh-failed' THEN 503 ELSE 422 END::BIGINT AS http_status FROM o""",
)
def _outcome(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("ord") % 3
    error = F.when(kind == 0, "us-anchor-unavailable").when(kind == 1, "us-plans-unavailable").otherwise("timeout")
    anchors = newer_cells(spark, sf).select(*CELL, "status", "item_count", error.alias("error"))
    return carry.classify_outcome(anchors)
