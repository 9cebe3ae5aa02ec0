"""Queries for the rows of cells and the plans found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketladder.functions.plans import YEAR, MONTH
from marketladder.operators import items, plans
from marketladder.plans import fixtures as fx
from marketladder.plans.oracle_base import OBS, amount
from marketladder.plans.q_functions import BASE36_SQL, HASH_SQL, INFER_SQL, SLUG_SQL, _java_free
from marketladder.functions import plans as words
from marketladder.plans.registry import query
from marketladder.session import stored

CELL = ["snap", "app_id", "region"]

# Item texts with blanks around them, and empty ones in every 97th order.
MESSY = """messy AS (SELECT snap, app_id, region, pos, '  ' || name || chr(160) AS name,
    CASE WHEN (pos // 4194304) % 97 = 0 THEN ' ' ELSE price || ' ' END AS price FROM obs)"""


def messy(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.floor(F.col("pos") / 4194304) % 97 == 0
    return fx.observations(spark, sf).select(
        *CELL, "pos", F.concat(F.lit("  "), "name", F.lit(" ")).alias("name"),
        F.when(blank, " ").otherwise(F.concat("price", F.lit(" "))).alias("price"),
    )


@query(
    "normalize_items",
    "O35",
    f"""WITH {OBS}, {MESSY}, t AS (SELECT snap, app_id, region, pos, trim(trim(name, chr(160))) AS name, trim(price) AS price FROM messy)
    SELECT snap, app_id, region, name, price, min(pos) AS pos FROM t WHERE name <> '' AND price <> '' GROUP BY ALL""",
)
def _normalize(spark: SparkSession, sf: str) -> DataFrame:
    return items.normalize_items(messy(spark, sf), CELL)


@query(
    "exclude_items",
    "O36",
    f"""WITH {OBS}, listed AS (SELECT DISTINCT app_id, upper(p_type) AS name FROM
        (SELECT (100000 + p_partkey % 20)::VARCHAR AS app_id, p_type FROM part WHERE p_type IN ('SMALL', 'LARGE')))
    SELECT o.snap, o.app_id, o.region, o.name, count(*) AS rows FROM obs o
    LEFT JOIN listed l ON l.app_id = o.app_id AND lower(l.name) = lower(o.name) WHERE l.app_id IS NULL GROUP BY ALL""",
)
def _exclude(spark: SparkSession, sf: str) -> DataFrame:
    part = fx.table(spark, sf, "part")
    listed = part.filter(F.col("p_type").isin("SMALL", "LARGE")).select(
        (F.col("p_partkey") % 20 + 100000).cast("string").alias("app_id"), F.upper("p_type").alias("name")
    )
    kept = items.exclude_items(fx.observations(spark, sf), listed)
    return kept.groupBy(*CELL, "name").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "dedupe_by_product",
    "O37",
    f"""WITH {OBS} SELECT snap, app_id, region, product_id, name, price, pos FROM obs WHERE product_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY snap, app_id, region, product_id ORDER BY pos, price, name) = 1""",
)
def _dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return items.dedupe_by_product(fx.observations(spark, sf), CELL).select(
        *CELL, "product_id", "name", "price", "pos"
    )


@query(
    "select_reusable",
    "O38",
    f"""WITH {OBS}, tasks AS (SELECT app_id, region, app_id::INTEGER % 7 = 0 AS has_exclusions, ord % 11 = 5 AS has_regional_id
        FROM (SELECT DISTINCT app_id, region, ord FROM raw))
    SELECT t.*, NOT has_exclusions AND NOT has_regional_id AND coalesce(status IN ('iap-section-missing', 'official-price-page-missing', 'error:HTTP 404')
        OR (status LIKE 'ok-%' AND item_count > 0), FALSE) AS reuse
    FROM tasks t LEFT JOIN (SELECT * FROM cell WHERE snap = 'before') c USING (app_id, region)""",
)
def _reusable(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.cells(spark, sf)
    tasks = cells.select("app_id", "region", "ord").distinct().select(
        "app_id", "region", (F.col("app_id").cast("int") % 7 == 0).alias("has_exclusions"),
        (F.col("ord") % 11 == 5).alias("has_regional_id"),
    )
    return items.select_reusable(cells.filter("snap = 'before'"), tasks)


NUMBERED = """num AS (SELECT *, row_number() OVER (PARTITION BY snap, app_id, region, name ORDER BY pos) - 1 AS occurrence FROM obs)"""


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return items.occurrence_number(fx.observations(spark, sf), CELL, fx.pos_range())


@query(
    "occurrence_number",
    "O63",
    f"WITH {OBS}, {NUMBERED} SELECT snap, app_id, region, name, pos, occurrence FROM num",
)
def _occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(spark, sf).select(*CELL, "name", "pos", "occurrence")


MAXIMA = """per AS (SELECT snap, app_id, region, ord, name, count(*) AS n, min(pos) AS p FROM obs GROUP BY ALL),
maxima AS (SELECT snap, app_id, name, max(n) AS max_count, min(ord) AS first_ord, arg_min(p, ord) AS first_pos FROM per GROUP BY ALL)"""


@query("max_occurrences", "O52", f"WITH {OBS}, {MAXIMA} SELECT * FROM maxima")
def _maxima(spark: SparkSession, sf: str) -> DataFrame:
    return items.max_occurrences(fx.observations(spark, sf), ["snap", "app_id"])


RATIO = f"""amt AS (SELECT *, {amount('price', None)} AS a FROM num),
ratios AS (SELECT j.snap, j.app_id, j.name, j.occurrence, j.a / z.a AS r FROM amt j JOIN amt z
  ON j.snap = z.snap AND j.app_id = z.app_id AND j.region = z.region AND j.name = z.name AND z.occurrence = 0
  WHERE j.occurrence > 0 AND j.a <> 0 AND z.a <> 0),
ratio AS (SELECT snap, app_id, name, occurrence, list_sort(list(r))[(count(*) // 2) + 1] AS ratio FROM ratios GROUP BY ALL)"""


@query("price_ratio_median", "O53", f"WITH {OBS}, {NUMBERED}, {RATIO} SELECT * FROM ratio")
def _ratio(spark: SparkSession, sf: str) -> DataFrame:
    return items.price_ratio_median(numbered(spark, sf), ["snap", "app_id"])


# Curated plans every app of the fixture has: id, label, period, names, number.
CURATED = [
    ("eco-monthly", "Economy", MONTH, ["ECONOMY Monthly", "ECONOMY"], 0),
    ("small-first", "Small", words.PUBLIC, ["SMALL"], 0),
    ("small-second", "SMALL", words.PUBLIC, ["SMALL"], 1),
    ("large-annual", "Large", YEAR, ["LARGE Annual", "LARGE Yearly"], 0),
    ("stale", "Stale", MONTH, ["NO SUCH ITEM"], 0),
    ("two-names", "Two", words.PUBLIC, ["STANDARD", "PROMO Monthly"], 2),
]
CURATED_SQL = (
    "curated AS (SELECT app_id, d.plan_id AS plan_id, d.label AS label, d.period AS period, d.aliases AS aliases, d.occurrence AS occurrence, "
    "d.curated_ord AS curated_ord FROM (SELECT DISTINCT app_id FROM obs), (SELECT unnest(["
    + ", ".join(
        f"{{'plan_id': '{i}', 'label': '{label}', 'period': '{p}', 'aliases': {a!r}, 'occurrence': {o}::BIGINT, 'curated_ord': {n}::BIGINT}}"
        for n, (i, label, p, a, o) in enumerate(CURATED)
    )
    + "]) AS d))"
)


def curated(observations: DataFrame) -> DataFrame:
    """The curated plans of each app."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("plan_id"), F.lit(label).alias("label"), F.lit(p).alias("period"),
                F.array(*[F.lit(a) for a in names]).alias("aliases"), F.lit(o).cast("bigint").alias("occurrence"),
                F.lit(n).cast("bigint").alias("curated_ord"),
            )
            for n, (i, label, p, names, o) in enumerate(CURATED)
        ]
    )
    return observations.select("app_id").distinct().select("app_id", F.explode(entries).alias("d")).select("app_id", "d.*")


def after(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered items of the newer snapshot, one row per product in a cell."""
    newer = fx.observations(spark, sf).filter("snap = 'after'")
    return stored(items.occurrence_number(stored(items.one_per_product(newer)), pos_range=fx.pos_range()))


# The newer snapshot with products listed once per structured cell.
AFTER = """newer AS (SELECT * EXCLUDE (rn) FROM (SELECT *, CASE WHEN product_id IS NULL THEN 1 ELSE
    row_number() OVER (PARTITION BY app_id, region, product_id ORDER BY pos, price, name) END AS rn FROM obs WHERE snap = 'after') WHERE rn = 1),
num AS (SELECT *, row_number() OVER (PARTITION BY app_id, region, name ORDER BY pos) - 1 AS occurrence FROM newer)"""

PERIOD_LABEL = "CASE billing_period WHEN 'P1M' THEN '月付' WHEN 'P1Y' THEN '年付' END"

DISCOVER = f"""{AFTER}, {CURATED_SQL},
kept AS (SELECT * FROM curated c WHERE EXISTS (SELECT 1 FROM num n WHERE n.app_id = c.app_id AND list_contains(c.aliases, n.name) AND n.occurrence = c.occurrence)),
pairs AS (SELECT app_id, name, occurrence, min(ord) AS mo FROM num GROUP BY ALL),
seen AS (SELECT app_id, name, min(ord) AS first_ord, arg_min(p, ord) AS first_pos FROM
  (SELECT app_id, region, ord, name, min(pos) AS p FROM num GROUP BY ALL) GROUP BY ALL),
amt AS (SELECT *, {amount('price', None)} AS a FROM num),
ratios AS (SELECT j.app_id, j.name, j.occurrence, j.a / z.a AS r FROM amt j JOIN amt z
  ON j.app_id = z.app_id AND j.region = z.region AND j.name = z.name AND z.occurrence = 0
  WHERE j.occurrence > 0 AND j.a <> 0 AND z.a <> 0),
annual AS (SELECT * FROM (SELECT app_id, name, occurrence, list_sort(list(r))[(count(*) // 2) + 1] AS ratio FROM ratios GROUP BY ALL)
  WHERE ratio BETWEEN 6 AND 15),
found AS (SELECT p.*, s.first_ord, s.first_pos, {INFER_SQL.replace('lower(name)', 'lower(p.name)')} AS by_name,
    EXISTS (SELECT 1 FROM curated c WHERE c.app_id = p.app_id AND list_contains(c.aliases, p.name)) AS known,
    EXISTS (SELECT 1 FROM annual a WHERE a.app_id = p.app_id AND a.name = p.name) AS has_annual,
    EXISTS (SELECT 1 FROM annual a WHERE a.app_id = p.app_id AND a.name = p.name AND a.occurrence = p.occurrence) AS is_annual
  FROM pairs p JOIN seen s ON s.app_id = p.app_id AND s.name = p.name
  WHERE NOT EXISTS (SELECT 1 FROM kept c WHERE c.app_id = p.app_id AND list_contains(c.aliases, p.name) AND c.occurrence = p.occurrence)),
hashed AS (SELECT *, {HASH_SQL.format("name || chr(0) || occurrence")} AS h FROM found),
all_plans AS (
  SELECT app_id, 'auto-' || {SLUG_SQL.format("name")} || '-' || (occurrence + 1) || '-' || {BASE36_SQL} AS plan_id, name AS label,
    CASE WHEN by_name <> '公开项目' THEN by_name WHEN known AND occurrence = 0 AND has_annual THEN '月付'
      WHEN known AND occurrence > 0 AND is_annual THEN '年付' ELSE '公开项目' END AS period,
    [name] AS aliases, occurrence, TRUE AS discovered, 0::BIGINT AS curated_ord, first_ord, first_pos FROM hashed
  UNION ALL SELECT app_id, plan_id, label, period, aliases, occurrence, FALSE, curated_ord, 0, 0 FROM kept),
anchor_items AS (SELECT * FROM num WHERE anchor),
numbered_alias AS (SELECT p.app_id, p.plan_id, a.product_id, a.offer_name, a.billing_period, a.family_id,
    row_number() OVER (PARTITION BY p.app_id, p.plan_id ORDER BY a.pos) - 1 AS k, p.occurrence
  FROM all_plans p JOIN anchor_items a ON a.app_id = p.app_id AND list_contains(p.aliases, a.name)),
enriched AS (SELECT p.app_id, p.plan_id, p.label, coalesce({PERIOD_LABEL.replace('billing_period', 'n.billing_period')}, p.period) AS period,
    p.aliases, p.occurrence, p.discovered, p.curated_ord, p.first_ord, p.first_pos, n.product_id, n.offer_name, n.billing_period, n.family_id
  FROM all_plans p LEFT JOIN numbered_alias n ON n.app_id = p.app_id AND n.plan_id = p.plan_id AND n.k = p.occurrence),
grouped AS (SELECT *, CASE WHEN period IN ('月付', '年付', '周付') THEN 'primary' WHEN period = '一次性' THEN 'other'
    WHEN regexp_matches(label || ' ' || list_aggregate(aliases, 'string_agg', ' '), '{_java_free(words.SECONDARY_WORDS)}') THEN 'other'
    WHEN regexp_matches(label || ' ' || list_aggregate(aliases, 'string_agg', ' '), '{_java_free(words.PRIMARY_WORDS)}') THEN 'primary' ELSE 'other' END AS display_group,
    count(*) OVER (PARTITION BY app_id, label, period) AS total,
    row_number() OVER (PARTITION BY app_id, label, period ORDER BY discovered, curated_ord, first_ord, first_pos, occurrence) AS n FROM enriched),
plan AS (SELECT app_id, plan_id, CASE WHEN total > 1 THEN label || ' #' || n ELSE label END AS label, period, aliases, occurrence, discovered,
    product_id, offer_name, billing_period, family_id, display_group, curated_ord, first_ord, first_pos FROM grouped)"""


def discovered(spark: SparkSession, sf: str) -> DataFrame:
    found = after(spark, sf)
    return plans.discover_plans(found, curated(found), F.col("anchor"), fx.pos_range())


SHOWN = ["app_id", "plan_id", "label", "period", "occurrence", "discovered", "product_id", "display_group"]


@query("discover_plans", "O64", f"WITH {OBS}, {DISCOVER} SELECT {', '.join(SHOWN)} FROM plan")
def _discover(spark: SparkSession, sf: str) -> DataFrame:
    return discovered(spark, sf).select(*SHOWN)


@query(
    "uncovered_items",
    "O48",
    f"""WITH {OBS}, {AFTER}, {CURATED_SQL} SELECT DISTINCT n.app_id, n.name, n.occurrence FROM num n
    WHERE NOT EXISTS (SELECT 1 FROM curated c WHERE c.app_id = n.app_id AND list_contains(c.aliases, n.name) AND c.occurrence = n.occurrence)""",
)
def _uncovered(spark: SparkSession, sf: str) -> DataFrame:
    found = after(spark, sf)
    return plans.uncovered_items(found, curated(found))


@query(
    "uncovered_after_discovery",
    "O48",
    f"""WITH {OBS}, {AFTER} SELECT app_id, count(DISTINCT (name, occurrence)) AS pairs, 0::BIGINT AS uncovered FROM num GROUP BY ALL""",
)
def _covered(spark: SparkSession, sf: str) -> DataFrame:
    found = after(spark, sf)
    left = plans.uncovered_items(found, plans.discover_plans(found, curated(found), F.col("anchor"), fx.pos_range()))
    open_pairs = left.groupBy("app_id").agg(F.count(F.lit(1)).alias("uncovered"))
    pairs = found.select("app_id", "name", "occurrence").distinct().groupBy("app_id").agg(
        F.count(F.lit(1)).alias("pairs")
    )
    return pairs.join(open_pairs, "app_id", "left").na.fill(0, ["uncovered"])


@query(
    "enrich_from_anchor",
    "O47",
    f"""WITH {OBS}, {AFTER}, {CURATED_SQL},
    asked AS (SELECT *, CASE curated_ord WHEN 0 THEN 'P1M' WHEN 3 THEN 'P1Y' END AS wanted_code FROM curated),
    a AS (SELECT *, {PERIOD_LABEL} AS a_period FROM num WHERE anchor),
    w AS (SELECT app_id, a_period, arg_min(product_id, pos) AS product_id FROM a WHERE a_period IS NOT NULL GROUP BY ALL),
    cnt AS (SELECT app_id, name, count(*) AS n FROM a GROUP BY ALL),
    names AS (SELECT app_id, plan_id, occurrence, unnest(aliases) AS name, generate_subscripts(aliases, 1) AS i FROM asked),
    best AS (SELECT names.app_id, plan_id, occurrence, arg_min(names.name, i) AS name, arg_min(n, i) AS n FROM names JOIN cnt USING (app_id, name) GROUP BY ALL),
    byname AS (SELECT best.app_id, plan_id, a.product_id, a.a_period, a.name FROM best JOIN a ON a.app_id = best.app_id AND a.name = best.name
      AND a.occurrence = CASE WHEN best.n = 1 THEN 0 ELSE best.occurrence END),
    j AS (SELECT asked.app_id, asked.plan_id, {PERIOD_LABEL.replace('billing_period', 'wanted_code')} AS wanted,
        w.product_id AS wp, byname.product_id AS np, byname.a_period AS nper, byname.name AS nname, w.a_period AS wper
      FROM asked LEFT JOIN w ON w.app_id = asked.app_id AND w.a_period = {PERIOD_LABEL.replace('billing_period', 'wanted_code')}
      LEFT JOIN byname ON byname.app_id = asked.app_id AND byname.plan_id = asked.plan_id)
    SELECT app_id, plan_id, coalesce(wp, np) AS product_id, coalesce(wanted, nper) AS match_period,
      coalesce(wanted, nper, CASE WHEN wper IS NULL THEN CASE WHEN regexp_matches(lower(nname), 'annual') THEN '年付' WHEN regexp_matches(lower(nname), 'monthly') THEN '月付'
        WHEN regexp_matches(lower(nname), 'credit') THEN '一次性' END END, '公开项目') AS period FROM j""",
)
def _enrich(spark: SparkSession, sf: str) -> DataFrame:
    found = after(spark, sf)
    asked = curated(found).select(
        "app_id", "plan_id", "aliases", "occurrence", F.lit(None).cast("string").alias("product_id"),
        F.when(F.col("curated_ord") == 0, "P1M").when(F.col("curated_ord") == 3, "P1Y").alias("billing_period"),
    )
    return plans.enrich_strict(asked, found.filter("anchor")).select(
        "app_id", "plan_id", "product_id", "match_period", "period"
    )


@query(
    "duplicate_alias_plans",
    "O59",
    f"""WITH {OBS}, {CURATED_SQL}, n AS (SELECT app_id, plan_id, unnest(aliases) AS alias FROM curated),
    s AS (SELECT app_id, alias FROM n GROUP BY ALL HAVING count(*) > 1)
    SELECT DISTINCT n.app_id, n.plan_id FROM n JOIN s USING (app_id, alias)""",
)
def _shared(spark: SparkSession, sf: str) -> DataFrame:
    return plans.duplicate_alias_plans(curated(fx.observations(spark, sf)))


@query(
    "number_ambiguous_labels",
    "O66",
    """WITH p AS (SELECT (100000 + p_partkey % 20)::VARCHAR AS app_id, p_partkey::VARCHAR AS plan_id, p_name AS label, p_type AS period, p_partkey AS o FROM part)
    SELECT app_id, plan_id, period, CASE WHEN count(*) OVER (PARTITION BY app_id, label, period) > 1
      THEN label || ' #' || row_number() OVER (PARTITION BY app_id, label, period ORDER BY o) ELSE label END AS label FROM p""",
)
def _labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "part").select(
        (F.col("p_partkey") % 20 + 100000).cast("string").alias("app_id"),
        F.col("p_partkey").cast("string").alias("plan_id"), F.col("p_name").alias("label"),
        F.col("p_type").alias("period"), F.col("p_partkey").alias("o"),
    )
    ranges = F.floor(F.col("o") / 65_536).cast("bigint")
    return plans.number_ambiguous_labels(rows, [F.col("o")], ranges).select("app_id", "plan_id", "period", "label")
