"""Carry verified data forward when a source fails; accept batches; merge records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketladder.functions.plans import PUBLIC
from marketladder.functions.status import is_identity_degraded, is_publishable, needs_retry
from marketladder.functions.text import catalog_group

CELL = ("app_id", "region")
RETRY_LIMIT = 6


def resolve_fallback(candidate: DataFrame, previous: DataFrame) -> DataFrame:
    """Choose candidate, previous cell or deferral per (app, market).

    Inputs: app_id, region, status, identity_status, declared, actual.  The
    result says which side's items to use, so item rows need only a semi join.
    """
    fields = ["status", "identity_status", "declared", "actual"]
    ok = is_publishable(F.col("status"), F.col("declared"), F.col("actual"))
    old = previous.filter(ok).select(*CELL, F.struct(*fields).alias("p"))
    new = candidate.select(*CELL, ok.alias("__ok"), F.struct(*fields).alias("c"))
    degraded = is_identity_degraded(F.col("c.status"), F.col("c.identity_status"))
    keep_old = F.coalesce(F.col("p.status") == "ok-structured", F.lit(False)) & degraded
    choice = (
        F.when(F.col("__ok") & ~keep_old, "candidate")
        .when(F.col("p").isNotNull(), "previous")
        .otherwise("defer")
    )
    reason = (
        F.when(F.col("__ok") & keep_old, F.concat(F.lit("identity:"), "c.identity_status"))
        .when(~F.col("__ok"), F.coalesce("c.status", F.lit("unknown-region-result")))
    )
    row = F.when(F.col("choice") == "candidate", F.col("c")).when(F.col("choice") == "previous", F.col("p"))
    return (
        new.join(old, [*CELL], "left")
        .withColumn("choice", choice)
        .withColumn("reason", reason)
        .withColumn("row", row)
        .select(
            *CELL, "choice", "reason", F.col("row.status").alias("status"),
            F.col("row.actual").alias("item_count"),
        )
    )


def drop_deferred(resolved: DataFrame) -> DataFrame:
    """A deferred cell takes its whole app out of the snapshot."""
    deferred = resolved.filter(F.col("choice") == "defer").select("app_id").distinct()
    return resolved.join(deferred, "app_id", "left_anti")


def resolve_metadata(catalog: DataFrame, found: DataFrame, previous: DataFrame) -> DataFrame:
    """Metadata from the catalog itself, else looked up, else the previous run.

    catalog: app_id, inline (struct or null), query, configured_group and, if
    inline metadata may name a group, inline_group; found / previous: app_id,
    matched_name, developer, category.
    """
    fields = ["matched_name", "developer", "category"]
    groups = [c for c in ("configured_group", "inline_group") if c in catalog.columns]
    seen = found.select("app_id", F.struct(*fields).alias("f"))
    old = previous.select("app_id", F.struct(*fields).alias("p"))
    chosen = F.coalesce("inline", "f", "p")
    origin = (
        F.when(F.col("inline").isNotNull(), "inline")
        .when(F.col("f").isNotNull(), "lookup")
        .when(F.col("p").isNotNull(), "previous")
        .otherwise("deferred")
    )
    return (
        catalog.join(seen, "app_id", "left")
        .join(old, "app_id", "left")
        .withColumn("m", chosen)
        .select(
            "app_id",
            origin.alias("origin"),
            F.coalesce("query", "m.matched_name").alias("query"),
            *[F.col(f"m.{c}").alias(c) for c in fields],
            F.when(F.col("m").isNotNull(), catalog_group(F.col("m.category"), F.coalesce(*groups))).alias(
                "catalog_group"
            ),
        )
    )


def run_report(resolved: DataFrame) -> DataFrame:
    """Fallbacks and deferrals per reason (the details are rows of ``resolved``)."""
    kind = F.when(F.col("choice") == "previous", "fallback").when(F.col("choice") == "defer", "deferred")
    return (
        resolved.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .groupBy("kind", "reason")
        .agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("app_id").alias("apps"))
    )


def report_cells(resolved: DataFrame) -> DataFrame:
    """Every cell that fell back or was deferred, with its reason."""
    kind = F.when(F.col("choice") == "previous", "fallback").when(F.col("choice") == "defer", "deferred")
    return resolved.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("kind", "app_id", "region", "reason")


def batch_status(batches: DataFrame) -> DataFrame:
    """Report word per batch; batches come from ``accept_batches``."""
    return batches.withColumn(
        "status",
        F.when(F.col("confirmed"), "confirmed-change")
        .when(F.col("failed"), "fallback")
        .when(F.col("mismatch"), "unconfirmed")
        .otherwise("verified-unchanged"),
    )


def stamp_verified(current: DataFrame, previous: DataFrame, unverified: DataFrame, run_time: Column, old_time: Column) -> DataFrame:
    """verified_at advances only for apps without fallback or deferral.

    current / previous: app_id, verified_at; unverified: app_id.
    """
    held = unverified.select("app_id").distinct().withColumn("__held", F.lit(True))
    old = previous.select("app_id", F.coalesce("verified_at", old_time).alias("__old"))
    return (
        current.join(held, "app_id", "left")
        .join(old, "app_id", "left")
        .withColumn(
            "verified_at",
            F.when(F.col("__held"), F.coalesce("__old", "verified_at", old_time)).otherwise(run_time),
        )
        .drop("__held", "__old")
    )


def retain_subset(snapshot: DataFrame, ids: DataFrame, snapshot_time: Column) -> DataFrame:
    """Keep the listed apps as they are; verified_at never advances."""
    return snapshot.join(ids.select("app_id").distinct(), "app_id", "left_semi").withColumn(
        "verified_at", F.coalesce("verified_at", snapshot_time)
    )


def batch_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


def accept_batches(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per batch: take the first pass, the confirmed second pass, or keep the previous.

    Both: batch, failed, changed, fingerprint (one row per batch).
    """
    one = first.select("batch", F.col("failed").alias("f1"), F.col("changed").alias("c1"), F.col("fingerprint").alias("p1"))
    two = second.select("batch", F.col("failed").alias("f2"), F.col("changed").alias("c2"), F.col("fingerprint").alias("p2"))
    needs_second = ~F.col("f1") & F.col("c1")
    agreed = (
        needs_second
        & ~F.coalesce("f2", F.lit(True))
        & F.coalesce("c2", F.lit(False))
        & (F.col("p1") != "none")
        & F.coalesce(F.col("p1") == F.col("p2"), F.lit(False))
    )
    failed = F.col("f1") | (needs_second & F.coalesce("f2", F.lit(True)))
    return (
        one.join(two, "batch", "left")
        .withColumn("confirmed", agreed)
        .withColumn("failed", failed)
        .withColumn("mismatch", needs_second & ~F.col("failed") & ~F.col("confirmed"))
        .withColumn(
            "take",
            F.when(F.col("confirmed"), "second").when(F.col("failed") | F.col("mismatch"), "previous").otherwise("first"),
        )
        .select("batch", "confirmed", "failed", "mismatch", "take")
    )


def stitch_batches(batches: DataFrame, first: DataFrame, second: DataFrame, previous: DataFrame) -> DataFrame:
    """Apps of the accepted pass of every batch (inputs carry ``batch``)."""
    parts = {"first": first, "second": second, "previous": previous}
    result = None
    for take, apps in parts.items():
        chosen = batches.filter(F.col("take") == take).select("batch")
        part = apps.join(chosen, "batch", "left_semi").withColumn("taken_from", F.lit(take))
        result = part if result is None else result.unionByName(part)
    return result


def retry_targets(cells: DataFrame, limit: int = RETRY_LIMIT) -> DataFrame:
    """Markets worth another try, in market order, a few per app."""
    order = Window.partitionBy("app_id").orderBy("ord", "region")
    return (
        cells.filter(needs_retry(F.col("status"), F.col("identity_status")))
        .withColumn("attempt", F.row_number().over(order).cast("bigint"))
        .filter(F.col("attempt") <= limit)
    )


def upsert_regions(base: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replace the market rows that have a replacement; keep the rest and the order."""
    fields = ["status", "identity_status", "item_count"]
    new = replacements.select(*CELL, F.struct(*fields).alias("r"))
    old = F.struct(*fields)
    return (
        base.join(new, [*CELL], "left")
        .withColumn("row", F.coalesce(F.col("r"), old))
        .select(*CELL, "ord", *[F.col(f"row.{c}").alias(c) for c in fields], F.col("r").isNotNull().alias("replaced"))
    )


def identity_summary(records: DataFrame, plans: DataFrame, shared: DataFrame) -> DataFrame:
    """Per record: plans, plans with product id, unresolved curated plans.

    records: app_id, source, us_status, us_identity_status, structured_regions,
    degraded_regions (``unresolved_ids`` has the ids, one row each); plans: app_id,
    plan_id, product_id, period, match_method; shared: curated plans with a
    name in common (``duplicate_alias_plans``).
    """
    flagged = plans.join(
        shared.select("app_id", "plan_id").withColumn("__shared", F.lit(True)), ["app_id", "plan_id"], "left"
    )
    open_plan = F.col("__shared") & _open_plan()
    counted = flagged.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("plan_count"),
        F.count("product_id").alias("structured_plans"),
        F.count(F.when(open_plan, 1)).alias("unresolved_plans"),
        F.count(F.when(F.col("match_method") == "us-anchor-only", 1)).alias("anchor_only_plans"),
    )
    counts = ["plan_count", "structured_plans", "unresolved_plans", "anchor_only_plans"]
    return records.join(counted, "app_id", "left").select(
        *records.columns, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts]
    )


def _open_plan() -> Column:
    return (
        F.col("product_id").isNull()
        | (F.col("period") == PUBLIC)
        | F.col("match_method").isin("us-anchor-only", "unmatched")
    )


def unresolved_ids(plans: DataFrame, shared: DataFrame) -> DataFrame:
    """app_id, plan_id of the curated plans that ``identity_summary`` counts as unresolved."""
    both = plans.join(shared.select("app_id", "plan_id"), ["app_id", "plan_id"], "left_semi")
    return both.filter(_open_plan()).select("app_id", "plan_id")


def is_incomplete(summary_prefix: str = "") -> Column:
    """A snapshot record with a plan that has no product id."""
    p = summary_prefix
    return (F.col(f"{p}source") == "snapshot") & (F.col(f"{p}structured_plans") < F.col(f"{p}plan_count"))


def is_usable(p: str = "") -> Column:
    return F.coalesce(~is_incomplete(p) & (F.col(f"{p}unresolved_plans") == 0), F.lit(False))


def select_record(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """Accept the candidate summary, retain the previous one, or reject both."""
    old = previous.select("app_id", *[F.col(c).alias(f"p_{c}") for c in previous.columns if c != "app_id"])
    new = candidate.select("app_id", *[F.col(c).alias(f"c_{c}") for c in candidate.columns if c != "app_id"])
    usable = is_usable("p_")
    unresolved = F.col("c_unresolved_plans") > 0
    regressed = usable & (F.col("p_structured_plans") > 0) & (F.col("c_structured_plans") == 0)
    worse = usable & (F.col("c_degraded_regions") > F.col("p_degraded_regions"))
    action = F.when(unresolved & ~usable, "reject").when(unresolved | regressed | worse, "retain").otherwise("accept")
    reason = (
        F.when(unresolved, "curated-identity-degraded")
        .when(regressed, "structured-identity-regressed")
        .when(worse, "regional-identity-degraded")
        .otherwise("identity-quality-accepted")
    )
    return new.join(old, "app_id", "left").select("app_id", action.alias("action"), reason.alias("reason"))


def classify_outcome(anchors: DataFrame) -> DataFrame:
    """Error word and HTTP status for apps whose comparison failed.

    anchors: app_id, status, item_count, error (us-anchor-unavailable,
    us-plans-unavailable or anything else).
    """
    comparable = F.col("error").isin("us-anchor-unavailable", "us-plans-unavailable")
    populated = F.col("status").startswith("ok-") & (F.col("item_count") > 0)
    outcome = (
        F.when(~comparable, "refresh-failed")
        .when(F.col("status") == "iap-section-missing", "web-iap-not-public")
        .when((F.col("status") == "error:HTTP 404") | populated, "no-comparable-plans")
        .otherwise("refresh-failed")
    )
    return anchors.withColumn("outcome", F.coalesce(outcome, F.lit("refresh-failed"))).withColumn(
        "http_status", F.when(F.col("outcome") == "refresh-failed", 503).otherwise(422).cast("bigint")
    )
