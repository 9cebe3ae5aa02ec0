"""What a region row tells: evidence state, flags, outcome of a fetch."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Statuses.
NOT_FOUND = "error:HTTP 404"
SAFE_EMPTY = ["iap-section-missing", "official-price-page-missing", NOT_FOUND]
UNPUBLISHED = ["official-price-unpublished", "official-price-page-missing", "iap-section-missing"]
UNAVAILABLE = ["service-unavailable", NOT_FOUND]
BROKEN_MARKERS = ["marker-missing", "marker-unclosed"]


def _ok(status: Column) -> Column:
    return F.coalesce(status.startswith("ok-"), F.lit(False))


def _error(status: Column) -> Column:
    return F.coalesce(status.startswith("error:"), F.lit(False))


def _state(status: Column, count: Column, names: tuple[str, str, str, str]) -> Column:
    verified, unavailable, unpublished, failed = names
    return (
        F.when(_ok(status) & (count > 0), verified)
        .when(status.isin(UNAVAILABLE), unavailable)
        .when(status.isin(UNPUBLISHED) | (_ok(status) & (count == 0)), unpublished)
        .otherwise(failed)
    )


def diff_state(status: Column, count: Column) -> Column:
    """Evidence state in the words of the change log."""
    return _state(
        status, count, ("verified", "service-unavailable", "official-price-unpublished", "parse-failed")
    )


def evidence_state(status: Column, count: Column) -> Column:
    """Evidence state in the words of the display."""
    return _state(status, count, ("verified", "unavailable", "not-public", "review"))


def is_publishable(status: Column, declared: Column, actual: Column) -> Column:
    """Declared and real item counts agree and fit the status."""
    fits = F.when(status.isin(SAFE_EMPTY), actual == 0).otherwise(_ok(status) & (actual > 0))
    return F.coalesce((declared == actual) & fits, F.lit(False))


def is_public(status: Column, actual: Column) -> Column:
    return ~_error(status) & (F.coalesce(actual, F.lit(0)) > 0)


def is_transient_error(status: Column) -> Column:
    return F.coalesce((_error(status) & (status != NOT_FOUND)) | status.isin(BROKEN_MARKERS), F.lit(False))


def is_identity_degraded(status: Column, identity_status: Column) -> Column:
    named = F.coalesce(identity_status != "", F.lit(False))
    return (F.coalesce(status, F.lit("")) != "ok-structured") & named


def needs_retry(status: Column, identity_status: Column) -> Column:
    return is_transient_error(status) | is_identity_degraded(status, identity_status)


def is_reusable(status: Column, declared: Column) -> Column:
    """May a verified cell be carried into an incremental run?"""
    return F.coalesce(status.isin(SAFE_EMPTY) | (_ok(status) & (declared > 0)), F.lit(False))


def is_degraded_region(status: Column) -> Column:
    return _error(status) & (status != NOT_FOUND)


# Fewest plans a complete official service page shows.
MINIMUM_PLANS = {"icloud-plus": 5, "apple-one": 2, "apple-fitness-plus": 2}


def _path(url: Column) -> Column:
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(path == "", "/").otherwise(path)


def is_redirect_shell(html: Column) -> Column:
    """A page that only redirects, whatever its address says."""
    return html.rlike(r"(?iu)<title[^>]*>(?U:\s)*Apple(?U:\s)*-(?U:\s)*Redirect(?U:\s)*</title>") | html.rlike(
        r"""(?iu)['"]s-channel['"](?U:\s)*:(?U:\s)*['"]redirects['"]"""
    )


def store_page_status(
    http_status: Column, final_url: Column, app_id: Column, extracted: Column, error: Column
) -> Column:
    """Store page: transport error, 404 or foreign address, else what was extracted."""
    return (
        F.when(error.isNotNull(), F.concat(F.lit("error:"), error))
        .when(http_status == 404, NOT_FOUND)
        .when(~F.contains(_path(final_url), F.concat(F.lit("id"), app_id)), NOT_FOUND)
        .otherwise(extracted)
    )


def service_page_status(
    service: Column,
    http_status: Column,
    requested_url: Column,
    final_url: Column,
    html: Column,
    plans: Column,
    error: Column,
) -> Column:
    """Official service page: missing, redirected, too few plans, or ok."""
    needed = F.lit(1)
    for name, least in MINIMUM_PLANS.items():
        needed = F.when(service == name, F.lit(least)).otherwise(needed)
    needed = F.when(service == "apple-music", F.lit(2)).otherwise(needed)
    return (
        F.when(error.isNotNull(), F.concat(F.lit("error:"), error))
        .when(
            (http_status == 404) | (_path(requested_url) != _path(final_url)) | is_redirect_shell(html),
            "official-price-page-missing",
        )
        .when(plans >= needed, F.concat(F.lit("ok-"), service, F.lit("-page")))
        .otherwise(F.concat(F.lit("error:"), service, F.lit("-plans-missing")))
    )
