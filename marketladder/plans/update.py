"""One update from a candidate snapshot to the published state.

carry forward -> drop deferred apps -> stamp -> validate -> difference -> log
-> publish, all on tables.  Tables: cells (app_id, region, ord, status,
identity_status, item_count), items (app_id, region, pos, name, price and
identity columns), apps (app_id, ord, metadata, verified_at), log (entry_id,
published_at, change_count), log_changes
(rows of ``diff.entry_changes``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from marketladder.operators import carry, diff, quality
from marketladder.operators.numbering import position_range
from marketladder.plans.publish import publish
from marketladder.session import stored

CELL = ["app_id", "region"]


@dataclass
class Update:
    """Tables of one run; ``published`` tells whether readers see them."""

    tables: dict[str, DataFrame]
    violations: DataFrame
    published: bool


def _counted(cells: DataFrame, items: DataFrame) -> DataFrame:
    """Declared and real item counts per cell."""
    real = items.groupBy(*CELL).agg(F.count(F.lit(1)).alias("__real"))
    return cells.join(real, CELL, "left").select(
        *CELL, "status", "identity_status", F.col("item_count").alias("declared"),
        F.coalesce("__real", F.lit(0).cast("bigint")).alias("actual"),
    )


def update(
    candidate: dict[str, DataFrame],
    previous: dict[str, DataFrame],
    config: dict[str, DataFrame],
    rates: DataFrame,
    root: str,
    run: str,
    version: int,
    run_time: str,
    previous_time: str,
    pos_width: int = 65_536,
) -> Update:
    """Publish the candidate unless a rule is broken; ``pos_width`` positions of a cell are one range.

    candidate: cells, items, apps, header, regions; previous: cells, items,
    apps, log, log_changes; config: apps, regions.
    """
    resolved = stored(
        carry.resolve_fallback(
            _counted(candidate["cells"], candidate["items"]), _counted(previous["cells"], previous["items"])
        )
    )
    kept = carry.drop_deferred(resolved)
    deferred = resolved.filter("choice = 'defer'").select("app_id").distinct()

    def chosen(source: str, rows: DataFrame) -> DataFrame:
        return rows.join(kept.filter(F.col("choice") == source).select(*CELL), CELL, "left_semi")

    items = stored(chosen("candidate", candidate["items"]).unionByName(chosen("previous", previous["items"])))
    both = chosen("candidate", candidate["cells"]).unionByName(chosen("previous", previous["cells"]))
    cells = stored(both)
    apps = carry.stamp_verified(
        candidate["apps"].join(deferred, "app_id", "left_anti"), previous["apps"],
        resolved.filter("choice <> 'candidate'"), F.lit(run_time), F.lit(previous_time),
    )
    counts = _counted(cells, items).join(cells.select(*CELL, F.col("ord").alias("place")), CELL).drop("identity_status")
    violations = quality.validate_snapshot(
        {
            "header": candidate["header"], "apps": apps, "regions": candidate["regions"], "cells": counts,
            "items": items.join(cells.select(*CELL, "status"), CELL), "deferred": deferred,
        },
        config,
        {
            "apps": previous["apps"],
            "cells": previous["cells"].select("app_id", F.col("item_count").alias("declared")),
        },
    )
    changes = stored(diff.item_changes(previous["cells"], cells, previous["items"], items, position_range("pos", pos_width)))
    named = diff.name_apps(diff.snapshot_diff(previous["cells"], cells, changes), previous["apps"], apps)
    changed = stored(named)
    prints = stored(diff.diff_fingerprint(changed, changes, pos_range=position_range("seq", pos_width)))
    entry = prints.select(
        F.col("fingerprint").alias("entry_id"), F.lit(run_time).alias("published_at"), "change_count"
    )
    tables = {
        "cells": cells, "items": items, "apps": apps, "rates": rates, "changed_cells": changed, "changes": changes,
        "log": diff.append_change_log(previous["log"], entry),
        "log_changes": diff.append_log_changes(
            previous["log"], previous["log_changes"],
            diff.entry_changes(prints.select("fingerprint").scalar(), changed, changes).filter("entry_id <> 'none'"),
        ),
        "report": carry.run_report(resolved), "report_cells": carry.report_cells(resolved),
    }
    return Update(tables, violations, publish(root, run, version, tables, violations))
