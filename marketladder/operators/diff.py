"""Two snapshots as multisets: what changed, its fingerprint and its log.

A cell's changes stay rows (one per item); only counts are grouped per cell,
so a cell or an app of any size is never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketladder.functions.status import diff_state
from marketladder.operators.numbering import number_in_group, position_range
from marketladder.session import stored

CELL = ("app_id", "region")
ITEM = ("name", "price")


def bag_difference(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = (*CELL, *ITEM), pos_range: Column | None = None
) -> DataFrame:
    """Rows of ``left`` not cancelled by ``right``; earliest rows cancel first.

    The right side is counted before it is joined, and joined to the ranges of
    the left side, so equal rows in any number stay spread over tasks.
    """
    keys = list(keys)
    cancelled = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cancel"))
    bucket = position_range("pos") if pos_range is None else pos_range
    numbered = number_in_group(left, keys, ["pos"], bucket, "__n", per_key=cancelled)
    return numbered.filter(F.col("__n") >= F.coalesce("__cancel", F.lit(0))).drop("__n", "__cancel")


def pair_updates(
    removed: DataFrame, added: DataFrame, cell: Sequence[str] = CELL, pos_range: Column | None = None
) -> DataFrame:
    """Pair removed and added rows of one name in order.

    kind: updated (before and after price), removed or added; ``seq`` is the
    position that orders rows of a kind inside the cell.
    """
    columns = [*cell, "pos", *ITEM]
    sides = removed.select(*columns, F.lit("before").alias("side")).unionByName(
        added.select(*columns, F.lit("after").alias("side"))
    )
    return _pair(sides, cell, position_range("pos") if pos_range is None else pos_range)


def _pair(sides: DataFrame, cell: Sequence[str], bucket: Column) -> DataFrame:
    """Rows of both sides to pairs: the n-th of a name meets the n-th.

    At most two rows share (cell, name, number), so a hash aggregate over that
    key replaces a join of the two sides.
    """
    keys = [*cell, "name"]
    numbered = number_in_group(sides, [*keys, "side"], ["pos"], bucket, "n")

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    paired = numbered.groupBy(*keys, "n").agg(
        of("before", "price").alias("before_price"), of("after", "price").alias("after_price"),
        of("before", "pos").alias("before_pos"), of("after", "pos").alias("after_pos"),
    )
    kind = (
        F.when(F.col("after_price").isNull(), "removed")
        .when(F.col("before_price").isNull(), "added")
        .otherwise("updated")
    )
    return paired.select(
        *keys, kind.alias("kind"), "before_price", "after_price", F.coalesce("before_pos", "after_pos").alias("seq")
    )


def catalog_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Apps, and markets of common apps, that only one snapshot has.

    Both inputs are cell tables (app_id, region).  Kept out of the change list.
    """
    old = before.select(*CELL).distinct().withColumn("__old", F.lit(True))
    new = after.select(*CELL).distinct().withColumn("__new", F.lit(True))
    cells = old.join(new, [*CELL], "full")
    sides = cells.groupBy("app_id").agg(
        F.max("__old").alias("__app_old"), F.max("__new").alias("__app_new")
    )
    apps = sides.select(
        F.when(F.col("__app_new").isNull(), "app-removed").when(F.col("__app_old").isNull(), "app-added").alias("type"),
        "app_id",
        F.lit(None).cast("string").alias("region"),
    ).filter(F.col("type").isNotNull())
    both = sides.filter(F.col("__app_old") & F.col("__app_new")).select("app_id")
    regions = (
        cells.join(both, "app_id", "left_semi")
        .select(
            F.when(F.col("__new").isNull(), "region-removed").when(F.col("__old").isNull(), "region-added").alias("type"),
            *CELL,
        )
        .filter(F.col("type").isNotNull())
    )
    return apps.unionByName(regions)


def name_apps(changes: DataFrame, before_apps: DataFrame, after_apps: DataFrame) -> DataFrame:
    """Add app_name: the newer name; of an app that came or went the older name, the newer one, or the id.

    Both app tables: app_id, matched_name.
    """
    old = before_apps.select("app_id", F.col("matched_name").alias("__old"))
    new = after_apps.select("app_id", F.col("matched_name").alias("__new"))
    named = changes.join(old, "app_id", "left").join(new, "app_id", "left")
    whole_app = F.col("type").isin("app-removed", "app-added")
    name = F.when(whole_app, F.coalesce("__old", "__new", "app_id")).otherwise(F.col("__new"))
    return named.withColumn("app_name", name).drop("__old", "__new")


def common_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells in both snapshots with counts, statuses and evidence states."""
    old = before.select(
        *CELL, F.col("status").alias("before_status"), F.col("item_count").alias("before_count")
    )
    new = after.select(
        *CELL, F.col("status").alias("after_status"), F.col("item_count").alias("after_count")
    )
    return (
        old.join(new, [*CELL])
        .withColumn("before_state", diff_state(F.col("before_status"), F.col("before_count")))
        .withColumn("after_state", diff_state(F.col("after_status"), F.col("after_count")))
    )


def item_changes(
    before_cells: DataFrame,
    after_cells: DataFrame,
    before_items: DataFrame,
    after_items: DataFrame,
    pos_range: Column | None = None,
) -> DataFrame:
    """Item rows updated, removed or added in cells verified on both sides."""
    verified = (
        common_cells(before_cells, after_cells)
        .filter((F.col("before_state") == "verified") & (F.col("after_state") == "verified"))
        .select(*CELL)
    )
    columns = [*CELL, "pos", *ITEM]
    sides = (
        before_items.select(*columns, F.lit("before").alias("side"))
        .unionByName(after_items.select(*columns, F.lit("after").alias("side")))
        .join(verified, [*CELL], "left_semi")
    )
    bucket = position_range("pos") if pos_range is None else pos_range
    return _pair(stored(_uneven(sides.withColumn("__range", bucket))), CELL, bucket)


def _uneven(sides: DataFrame) -> DataFrame:
    """Rows of the larger side that the smaller side does not cancel.

    Between two snapshots most prices agree, so equal prices are counted first,
    per range of positions; only prices with unequal totals are joined back, by
    range, and a price that fills a third of the table stays spread out.
    """
    keys = [*CELL, *ITEM]
    old, new = F.col("side") == "before", F.col("side") == "after"
    counts = sides.groupBy(*keys, "__range").agg(
        F.count(F.when(old, 1)).alias("b"), F.count(F.when(new, 1)).alias("a")
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.select(
        *keys, "__range", F.sum("b").over(whole).alias("all_b"), F.sum("a").over(whole).alias("all_a"),
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("early_b"),
        F.coalesce(F.sum("a").over(earlier), F.lit(0)).alias("early_a"),
    ).filter(F.col("all_b") != F.col("all_a"))
    more_old = F.col("all_b") > F.col("all_a")
    place = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("pos"))
    return (
        sides.join(totals, [*keys, "__range"])
        .filter((old & more_old) | (new & ~more_old))
        .withColumn("__n", place + F.when(more_old, F.col("early_b")).otherwise(F.col("early_a")))
        .filter(F.col("__n") > F.least("all_b", "all_a"))
        .select(*CELL, "pos", *ITEM, "side")
    )


def snapshot_diff(before_cells: DataFrame, after_cells: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per changed cell: counts, states, statuses and change counts.

    ``changes`` comes from ``item_changes`` and holds the updated, removed and
    added rows themselves.
    """
    counted = changes.groupBy(*CELL).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("updated", "removed", "added")]
    )
    joined = common_cells(before_cells, after_cells).join(counted, [*CELL], "left")
    zero = [F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in ("updated", "removed", "added")]
    return joined.filter(F.col("updated").isNotNull() | (F.col("before_state") != F.col("after_state"))).select(
        F.lit("region-items-changed").alias("type"), *CELL, "before_count", "after_count",
        "before_state", "after_state", "before_status", "after_status", *zero,
    )


def _row_digest(*parts: Column) -> Column:
    text = [F.coalesce(part.cast("string"), F.lit("\u0001")) for part in parts]
    return F.sha2(F.concat_ws("\u0000", *text), 256)


def _digest_words(digest: Column) -> list[Column]:
    """Four 60-bit words of a SHA-256 hex text."""
    words = []
    for i in range(4):
        words.append(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return words


def diff_fingerprint(
    cells: DataFrame, changes: DataFrame, by: Sequence[str] = (), pos_range: Column | None = None
) -> DataFrame:
    """20 hex digits that agree exactly when two change lists agree.

    Every cell row and item row is hashed with its place in the list, the
    hashes are summed (so tasks combine them in any order) and the sums are
    hashed once more.  The place is the number among the changes of one kind
    in a cell, so unchanged neighbours do not matter.  ``by`` gives one
    fingerprint per batch; ``pos_range`` is the range of the column ``seq``.
    """
    by = list(by)
    bucket = position_range("seq") if pos_range is None else pos_range
    changes = number_in_group(changes, [*by, *CELL, "kind"], ["seq"], bucket, "place")
    cell_rows = cells.select(
        *by,
        _row_digest(
            F.col("type"), *[F.col(c) for c in CELL], F.col("before_count"), F.col("after_count"),
            F.col("before_status"), F.col("after_status"),
        ).alias("digest"),
        F.lit(1).alias("cell"),
    )
    item_rows = changes.select(
        *by,
        _row_digest(
            F.col("kind"), *[F.col(c) for c in CELL], F.col("name"), F.col("before_price"), F.col("after_price"),
            F.col("place"),
        ).alias("digest"),
        F.lit(0).alias("cell"),
    )
    words = _digest_words(F.col("digest"))
    rows = cell_rows.unionByName(item_rows).select(*by, "cell", *[w.alias(f"w{i}") for i, w in enumerate(words)])
    sums = rows.groupBy(*by).agg(
        F.coalesce(F.sum("cell"), F.lit(0)).cast("bigint").alias("change_count"),
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)],
    )
    combined = F.concat_ws(
        "|", F.col("__rows").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(4)]
    )
    return sums.select(
        *by,
        "change_count",
        (F.col("change_count") > 0).alias("changed"),
        F.when(F.col("change_count") > 0, F.substring(F.sha2(combined, 256), 1, 20)).otherwise("none").alias("fingerprint"),
    )


def confirm_change(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confirmed when both passes changed and show the same fingerprint."""
    by = list(by)
    one = first.select(*by, F.col("changed").alias("c1"), F.col("fingerprint").alias("f1"))
    two = second.select(*by, F.col("changed").alias("c2"), F.col("fingerprint").alias("f2"))
    agreed = F.col("c1") & F.col("c2") & (F.col("f1") != "none") & (F.col("f1") == F.col("f2"))
    return one.join(two, by, "full").select(
        *by, F.coalesce(agreed, F.lit(False)).alias("confirmed"), F.coalesce("f2", F.lit("none")).alias("fingerprint")
    )


def well_formed_changes(changes: DataFrame) -> DataFrame:
    """Public columns of log changes; rows without their texts or the app's name are dropped."""
    item = F.col("kind").isNotNull()
    complete = (
        F.when(~item, F.lit(True))
        .when(F.col("kind") == "updated", F.col("before_price").isNotNull() & F.col("after_price").isNotNull())
        .when(F.col("kind") == "removed", F.col("before_price").isNotNull())
        .otherwise(F.col("after_price").isNotNull())
    )
    named = F.col("entry_id").isNotNull() & F.col("type").isNotNull() & F.col("app_id").isNotNull() & F.col("app_name").isNotNull()
    known = ~item | F.col("name").isNotNull()
    return changes.filter(named & known & complete).select(
        "entry_id", "type", "app_id", "app_name", "region", "before_state", "after_state", "kind", "name",
        "before_price", "after_price",
    )


def latest_n(entries: DataFrame, n: int = 30) -> DataFrame:
    """Newest entries that have changes; a bounded top-k."""
    return (
        entries.filter(F.col("change_count") > 0)
        .orderBy(F.col("published_at").desc(), F.col("entry_id").desc())
        .limit(n)
    )


def append_change_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """The whole log with the entries it does not have yet; ``latest_n`` is the reading view.

    Both: entry_id, published_at, change_count.  Running it twice changes
    nothing, because an id already in the log is not added again.
    """
    fields = ["entry_id", "published_at", "change_count"]
    valid = F.col("entry_id").isNotNull() & F.col("published_at").isNotNull() & (F.col("entry_id") != "none")
    kept = log.select(*fields).filter(valid & (F.col("change_count") > 0))
    fresh = new.select(*fields).filter(valid & (F.col("change_count") > 0))
    return kept.unionByName(fresh.join(kept.select("entry_id"), "entry_id", "left_anti"))


def append_log_changes(log: DataFrame, log_changes: DataFrame, new_changes: DataFrame) -> DataFrame:
    """Change rows of all entries: those of ``log`` as they are, and those of entries it does not have.

    ``new_changes``: rows of ``entry_changes``.
    """
    fresh = new_changes.join(log.select("entry_id"), "entry_id", "left_anti")
    return well_formed_changes(log_changes).unionByName(well_formed_changes(fresh))


def entry_changes(entry_id: Column, cells: DataFrame, changes: DataFrame) -> DataFrame:
    """A run's changes as log rows: one per changed cell, and one per changed item (``kind`` is set).

    ``cells`` has app names (``name_apps``).
    """
    states = ["type", *CELL, "app_name", "before_state", "after_state"]
    texts = ["kind", "name", "before_price", "after_price"]
    own = cells.select(*states, *[F.lit(None).cast("string").alias(c) for c in texts])
    rows = changes.select(*CELL, *texts).join(cells.select(*states), [*CELL]).select(*states, *texts)
    return own.unionByName(rows).withColumn("entry_id", entry_id)


def flag_known_apps(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mark log rows whose app is still in the catalog."""
    known = catalog.select("app_id").distinct().withColumn("__known", F.lit(True))
    return changes.join(known, "app_id", "left").withColumn(
        "known", F.coalesce("__known", F.lit(False))
    ).drop("__known")


def detail_lines(changes: DataFrame) -> DataFrame:
    """Long summary: one text line per item change."""
    text = (
        F.when(
            F.col("kind") == "updated",
            F.concat(F.lit("「"), "name", F.lit("」"), "before_price", F.lit(" → "), "after_price"),
        )
        .when(F.col("kind") == "removed", F.concat(F.lit("移除「"), "name", F.lit(" · "), "before_price", F.lit("」")))
        .otherwise(F.concat(F.lit("新增「"), "name", F.lit(" · "), "after_price", F.lit("」")))
    )
    return changes.select(*CELL, "kind", "seq", text.alias("line"))


def cell_lines(cells: DataFrame) -> DataFrame:
    """Long summary: the count and state part of a changed cell."""
    counts = F.when(
        F.col("before_count") != F.col("after_count"),
        F.concat(F.lit("套餐 "), F.col("before_count").cast("string"), F.lit(" → "), F.col("after_count").cast("string")),
    )
    states = F.when(
        F.col("before_state") != F.col("after_state"),
        F.concat(F.lit("状态 "), "before_state", F.lit(" → "), "after_state"),
    )
    return cells.select(*CELL, F.concat_ws("；", counts, states).alias("line"))


def short_lines(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Short text per changed cell: 2 updates, 1 addition, 1 removal, the rest counted."""
    # How many details of each kind the short text shows.
    shown = {"updated": 2, "added": 1, "removed": 1}
    order = Window.partitionBy(*CELL, "kind").orderBy("seq", "name")
    top = changes.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= 2)
    text = (
        F.when(F.col("kind") == "updated", F.concat("name", F.lit(" "), "before_price", F.lit("→"), "after_price"))
        .when(F.col("kind") == "added", F.concat(F.lit("新增 "), "name", F.lit(" "), "after_price"))
        .otherwise(F.concat(F.lit("移除 "), "name", F.lit(" "), "before_price"))
    )
    columns = [
        F.max(F.when((F.col("kind") == kind) & (F.col("__n") == n), text)).alias(f"{kind}{n}")
        for kind, most in shown.items()
        for n in range(1, most + 1)
    ]
    details = top.groupBy(*CELL).agg(*columns)

    def more(kind: str, prefix: str, suffix: str) -> Column:
        left = F.col(kind) - shown[kind]
        return F.when(left > 0, F.concat(F.lit(prefix), left.cast("string"), F.lit(suffix)))

    state = F.when(
        F.col("before_state") != F.col("after_state"),
        F.concat(F.lit("状态 "), "before_state", F.lit("→"), "after_state"),
    )
    return cells.join(details, [*CELL], "left").select(
        *CELL,
        F.concat_ws(
            "，", state, "updated1", "updated2", more("updated", "另有 ", " 个套餐调价"),
            "added1", more("added", "另新增 ", " 项"), "removed1", more("removed", "另移除 ", " 项"),
        ).alias("line"),
    )


def notification_lines(cells: DataFrame, changes: DataFrame, k: int = 8) -> DataFrame:
    """The first k short texts, a bounded report, and how many more there are."""
    more = cells.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0).cast("bigint"))).scalar()
    return short_lines(cells, changes).orderBy(*CELL).limit(k).withColumn("more", more)


def notification(cells: DataFrame, changes: DataFrame, k: int = 8) -> DataFrame:
    """place, line: the message about a change; ``cells`` has app names.

    Header with the count, the first k cells by id and region, how many more
    there are, and the footer.
    """
    # Texts of the message.
    found, cells_text = "发现 ", " 个应用/地区发生变化："
    rest, places = "另有 ", " 处变化"
    unclear, footer = "内容变化", "系统会短时复查；两次结果一致后自动发布。"
    number = cells.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("string")
    first = cells.select(*CELL, "app_name").orderBy(*CELL).limit(k)
    shown = cells.join(first.select(*CELL), [*CELL], "left_semi")
    texts = short_lines(shown, changes.join(first.select(*CELL), [*CELL], "left_semi"))
    place = F.row_number().over(Window.orderBy(*CELL)).cast("bigint")  # at most k rows
    line = F.concat(
        "app_name", F.lit(" / "), F.upper("region"), F.lit("："), F.when(F.col("line") != "", F.col("line")).otherwise(unclear)
    )
    body = first.join(texts, [*CELL]).select(place.alias("place"), line.alias("line"))
    zero = F.lit(0).cast("bigint").alias("place")
    head = number.select(zero, F.concat(F.lit(found), n, F.lit(cells_text)).alias("line"))
    tail = number.filter(F.col("n") > k).select(
        F.lit(k + 1).cast("bigint").alias("place"), F.concat(F.lit(rest), (F.col("n") - k).cast("string"), F.lit(places)).alias("line")
    )
    foot = number.select(F.lit(k + 2).cast("bigint").alias("place"), F.lit(footer).alias("line"))
    return head.unionByName(body).unionByName(tail).unionByName(foot)


def published_line(change_count: Column) -> Column:
    """The message after publishing, or after a check without any change."""
    # Texts of the message.
    done = F.concat(F.lit("已确认并上线 "), change_count.cast("string"), F.lit(" 个应用/地区的订阅变化。"))
    return F.when(change_count > 0, done).otherwise("本次检查未发现订阅变动，网站数据无需更新。")
