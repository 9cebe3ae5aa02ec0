"""Publishing: the gate, the version pointer, the marker, comparison files."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def publish_marker(snapshot_time: Column, rates_time: Column) -> Column:
    """Id of a published state: 20 hex digits of both times."""
    identity = F.to_json(F.struct(snapshot_time.alias("snapshotGeneratedAt"), rates_time.alias("ratesUpdatedAt")))
    return F.substring(F.sha2(identity, 256), 1, 20)


def publish(
    root: str, run: str, version: int, tables: dict[str, DataFrame], violations: DataFrame
) -> bool:
    """Write all tables of a run, then commit it as a version, unless a rule is broken.

    Readers follow the highest version, whose file is made last.  Whatever
    fails before leaves the published state untouched, so nothing has to be
    restored.  Of several writers of one version exactly one is published.
    """
    spark = violations.sparkSession
    if violations.limit(1).count():
        return False
    _write(root, run, tables)
    return commit(spark, root, version, run)


def publish_next(
    spark: SparkSession, root: str, run: str, tables: dict[str, DataFrame],
    validate: Callable[[str | None], DataFrame], tries: int = 3,
) -> int | None:
    """Publish as the version after the present one; its number, or none.

    ``validate`` gets the run that is published (none at first) and gives the
    violations against it.  A writer that comes second validates again, against
    what the first has published.
    """
    written = False
    for _ in range(tries):
        version, present = head(spark, root)
        if validate(present).limit(1).count():
            return None
        if not written:
            _write(root, run, tables)
            written = True
        if commit(spark, root, version + 1, run):
            return version + 1
    return None


def _write(root: str, run: str, tables: dict[str, DataFrame]) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/runs/{run}/{name}")


def _versions(spark: SparkSession, root: str) -> tuple:
    """The folder of version files and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, root: str, version: int, run: str) -> bool:
    """Make the file of a version, which names its run, only if it is absent and not behind.

    The file system decides between writers.  A file without content, left by a
    lost writer, counts for nothing but its number.
    """
    folder, system = _versions(spark, root)
    system.mkdirs(folder)
    if version <= head(spark, root)[0]:
        return False
    file = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{version:020d}")
    try:
        out = system.create(file, False)
    except Py4JJavaError:
        if system.exists(file):  # another writer was first
            return False
        raise
    try:
        out.write(run.encode())
    finally:
        out.close()
    return True


def head(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The highest version number that is taken, and the run of the highest one with content."""
    folder, system = _versions(spark, root)
    if not system.exists(folder):
        return 0, None
    taken = max([int(status.getPath().getName()) for status in system.listStatus(folder)], default=0)
    names = spark.read.text(f"{root}/versions").select(F.col("_metadata.file_name").alias("version"), "value")
    return taken, names.agg(F.max_by("value", "version")).first()[0]


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the run that is published now."""
    run = head(spark, root)[1]
    if run is None:
        raise LookupError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/runs/{run}/{name}")


def write_comparison(headers: DataFrame, plans: DataFrame, issues: DataFrame, path: str) -> None:
    """Comparison documents as JSON lines by app: header, plan and issue lines.

    A plan line nests its prices (one per market).  Rows are rebalanced by app,
    which splits an app that is too large for one file.
    """

    def lines(kind: str, rows: DataFrame) -> DataFrame:
        return rows.select("app_id", F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("document"))

    documents = lines("header", headers).unionByName(lines("plan", plans)).unionByName(lines("issue", issues))
    documents.hint("rebalance", "app_id").write.mode("overwrite").partitionBy("app_id").json(path)


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, document string, app_id string").json(path)
