"""Session helper and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "marketladder") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    A machine-local folder is made only for a local master that names none; on
    a cluster a missing setting is an error, since executors can be lost.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="marketladder-"))
    return spark.conf.get("spark.checkpoint.dir")


_SCOPE: ContextVar[str] = ContextVar("scope", default="")


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Tables that ``stored`` writes inside are removed at the end.

    Results must have been written or collected by then.  Without a scope the
    tables stay, since a lazy result may still read them.
    """
    folder = f"{checkpoint_folder(spark).rstrip('/')}/marketladder/run-{uuid.uuid4().hex}"
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write a result that is used several times, and read it back.

    Cuts the lineage, so the work above runs once and survives lost executors;
    the columnar copy keeps column pruning and tells Spark its real size.
    """
    spark = df.sparkSession
    folder = _SCOPE.get() or f"{checkpoint_folder(spark).rstrip('/')}/marketladder"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by a hash of columns to as many tasks as a shuffle has.

    For work that multiplies rows: a table in one small file is one task
    otherwise, and adaptive execution would join small shares again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed dimension as literal rows, so that Spark knows its size."""
    names = [field.split()[0] for field in schema.split(",")]
    kinds = [field.split()[1] for field in schema.split(",")]

    def literal(value: object, kind: str) -> str:
        if value is None:
            return f"CAST(NULL AS {kind})"
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{text}' AS {kind})"

    values = ", ".join("(" + ", ".join(literal(v, k) for v, k in zip(row, kinds)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
