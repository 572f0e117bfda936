"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


# Worth setting on every session. The JVM compiles no method beyond 8000 bytes; wide projections
# exceed that in one fused method, and below this limit Spark splits them (measured on 80 columns:
# 3.4 s against 9.5 s).
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# A setting of Spark: remove the shuffle files of a query when the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str = "*", app: str = "trailmill") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config(map=RECOMMENDED)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="trailmill-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of the session (``spark.checkpoint.dir``).

    Only a local master without that setting falls back to a temporary folder; on a cluster a
    machine-local folder would not be seen by the other machines, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/trailmill-{label}-{uuid.uuid4().hex}"


# Paths of the tables that this session has written and not yet removed.
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of recomputing it) and gives
    the planner true sizes. Its shuffle files go when it is complete: nobody reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def table_path(table: DataFrame) -> str:
    """Where a table of ``written`` is kept."""
    return _tables[table]


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing will read again; other DataFrames are left alone.

    Whatever was computed from them must be written already: a lazy result would miss them.
    """
    for table in tables:
        path = _tables.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
