"""Session helpers: building a local session and cutting long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, app: str = "arborstat") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and every executor can reach")
    return _local_folder(context.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    given = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, given)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table under the checkpoint folder and read it back.

    Used between rounds of iterative queries. Unlike an executor-side copy the
    table outlives lost executors, and its file sizes give the planner real
    statistics for the next round's joins. :func:`release` removes it again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/arborstat-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`cut_lineage` that no later plan reads."""
    for df in tables:
        path = df.__dict__.pop("_cut_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A table of more rows than this is not to be broadcast: it would take some 100 bytes a row of the driver's memory.
BROADCAST_ROWS = 100_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for joins that shuffle both sides; with ``rows``, its number of rows at most, only if these are many.

    Without it the planner weighs a table by its files, where a sorted or repeated key
    takes a bit: a few MB of them would be broadcast as more than a GB.
    """
    return df if rows is not None and rows <= BROADCAST_ROWS else df.hint("merge")


def cut_and_count(df: DataFrame, cond: Column) -> tuple[DataFrame, int]:
    """:func:`cut_lineage`, with the number of rows where ``cond`` holds, counted while writing."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count(F.when(cond, F.lit(1))).alias("n")))
    return out, seen.get["n"]
