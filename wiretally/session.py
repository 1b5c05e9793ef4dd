"""Session settings and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Whether the shuffle files of a query go when it ends, instead of when the driver next collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Open scopes of ``passing``, innermost last: the paths that are deleted when one ends.
_passing: list[list[str]] = []
#: Rows up to which a stored table goes to every task.
SENT_ROWS = 500_000


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "wiretally") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in
    ``spark.checkpoint.dir``. Only in local mode, where one machine does
    everything, a private one is created if that is unset; a cluster without it is
    an error, because executors would write where nobody else can read."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext.getCheckpointDir()
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not held and not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = held or tempfile.mkdtemp(prefix="wiretally-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and cuts the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is not computed again, so the shuffle files of each of these writes go when the write ends."""
    held = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, held)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``written`` stores inside are deleted at the end; what is made of them has to be stored by then.
    The value names the scope: a table that is written for it inside an inner one lives until this one ends."""
    paths: list[str] = []
    _passing.append(paths)
    try:
        yield paths
    finally:
        _passing.pop()
        for path in paths:
            held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def written(df: DataFrame, label: str, scope: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: what several branches read is evaluated once."""
    path = scratch_path(df.sparkSession, label)
    if scope is not None or _passing:
        (_passing[-1] if scope is None else scope).append(path)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distilled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``written`` of what ``make`` returns; the tables that it stores on the way go then."""
    outer = _passing[-1] if _passing else []
    with passing(spark):
        return written(make(), label, outer)


def sent(df: DataFrame) -> DataFrame:
    """A stored table of few rows goes to every task, whatever size the planner expects; the others stay its choice."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df
