"""Session settings and the shared scratch area."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the run-time work: it coalesces small shuffle
# partitions, splits skewed ones and turns a sort-merge join into a broadcast
# join only after it has measured the side.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("matchloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    It is the one named in ``spark.checkpoint.dir``. A temporary folder of this
    machine stands in for it only when Spark runs on this machine alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="matchloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


# The folder of the job that is running, if it has one.
_SCOPE: ContextVar[str | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, or below that of the ``scratch`` scope it is asked for in; no path is
    handed out twice."""
    return f"{_SCOPE.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file of whatever store the path names; whether it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, label: str = "job") -> Iterator[str]:
    """The scratch area of one job. What is materialised inside lies in one folder, which is deleted at the end, after an
    error too. A job's results must be written by then: frames that read the area are of no use afterwards. A scope inside
    another one has a folder within it."""
    path = scratch_path(spark, label)
    token = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(token)
        delete_path(spark, path)


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that outlives a lost executor, and it gives
    the planner true sizes for what follows. ``codec`` compresses otherwise than the session does.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *steps: Callable[[], Any]) -> list[Any]:
    """What the steps return, which do not depend on each other: their jobs run side by side, so that small ones do not wait
    for the driver. The scratch scope and the local properties are those of the caller."""
    shared_dir(spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        begun = [pool.submit(copy_context().run, inheritable_thread_target(spark)(step)) for step in steps]
    return [step.result() for step in begun]
