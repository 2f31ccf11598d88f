"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_FOLDERS: dict[str, str] = {}
SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sluice")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session may fall back to /tmp."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in LOCAL_FOLDERS:
        LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="sluice-")
    return LOCAL_FOLDERS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage to recompute, survives lost executors and carries file sizes,
    so the planner can choose a join by real size.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{SCRATCH.get()}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most ``rows`` rows at once in what is executed inside the block, fewer if the session says so."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside the block go when it has ended, not when the driver's memory is next collected."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def together(*actions: Callable[[], Any]) -> list[Any]:
    """Submit independent Spark actions at the same time; short jobs then share the executors."""
    with ThreadPoolExecutor(max_workers=len(actions)) as pool:
        return [future.result() for future in [pool.submit(copy_context().run, action) for action in actions]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables ``written`` inside the block share a folder that is deleted at its end, also after an error.

    What should outlive the block has to be saved elsewhere inside it.
    """
    name = f"scratch-{uuid.uuid4().hex}/"
    token = SCRATCH.set(name)
    folder = f"{work_folder(spark)}/{name}"
    try:
        yield folder
    finally:
        SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
