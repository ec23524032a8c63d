"""Session, checkpoint and scratch-folder helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "aislerank", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for local tests and benches; a cluster passes its own session to the jobs."""
    cpus = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.appName(name)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("AISLERANK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors see; only a local session may fall back to /tmp."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a reused intermediate to the checkpoint folder and read it from there.

    It is evaluated once, and a lost executor costs a re-read rather than a re-run of its lineage.
    """
    shared_folder(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # whether shuffles go is settled when a frame is made


def stored(df: DataFrame) -> DataFrame:
    """``cut`` for wide rows (terms, vectors): compressed columns take a fraction of a checkpoint's disk.

    Column names must differ, and the partitioning is lost."""
    path = scratch_path(df.sparkSession, "stored")
    with _shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """``stored`` for as long as the block runs; whatever is made of it has to be written inside."""
    path = scratch_path(df.sparkSession, "passing")
    with _shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside needs its shuffle files no longer once it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever their working folder (once per application)."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        home = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="run-"), "aislerank"), "zip",
            root_dir=os.path.dirname(home), base_dir=os.path.basename(home))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
