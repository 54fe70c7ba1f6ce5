"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Folders that each open scratch has to drop, the innermost last.
SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("fenland_scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/fenland-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are dropped at its end, but for those kept, which live as long as the scratch around it."""
    own: list[str] = []
    token = SCRATCH.set((*SCRATCH.get(), own))
    try:
        yield
    finally:
        SCRATCH.reset(token)
        for folder in own:
            dropped(spark, folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside drop their shuffle files when they end, as nothing reads them once a table is written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def broadcasts_measured(spark: SparkSession) -> Iterator[None]:
    """Sides of joins that run inside are broadcast by the bytes that their shuffle has counted, up to the session's threshold,
    or where the code says so; not by the size of files, as cells compress to a byte or less a row and take a hundred when
    they are broadcast, all of them in the driver."""
    planned, measured = spark.conf.get(PLANNED), spark.conf.get(MEASURED, None)
    spark.conf.set(MEASURED, measured or planned)
    spark.conf.set(PLANNED, "-1")
    try:
        yield
    finally:
        spark.conf.set(PLANNED, planned)
        if measured is None:
            spark.conf.unset(MEASURED)
        else:
            spark.conf.set(MEASURED, measured)


def written(df: DataFrame, name: str, kept: bool = False, measured: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder; kept: it outlives the scratch in which it is written; measured: its joins are
    as of broadcasts_measured."""
    path = new_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession), broadcasts_measured(df.sparkSession) if measured else nullcontext():
        df.write.parquet(path)
    if of := SCRATCH.get()[: -1 if kept else None]:
        of[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fl_folder = path
    return out


def replaced(df: DataFrame, name: str, old: DataFrame) -> DataFrame:
    """df as of written, in place of old, a table of written that nothing else reads; loops so leave one table behind."""
    out = written(df, name)
    dropped(df.sparkSession, old._fl_folder)
    return out
