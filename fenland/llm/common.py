"""Helpers that several operators share: shared folders, written tables, size-checked joins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fenland.functions import tables
from fenland.functions.tables import new_folder, scratch, shared_dir

__all__ = ["BROADCAST_ROWS", "arrow_rows", "host_of", "new_folder", "scratch", "shared_dir", "sized_join", "small", "table", "text_key", "within_bytes", "written"]

#: A side of a join is broadcast only when its measured rows do not exceed this.
BROADCAST_ROWS = 1_000_000
#: The same for the bytes of its values.
BROADCAST_BYTES = 64 << 20


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """As of tables; the large joins here are sized ones, the others are left to Spark."""
    return tables.written(df, name, kept, measured=False)


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """left join right; right is broadcast if it has at most limit rows (counted here unless given): fewer for wide rows.

    Beyond that Spark shuffles both sides. right should be a written table, as counting reads it.
    """
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= limit else right, on, how)


def small(right: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of the rows of right, a written table, take at most limit bytes."""
    each = F.sum(F.length(F.to_json(F.struct(*right.columns)))) if right.columns else F.lit(0)
    return (right.agg(each).first()[0] or 0) <= limit


def within_bytes(right: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """right, a written table, to be broadcast if the values of its rows take at most limit bytes; beyond, Spark shuffles it."""
    return F.broadcast(right) if small(right, limit) else right


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host_of(source: Column) -> Column:
    """Rows without a host share the host ''."""
    return F.coalesce(source.cast("string"), F.lit(""))


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text, as key1 and key2; a null text has those of an empty one."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(1), t).alias("key1"), F.xxhash64(F.lit(2), t).alias("key2")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that start inside; the session's own value comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
