"""Text files as a data source of byte ranges, whose tasks number their own lines; ASCII grids read through it."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .grids import HEADER

#: Bytes of a range, and of the lines that a task hands on at once.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
KIND = "file string, range int, own long, value string"


@dataclass
class ByteRange(InputPartition):
    file: str
    number: int
    start: int
    end: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[fs.FileInfo]:
    """The files below a path or URI in any of its folders, hidden ones left out; or the one file that it names."""
    system, root = located(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda f: any(p.startswith(("_", ".")) for p in PurePosixPath(f.path[len(root) :]).parts)
    return sorted((f for f in found if f.is_file and not hidden(f)), key=lambda f: f.path)


def lines_of(f, start: int, end: int | None) -> Iterator[bytes]:
    """The lines that begin in [start, end); the one that a range cuts belongs to the range in which it begins."""
    data = io.BufferedReader(f, 1 << 20)
    if start:
        data.seek(start - 1)
        start += len(data.readline()) - 1
    while end is None or start < end:
        line = data.readline()
        if not line:
            return
        start += len(line)
        yield line.rstrip(b"\r\n")


class RangeReader(DataSourceReader):
    """What the option `rows` asks for: `lines`, `counts` (a row for each range, own has its number of lines) or `head`
    (the first lines of each file, `head` of them; only their bytes are read)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], options.get("rows", "lines")
        self.bytes, self.head = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("head", len(HEADER)))
        if self.rows not in ("lines", "counts", "head") or self.bytes < 1:
            raise ValueError("rows is lines, counts or head, and rangeBytes at least 1")

    def partitions(self) -> list[ByteRange]:
        spans = lambda size: [0] if self.rows == "head" else range(0, size, self.bytes)
        return [ByteRange(f.path, i, a, min(a + self.bytes, f.size)) for f in files_of(self.path) for i, a in enumerate(spans(f.size))]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ByteRange):  # no file
            return
        with located(self.path)[0].open_input_file(partition.file) as f:
            lines = lines_of(f, partition.start, None if self.rows == "head" else partition.end)
            if self.rows == "counts":
                yield self.batch(partition, [sum(1 for _ in lines)], [None])
                return
            own, held, size = 0, [], 0
            for line in lines:
                if self.rows == "head" and own + len(held) >= self.head:
                    break
                held.append(line.decode("utf-8", "replace"))
                size += len(line)
                if size >= BATCH_BYTES:
                    yield self.batch(partition, range(own, own + len(held)), held)
                    own, held, size = own + len(held), [], 0
            yield self.batch(partition, range(own, own + len(held)), held)

    @staticmethod
    def batch(p: ByteRange, own, values: list) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([p.file] * n, pa.string()), pa.array([p.number] * n, pa.int32()), pa.array(own, pa.int64()), pa.array(values, pa.string())], ["file", "range", "own", "value"])


class TextRanges(DataSource):
    """`text_ranges`: options path, rangeBytes, rows and head, see RangeReader."""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return KIND

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def text_ranges(spark: SparkSession, path: str, rows: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(TextRanges)
    return spark.read.format("text_ranges").option("path", path).option("rows", rows).option("rangeBytes", str(range_bytes)).load()


def grid_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, ncols, nrows, xc, yc, gs, nodata): the second tokens of each file's first six lines. No other line is read."""
    head = text_ranges(spark, path, "head").withColumn("v", F.regexp_extract("value", r"^\s*\S+\s+(\S+)", 1).try_cast("double"))
    out = head.groupBy("file").agg(*(F.max(F.when(F.col("own") == i, F.col("v"))).alias(n) for i, n in enumerate(HEADER)))
    return out.withColumn("ncols", F.col("ncols").cast("int")).withColumn("nrows", F.col("nrows").cast("int"))


def read_grid_ranges(spark: SparkSession, path: str, value: str = "z", site: str = r"([^/]*)\.[^./]*$", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(site_id, r, c, value) of the ASCII grids below path, north first; the no-data value and NaN are null. site_id is the first
    group of site in the file's path.

    Ranges depend on the files and range_bytes alone, so both scans and repeated tasks have the same. A row's number is its
    place in its range and the lines of the ranges before it: one number a range is shared, the lines are never shuffled.
    Lines without a number, such as an empty last one, have no cells; a path without files has no rows.
    """
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = text_ranges(spark, path, "counts", range_bytes).select("file", "range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    known = base.join(grid_headers(spark, path).select("file", "nodata"), "file")
    # A row for each range of range_bytes: 100 TB of text have 1.6 million of the default size.
    lines = text_ranges(spark, path, "lines", range_bytes).join(known, ["file", "range"])
    rows = lines.withColumn("line", F.col("base") + F.col("own")).where(F.col("line") >= len(HEADER))
    cells = rows.select(F.regexp_extract("file", site, 1).alias("site_id"), (F.col("line") - len(HEADER)).cast("int").alias("r"), "nodata", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "t")).where("t <> ''")
    v = F.col("t").cast("double")
    return cells.select("site_id", "r", "c", F.when(~v.eqNullSafe(F.col("nodata")) & ~F.isnan(v), v).alias(value))
