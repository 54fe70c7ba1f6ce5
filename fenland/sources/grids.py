"""Readers of ASCII grids and site parameters, and the stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

HEADER = ("ncols", "nrows", "xc", "yc", "gs", "nodata")
SITE = r"^(.*)\.[^.]*$"
TEXT_PARAMS = ("name", "shortname", "elev", "elevmeta", "slope", "slopemeta")


def numbered_lines(spark: SparkSession, paths, site: str | None = None) -> DataFrame:
    """(site_id, line_no, value): lines of text files with their number from 0; a file may have many splits. site_id is the first
    group of the pattern site in the file's path, or the file's name without its ending.

    A line's number is its rank inside its split plus the lines of the splits before; only the counts are shared.
    """
    lines = spark.read.text(paths).select((F.regexp_extract("_metadata.file_path", site, 1) if site else F.regexp_extract("_metadata.file_name", SITE, 1)).alias("site_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("own", F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.join(counts, ["file", "block"]).select("site_id", (F.col("base") + F.col("own")).alias("line_no"), "value")


def read_grid_header(spark: SparkSession, paths, site: str | None = None) -> DataFrame:
    """grids(site_id, ncols, nrows, xc, yc, gs, nodata): the second token of the first six lines, whatever their names."""
    head = numbered_lines(spark, paths, site).where("line_no < 6").withColumn("v", F.regexp_extract("value", r"^\s*\S+\s+(\S+)", 1).cast("double"))
    cols = [F.max(F.when(F.col("line_no") == i, F.col("v"))).alias(n) for i, n in enumerate(HEADER)]
    out = head.groupBy("site_id").agg(*cols)
    return out.withColumn("ncols", F.col("ncols").cast("int")).withColumn("nrows", F.col("nrows").cast("int"))


def read_ascii_grid(spark: SparkSession, paths, value: str = "z", site: str | None = None) -> DataFrame:
    """(site_id, r, c, value): one row a cell, north first; the no-data value and NaN are null."""
    grids = read_grid_header(spark, paths, site).select("site_id", "nodata")
    rows = numbered_lines(spark, paths, site).where("line_no >= 6")
    cells = rows.select("site_id", (F.col("line_no") - 6).cast("int").alias("r"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "t"))
    v = F.col("t").cast("double")
    return cells.where("t <> ''").join(grids, "site_id").select("site_id", "r", "c", F.when((v != F.col("nodata")) & ~F.isnan(v), v).alias(value))


def read_site_params(spark: SparkSession, paths) -> DataFrame:
    """A row for each file of `key=value; # comment` lines, the keys as columns; numbers are doubles. Text is never run."""
    lines = spark.read.text(paths).select(F.regexp_extract("_metadata.file_name", SITE, 1).alias("site_id"), F.regexp_extract("value", r"^\s*(\w+)\s*=\s*([^;#]*)", 1).alias("k"), F.trim(F.regexp_extract("value", r"^\s*(\w+)\s*=\s*([^;#]*)", 2), F.lit(" \t'\"")).alias("v")).where("k <> ''")
    wide = lines.groupBy("site_id").pivot("k").agg(F.max("v"))
    return wide.select("site_id", *(F.col(c) if c.lower() in TEXT_PARAMS else F.col(c).cast("double").alias(c) for c in wide.columns if c != "site_id"))


def write_cells(df: DataFrame, path: str) -> None:
    df.repartition("site_id", F.expr("r div 256")).write.mode("overwrite").partitionBy("site_id").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The summary in the order of sites and orders, sorted over all files: a file's rows come before those of the next one. Rows
    without a site or an order stand first. The number of rows read back is checked."""
    df.orderBy("site_id", "ord").write.mode("overwrite").option("header", True).format(fmt).save(path)
    spark = df.sparkSession
    stored = spark.read.option("header", True).format(fmt).load(path).count()
    if stored != df.count():
        raise RuntimeError(f"{path} has {stored} rows, not those of the summary")


def read_summary(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def write_ascii_grid(cells: DataFrame, grids: DataFrame, folder: str, value: str = "z", nodata: float = -9999.0) -> None:
    """cells(site_id, r, c, value) and grids(site_id, ncols, nrows, xc, yc, gs) as text: the six header lines and a line for each
    row of the grid, north first; a folder site=<site_id> for each site. Missing cells and nulls are the no-data value.

    Lines are put together row by row, so no task holds a site; their order is that of a sort by site and line, of which a
    site's lines share one file.
    """
    spot = grids.select("site_id", "ncols", "nrows", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)).alias("r"))
    lines = spot.join(cells.where(F.col(value).isNotNull()).groupBy("site_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", value))).alias("m")), ["site_id", "r"], "left")
    number = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(nodata)).cast("string")
    body = lines.select("site_id", (F.col("r") + 6).alias("line"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("ncols") - 1), lambda i: number(i.cast("long"))), " ").alias("value"))
    head = grids.withColumn("nodata", F.lit(nodata)).select("site_id", F.posexplode(F.array(*(F.concat(F.lit(f"{n} "), F.col(c).cast("string")) for n, c in zip(("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "NODATA_value"), HEADER, strict=True)))).alias("line", "value"))
    both = head.select("site_id", F.col("line").cast("long").alias("line"), "value").union(body.select("site_id", F.col("line").cast("long"), "value"))
    both.repartition("site_id").sortWithinPartitions("site_id", "line").select(F.col("site_id").alias("site"), "value").write.mode("overwrite").partitionBy("site").text(folder)


