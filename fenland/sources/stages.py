"""Tables handed from one step to the next (stages), one Parquet folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_stage(df: DataFrame, folder: str, name: str) -> None:
    """Writes a step's table as folder/name, in place of the one before; rows of a site lie together."""
    (df.repartition("site_id", *(k for k in ("r",) if k in df.columns)) if "site_id" in df.columns else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


#: Side of the square of cells that a bucketed table keeps together.
SQUARE = 256
TILES = ("site_id", "tr", "tc")


def with_tiles(df: DataFrame) -> DataFrame:
    """df(site_id, r, c, ...) with tr and tc, the tile of each cell."""
    return df.withColumn("tr", F.expr(f"r div {SQUARE}")).withColumn("tc", F.expr(f"c div {SQUARE}"))


def write_bucketed(df: DataFrame, table: str, buckets: int) -> DataFrame:
    """df(site_id, r, c, ...) as a table of the catalogue, in place of the one before: bucketed by site and tile, sorted by cell
    within. Tables of as many buckets join on site, tile and cell without an exchange, see joined."""
    with_tiles(df).write.mode("overwrite").format("parquet").bucketBy(buckets, *TILES).sortBy(*TILES, "r", "c").saveAsTable(table)
    return df.sparkSession.table(table)


def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left join right, both of write_bucketed, cell by cell. The plan is made here, while buckets by some of the keys are enough
    for Spark; neither side is shuffled if the numbers of buckets are equal."""
    spark, key = left.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        out = left.join(right.hint("merge"), [*TILES, "r", "c"], how)
        out._jdf.queryExecution().executedPlan()
        return out
    finally:
        spark.conf.set(key, before)
