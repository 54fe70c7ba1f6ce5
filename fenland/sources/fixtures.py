"""Rasters that Spark derives from the orders table, and generated networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS, COLS = 50, 100
PARAMS = {"hat": 2.286, "mhws": 1.756, "cth": 8.0, "lzth": 0.42, "hzth": 0.52, "gs": 1.0, "nbbreaches": 1, "noise": 5, "dist": 3, "smoothing": 1, "hole": 5, "small": 10, "large": 1_000_000, "ordermax": 4}

#: {div} is the integer division of the dialect.
CELLS = """
SELECT site_id, r, c,
  CASE WHEN (r*100+c) % 997 = 0 OR (c < 3 AND r > 30) THEN NULL
       ELSE CAST(18 + least(220, 4*d2) + (49-r) {div} 4 + noise AS DOUBLE) / CAST(100 AS DOUBLE) END AS z,
  CASE WHEN d2 BETWEEN 4 AND 7 THEN CAST(100 + 10*noise AS DOUBLE) ELSE CAST(10 + noise AS DOUBLE) END / CAST(10 AS DOUBLE) AS slope
FROM (SELECT *, least(
     2*abs(c-50),
     CASE WHEN c >= 50 AND c NOT IN (61,62) THEN abs(2*(r-30)+(c-50)) ELSE 999 END,
     CASE WHEN c <= 50 THEN abs(2*(r-20)+(50-c)) ELSE 999 END,
     CASE WHEN c BETWEEN 68 AND 95 THEN abs(2*(r-21)-(c-70)) ELSE 999 END,
     4*greatest(abs(r-42),abs(c-15))) AS d2
  FROM (SELECT o_orderkey {div} 5000 AS site_id, (o_orderkey % 5000) {div} 100 AS r, o_orderkey % 100 AS c,
               CAST(floor(o_totalprice) AS BIGINT) % 5 AS noise FROM orders) g) d
"""


def orders_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(site_id, r, c, z, slope): sites of 50 rows and 100 columns from the order keys."""
    sql = CELLS.format(div="div").replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def grids_of(cells: DataFrame) -> DataFrame:
    return cells.select("site_id").distinct().select("site_id", F.lit(COLS).alias("ncols"), F.lit(ROWS).alias("nrows"), F.lit(0.0).alias("xc"), F.lit(0.0).alias("yc"), F.lit(PARAMS["gs"]).alias("gs"))


def params_of(cells: DataFrame) -> DataFrame:
    return cells.select("site_id").distinct().select("site_id", *(F.lit(v).alias(k) for k, v in PARAMS.items()))


def phony_network(spark: SparkSession, sites: int, size: int = 128) -> DataFrame:
    """mask(site_id, r, c) of generated creeks, a trunk with branches and a square loop, one cell off for each site."""
    from fenland.operators.geometry import rasterize_line
    from fenland.operators.morph import dilate

    e = size - 1
    parts = [(0, size // 2, e, size // 2), (size // 4, size // 2, 0, size // 4), (size // 2, size // 2, size // 4, e - 4), (size // 2 + 8, size // 2, e - 8, 8), (10, 80, 10, 95), (10, 95, 25, 95), (25, 95, 25, 80), (25, 80, 10, 80)]
    lines = spark.range(sites).select(F.col("id").alias("site_id"), F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, ("r1", "c1", "r2", "c2"), strict=True))) for p in parts))).alias("p")).select("site_id", "p.*")
    cells = rasterize_line(lines.withColumn("line_id", F.monotonically_increasing_id())).select("site_id", "r", "c").distinct()
    return dilate(cells, 1).where(f"r between 0 and {e} and c between 0 and {e}")


def phony_surface(mask: DataFrame) -> DataFrame:
    """cells(site_id, r, c, z) of the thinned mask: z is the distance along it to the outlet, the lowest row's first cell,
    scaled to 0 .. 100 in each site; cells that no path joins with the outlet are left out."""
    from fenland.operators.network import geodesic_distance
    from fenland.operators.thin import skeletonize

    skel = skeletonize(mask)
    outlet = skel.groupBy("site_id").agg(F.max_by(F.struct("r", "c"), F.struct("r", -F.col("c"))).alias("p")).select("site_id", "p.r", "p.c")
    d = geodesic_distance(skel, outlet)
    most = d.groupBy("site_id").agg(F.max("d").alias("most"))
    return d.join(most, "site_id").select("site_id", "r", "c", (F.col("d") * 100 / F.nullif(F.col("most"), F.lit(0.0))).alias("z"))
