"""Cell-wise operators, joins of rasters, site statistics, detrending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ["site_id", "r", "c"]


def with_values(df: DataFrame, **values) -> DataFrame:
    """df with a column for each value, either one for all sites or a table (site_id, value), of which sites without a row have
    null."""
    for name, v in values.items():
        df = df.join(v.withColumnRenamed("value", name), "site_id", "left") if isinstance(v, DataFrame) else df.withColumn(name, F.lit(v))
    return df


def with_xy(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Map coordinates x, y of each cell; grids is one row a site."""
    g = grids.select("site_id", "nrows", "xc", "yc", "gs")
    return cells.join(g, "site_id").withColumn("x", F.col("xc") + F.col("c") * F.col("gs")).withColumn("y", F.col("yc") + F.col("gs") * (F.col("nrows") - 1 - F.col("r"))).drop("nrows", "xc", "yc", "gs")


def align(elev: DataFrame, slope: DataFrame) -> DataFrame:
    """Elevation and slope of the cells that both rasters have, which also crops to their common extent."""
    return elev.join(slope, KEYS)


def crop_to_common(elev: DataFrame, slope_grids: DataFrame) -> DataFrame:
    """Elevation cells within the rows and columns of the slope raster."""
    return elev.join(slope_grids.select("site_id", "nrows", "ncols"), "site_id").where("r < nrows and c < ncols").drop("nrows", "ncols")


def mask_above_hat(cells: DataFrame, hat: float, detrended: str = "z") -> DataFrame:
    """Slope is null where z is above HAT, then the detrended z is null where it is."""
    return cells.withColumn("slope", F.when(F.col("z") <= hat, F.col("slope"))).withColumn("z", F.when(F.col(detrended) <= hat, F.col(detrended)))


def abs_slope(cells: DataFrame) -> DataFrame:
    return cells.withColumn("slope", F.abs("slope"))


def resample_stride(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column, renumbered."""
    return cells.where(f"r % {step} = 0 and c % {step} = 0").withColumn("r", F.expr(f"r div {step}")).withColumn("c", F.expr(f"c div {step}"))


def zone(cth: float, lzth: float, hzth: float) -> Column:
    """inner, outer, marsh or nodata; a null slope counts as steep."""
    z, steep = F.col("z"), ~F.coalesce(F.col("slope") < cth, F.lit(False))
    return F.when(z.isNull(), "nodata").when(steep & (z < hzth), "outer").when(~steep & (z <= lzth), "inner").otherwise("marsh")


def zone_label(cells: DataFrame, cth: float, lzth: float, hzth: float) -> DataFrame:
    return cells.withColumn("zone", zone(cth, lzth, hzth))


def detect_creek(cells: DataFrame, cth: float, lzth: float, hzth: float, drop_zero: bool = True) -> DataFrame:
    """creek is z of inner and outer cells, else null; z of exactly 0 is dropped."""
    creek = F.when(zone(cth, lzth, hzth).isin("inner", "outer"), F.col("z"))
    return cells.withColumn("creek", F.when(creek != 0, creek) if drop_zero else creek)


def creek_mask(cells: DataFrame) -> DataFrame:
    return cells.where("creek is not null").select(*KEYS)


def land_mask(cells: DataFrame) -> DataFrame:
    return cells.where("z is not null").select(*KEYS)


def above_level_mask(cells: DataFrame, level: float) -> DataFrame:
    return cells.where(F.col("z") >= level).select(*KEYS)


def site_stats(cells: DataFrame) -> DataFrame:
    """Extremes of x, y (if cells have them) and z, means of z and slope; NULL is ignored, cells above HAT are not."""
    sides = [f(k).alias(f"{n}_{k}") for k in ("x", "y") if k in cells.columns for n, f in (("min", F.min), ("max", F.max))]
    return cells.groupBy("site_id").agg(*sides, F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_depth"), F.avg("slope").alias("mean_slope"), F.count("z").alias("n_cells"))


def fit_plane(cells: DataFrame) -> DataFrame:
    """plane(site_id, a, b, c0, mean_z): least squares z ~ a x + b y + c0 over cells with z, x and y 1-based column and row.

    Sums are centred on fixed points of the index range, so that one pass is enough and large grids lose no digits.
    """
    mid = cells.groupBy("site_id").agg(F.avg("c").alias("cx"), F.avg("r").alias("cy"), F.avg("z").alias("mean_z"))
    d = cells.where("z is not null").join(mid, "site_id").select("site_id", "cx", "cy", "mean_z", (F.col("c") - F.col("cx")).alias("x"), (F.col("r") - F.col("cy")).alias("y"), (F.col("z") - F.col("mean_z")).alias("z"))
    s = d.groupBy("site_id", "cx", "cy", "mean_z").agg(F.count("*").alias("n"), *(F.sum(F.col(p[0]) * F.col(p[1]) if len(p) == 2 else F.col(p)).alias(f"s{p}") for p in ("x", "y", "z", "xx", "xy", "yy", "xz", "yz")))
    cov = {p: F.col(f"s{p}") - F.col(f"s{p[0]}") * F.col(f"s{p[1]}") / F.col("n") for p in ("xx", "xy", "yy", "xz", "yz")}
    det = cov["xx"] * cov["yy"] - cov["xy"] * cov["xy"]
    s = s.withColumn("a", (cov["xz"] * cov["yy"] - cov["yz"] * cov["xy"]) / F.nullif(det, F.lit(0.0))).withColumn("b", (cov["yz"] * cov["xx"] - cov["xz"] * cov["xy"]) / F.nullif(det, F.lit(0.0)))
    c0 = F.col("mean_z") + (F.col("sz") - F.col("a") * F.col("sx") - F.col("b") * F.col("sy")) / F.col("n") - F.col("a") * (F.col("cx") + 1) - F.col("b") * (F.col("cy") + 1)
    return s.select("site_id", "a", "b", c0.alias("c0"), "mean_z")


def detrend(cells: DataFrame, plane: DataFrame) -> DataFrame:
    """z minus the plane plus the mean depth, as z_flat."""
    flat = F.col("z") - (F.col("a") * (F.col("c") + 1) + F.col("b") * (F.col("r") + 1) + F.col("c0")) + F.col("mean_z")
    return cells.join(plane, "site_id").withColumn("z_flat", flat).drop("a", "b", "c0", "mean_z")


def linear_index(ncols: int) -> Column:
    return F.col("r") * ncols + F.col("c")


def unravel(df: DataFrame, idx: str, ncols: int) -> DataFrame:
    return df.withColumn("r", F.expr(f"{idx} div {ncols}")).withColumn("c", F.col(idx) % ncols)


def nullify_nonpositive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in columns})


def sentinel_fill(df: DataFrame, column: str, by: list[str], sentinel: float = 999.0) -> DataFrame:
    """The sentinel is replaced by the mean of the group's other values."""
    v = F.nullif(F.col(column), F.lit(sentinel))
    mean = df.withColumn("_v", v).groupBy(*by).agg(F.avg("_v").alias("_mean"))
    return df.join(mean, by, "left").withColumn(column, F.when(F.col(column) == sentinel, F.col("_mean")).otherwise(F.col(column))).drop("_mean")


def order_swap(df: DataFrame, ordermax: int | DataFrame, column: str = "ord") -> DataFrame:
    """Reverse order: ordermax + 1 - order; 0 becomes null."""
    return with_values(df, _most=ordermax).withColumn("rs_order", F.when(F.col(column) > 0, F.col("_most") + 1 - F.col(column))).drop("_most")
