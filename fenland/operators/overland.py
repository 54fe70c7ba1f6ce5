"""Overland path length, catchment and tidal prism."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fenland.functions.helpers import hull, widest

from .cells import KEYS, with_values


def tidal_prism(cells: DataFrame, hat: float, gs: float | None = None) -> DataFrame:
    """Sum of HAT - z below HAT; with gs times the cell's area."""
    return with_values(cells, _hat=hat).groupBy("site_id").agg((F.sum(F.greatest(F.col("_hat") - F.col("z"), F.lit(0.0))) * (gs * gs if gs else 1.0)).alias("prism"))


def marsh_means(cells: DataFrame, mask: DataFrame, hat: float) -> DataFrame:
    """Creek cells, catchment cells, mean z, mean z outside the creek, HAT minus mean z."""
    m = with_values(cells.join(mask.select(*KEYS, F.lit(1).alias("creek")), KEYS, "left"), _hat=hat)
    return m.groupBy("site_id").agg(F.count("creek").alias("creek_area"), F.count("z").alias("catchment_area"), F.avg("z").alias("mean_elev"), F.avg(F.when(F.col("creek").isNull(), F.col("z"))).alias("marsh_elev"), (F.max("_hat") - F.avg("z")).alias("elev_under_hat"))


def mean_overland_path(distance: DataFrame, area: DataFrame) -> DataFrame:
    return distance.join(area.select(*KEYS), KEYS, "left_semi").groupBy("site_id").agg(F.avg("d").alias("mean_opl"), F.max("d").alias("max_opl"))


def major_axis(area: DataFrame, rows: int = 2048) -> DataFrame:
    """The largest distance of two cells of the area. Its ends are corners of the convex hull: the first and last cells of each
    row give hulls of so many rows each, and their corners that of the site, around which calipers turn."""
    ends = area.groupBy("site_id", "r").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    points = ends.select("site_id", F.expr(f"r div {rows}").alias("part"), F.col("r").cast("long").alias("r"), F.explode(F.array_distinct(F.array(F.col("lo").cast("long"), F.col("hi").cast("long")))).alias("c"))
    corners = points.groupBy("site_id", "part").applyInPandas(part_hull, "site_id long, r long, c long")
    return corners.groupBy("site_id").applyInPandas(site_axis, "site_id long, major_axis double")


def part_hull(frame: pd.DataFrame) -> pd.DataFrame:
    p = hull(frame[["r", "c"]].to_numpy())
    return pd.DataFrame({"site_id": frame["site_id"].iloc[0], "r": p[:, 0], "c": p[:, 1]})


def site_axis(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"site_id": [frame["site_id"].iloc[0]], "major_axis": [widest(hull(frame[["r", "c"]].to_numpy())) ** 0.5]})


def percent_of_axis(distance: DataFrame, axis: DataFrame) -> DataFrame:
    return distance.join(axis, "site_id").withColumn("d_percent", F.col("d") / F.col("major_axis") * 100).drop("major_axis")


def isocontour_bands(distance: DataFrame) -> DataFrame:
    """(site_id, band, lo, cells): bands of 2, 1 or 1/2 by the largest distance."""
    m = distance.groupBy("site_id").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    step = F.when(F.col("most") >= 10, 2.0).when(F.col("most") >= 4, 1.0).otherwise(0.5)
    b = distance.where("d is not null").join(m, "site_id").withColumn("step", step).withColumn("band", F.floor((F.col("d") - F.col("least")) / F.col("step")))
    return b.groupBy("site_id", "band", "least", "step").agg(F.count("*").alias("cells")).select("site_id", "band", (F.col("least") + F.col("band") * F.col("step")).alias("lo"), "cells")
