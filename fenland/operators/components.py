"""Connected components of masks and the filters on their sizes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fenland.functions.helpers import TILE, tile_components
from fenland.functions.tables import written

from .cells import KEYS, with_values
from .graph import connected_components as graph_components
from .morph import NB4, NB8, close, complement, moved


def label(mask: DataFrame, connectivity: int = 8, tile: int = TILE, stride: int = 1 << 20) -> DataFrame:
    """labels(site_id, r, c, comp): comp is the least r * stride + c of the component, the same for any tile size.

    Tiles are labelled by themselves; only pairs of labels that touch across tile borders enter the graph.
    """

    def of_tile(frame: pd.DataFrame) -> pd.DataFrame:
        first = tile_components(frame["r"].to_numpy(), frame["c"].to_numpy(), connectivity == 8)
        return pd.DataFrame({"site_id": frame["site_id"], "r": frame["r"], "c": frame["c"], "part": (frame["r"] * stride + frame["c"]).to_numpy()[first]})

    m = mask.select(*(F.col(k).cast("long") for k in KEYS)).distinct().withColumn("tr", F.expr(f"r div {tile}")).withColumn("tc", F.expr(f"c div {tile}"))
    parts = written(m.groupBy("site_id", "tr", "tc").applyInPandas(of_tile, "site_id long, r long, c long, part long"), "parts")
    edge = parts.where(f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})")
    pairs = moved(edge, NB8 if connectivity == 8 else NB4).select(*KEYS, F.col("part").alias("near")).join(edge, KEYS).where("part <> near").select("site_id", "part", "near").distinct()
    pairs = written(pairs, "touching")
    if pairs.isEmpty():
        return parts.withColumnRenamed("part", "comp")
    # Graph nodes are numbered over all sites by their rank among the touching labels.
    ids = written(pairs.select("site_id", "part").distinct().withColumn("id", F.monotonically_increasing_id()), "touching-ids")
    edges = pairs.join(ids, ["site_id", "part"]).join(ids.select("site_id", F.col("part").alias("near"), F.col("id").alias("id2")), ["site_id", "near"]).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    comp = ids.join(graph_components(edges), ids["id"] == F.col("node")).select("site_id", "part", F.col("comp").alias("root"))
    least = comp.groupBy("site_id", "root").agg(F.min("part").alias("comp"))
    named = comp.join(least, ["site_id", "root"]).select("site_id", "part", "comp")
    return parts.join(named, ["site_id", "part"], "left").select(*KEYS, F.coalesce("comp", "part").alias("comp"))


def component_size(labels: DataFrame) -> DataFrame:
    return labels.groupBy("site_id", "comp").agg(F.count("*").alias("n"))


def largest_component(labels: DataFrame) -> DataFrame:
    """The component of most cells in each site, the first of equal ones."""
    return component_size(labels).groupBy("site_id").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("comp"))


def component_props(labels: DataFrame) -> DataFrame:
    """Area, centroid, bounding box, perimeter and circularity P * P / (4 pi A) of each component.

    The perimeter adds 1, sqrt 2 or (1 + sqrt 2) / 2 for each border cell by the kinds of its border neighbours.
    """
    box = labels.groupBy("site_id", "comp").agg(F.count("*").alias("area"), F.avg("r").alias("r_mean"), F.avg("c").alias("c_mean"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))
    inner = moved(labels, NB4).groupBy(*KEYS, "comp").agg(F.count("*").alias("n")).where("n = 4").select(*KEYS, "comp")
    border = written(labels.join(inner, [*KEYS, "comp"], "left_anti").select(*KEYS, "comp"), "border")
    near = moved(border, NB8).withColumn("w", F.when(F.col("k").isin(1, 3, 4, 6), 2).otherwise(10)).groupBy(*KEYS, "comp").agg(F.sum("w").alias("w"))
    # Sums of neighbour weights (centre 1, axial 2, diagonal 10) that stand for each share of the perimeter.
    code = F.coalesce("w", F.lit(0)) + 1
    share = F.when(code.isin(5, 7, 15, 17, 25, 27), 1.0).when(code.isin(21, 33), 2**0.5).when(code.isin(13, 23), (1 + 2**0.5) / 2).otherwise(0.0)
    length = border.join(near, [*KEYS, "comp"], "left").groupBy("site_id", "comp").agg(F.sum(share).alias("perimeter"))
    return box.join(length, ["site_id", "comp"], "left").withColumn("circularity", F.col("perimeter") * F.col("perimeter") / (4 * F.pi() * F.col("area")))


def remove_small_objects(mask: DataFrame, least: int, connectivity: int = 8) -> DataFrame:
    labels = label(mask, connectivity)
    big = with_values(component_size(labels), _least=least).where("n >= _least").select("site_id", "comp")
    return labels.join(big, ["site_id", "comp"], "left_semi").select(*KEYS)


def area_filter(mask: DataFrame, grid: DataFrame, low: int, high: int, mode: str = "reference", connectivity: int = 8) -> DataFrame:
    """Drops components below low; then, by mode, fills background components below (cells of the site - high), or drops
    components above high."""
    if mode == "range":
        labels = label(mask, connectivity)
        fit = with_values(component_size(labels), _low=low, _high=high).where("n between _low and _high").select("site_id", "comp")
        return labels.join(fit, ["site_id", "comp"], "left_semi").select(*KEYS)
    kept = written(remove_small_objects(mask, low), "kept")
    back = label(complement(kept, grid), 8)
    cells = grid.groupBy("site_id").agg(F.count("*").alias("cells"))
    small = with_values(component_size(back).join(cells, "site_id"), _high=high).where("n < cells - _high").select("site_id", "comp")
    return kept.union(back.join(small, ["site_id", "comp"], "left_semi").select(*KEYS))


def holes(mask: DataFrame, grid: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Background cells that are not 4-connected with the grid's edge."""
    back = label(complement(mask, grid), 4)
    open_ = with_values(back, _nrows=nrows, _ncols=ncols).where("r = 0 or c = 0 or r = _nrows - 1 or c = _ncols - 1").select("site_id", "comp").distinct()
    return back.join(open_, ["site_id", "comp"], "left_anti").select(*KEYS)


def fill_holes(mask: DataFrame, grid: DataFrame, nrows: int, ncols: int) -> DataFrame:
    return mask.select(*KEYS).union(holes(mask, grid, nrows, ncols))


def fill_small_holes(mask: DataFrame, grid: DataFrame, nrows: int, ncols: int, most: int) -> DataFrame:
    """Fills holes whose 8-connected component has fewer than most cells."""
    empty = label(holes(mask, grid, nrows, ncols), 8)
    small = with_values(component_size(empty), _most=most).where("n < _most").select("site_id", "comp")
    return mask.select(*KEYS).union(empty.join(small, ["site_id", "comp"], "left_semi").select(*KEYS))


def close_by_site(mask: DataFrame, radius, grid: DataFrame) -> DataFrame:
    """close with one radius, or with that of each site in a table (site_id, value); sites of equal radius go together."""
    if not isinstance(radius, DataFrame):
        return close(mask, radius, grid)
    parts = []
    for (r,) in sorted(tuple(x) for x in radius.select("value").distinct().where("value is not null").collect()):
        here = radius.where(F.col("value") == r).select("site_id")
        parts.append(close(mask.join(here, "site_id", "left_semi"), int(r), grid.join(here, "site_id", "left_semi")))
    return reduce(DataFrame.union, parts) if parts else mask.limit(0)


def repair(mask: DataFrame, grid: DataFrame, nrows: int, ncols: int, small: int, large: int, smoothing: int, hole: int, small2: int, large2: int) -> DataFrame:
    """Size filter, closing, size filter, small holes. Each number may be a table (site_id, value)."""
    m = written(area_filter(mask, grid, small, large), "repair")
    m = written(close_by_site(m, smoothing, grid), "repair")
    m = written(area_filter(m, grid, small2, large2), "repair")
    return fill_small_holes(m, grid, nrows, ncols, hole)
