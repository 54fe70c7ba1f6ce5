"""Morphology and neighbourhoods of sparse masks(site_id, r, c) by offset joins. Outside a mask is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .cells import KEYS, with_values

#: Neighbour bits of a code: NW 1, N 2, NE 4, W 8, E 16, SW 32, S 64, SE 128.
NB8 = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
NB4 = [(-1, 0), (0, -1), (0, 1), (1, 0)]
SQUARE = [(0, 0), *NB8]
# The kernels of branch points and the side patterns that rule them out, as neighbour codes.
BRANCH_KERNELS = (90, 165, 138, 50, 81, 76, 69, 140, 162, 49)
SIDE_PATTERNS = (7, 148, 224, 41, 11, 22, 208, 104)
# Two neighbours around a corner and no other.
DIAGONALS = (2 + 8, 2 + 16, 8 + 64, 16 + 64)


def disk(radius: int) -> list[tuple[int, int]]:
    k = range(-radius, radius + 1)
    return [(a, b) for a in k for b in k if a * a + b * b <= radius * radius]


def moved(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell shifted by every offset, with the offset's position k."""
    o = F.posexplode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets))).alias("k", "o")
    return mask.select("*", o).withColumn("r", F.col("r") + F.col("o.dr")).withColumn("c", F.col("c") + F.col("o.dc")).drop("o")


def dilate(mask: DataFrame, radius: int, grid: DataFrame | None = None) -> DataFrame:
    out = moved(mask.select(*KEYS), disk(radius)).select(*KEYS).distinct()
    return out if grid is None else out.join(grid.select(*KEYS), KEYS, "left_semi")


def erode(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells whose whole element lies in the mask; outside counts as empty."""
    return moved(mask.select(*KEYS), [(-a, -b) for a, b in offsets]).groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") == len(offsets)).select(*KEYS)


def close(mask: DataFrame, radius: int, grid: DataFrame) -> DataFrame:
    """Dilation, then erosion that ignores what is outside the grid."""
    grown = dilate(mask, radius, grid)
    missing = grid.select(*KEYS).join(grown, KEYS, "left_anti")
    return grown.join(dilate(missing, radius), KEYS, "left_anti")


def complement(mask: DataFrame, grid: DataFrame) -> DataFrame:
    return grid.select(*KEYS).join(mask, KEYS, "left_anti")


def neighbour_codes(mask: DataFrame) -> DataFrame:
    """(site_id, r, c, code, inside) for each cell of the mask or next to it: which of its neighbours are in the mask."""
    m = mask.select(*KEYS)
    back = [(-a, -b) for a, b in NB8]
    near = moved(m, back).select(*KEYS, F.shiftleft(F.lit(1), 0).alias("one"), "k").select(*KEYS, F.expr("shiftleft(1, k)").alias("bit"), F.lit(0).alias("own"))
    return near.union(m.select(*KEYS, F.lit(0), F.lit(1))).groupBy(*KEYS).agg(F.sum("bit").cast("int").alias("code"), (F.max("own") == 1).alias("inside"))


def neighbour_count(mask: DataFrame) -> DataFrame:
    return neighbour_codes(mask).where("inside").select(*KEYS, F.bit_count("code").alias("n"))


def end_points(skel: DataFrame) -> DataFrame:
    return neighbour_count(skel).where("n <= 1").select(*KEYS)


def remove_isolated(mask: DataFrame) -> DataFrame:
    return neighbour_count(mask).where("n > 0").select(*KEYS)


def any_of(code: Column, kernels: tuple[int, ...], least: int) -> Column:
    out = F.lit(False)
    for k in kernels:
        out = out | (F.bit_count(code.bitwiseAND(F.lit(k))) >= least)
    return out


def branch_points(skel: DataFrame, z: DataFrame) -> DataFrame:
    """Three hits of any kernel and no full side pattern; also the lowest cell of each full 2 x 2 square, nulls last."""
    code = F.col("code")
    crossing = neighbour_codes(skel).where("inside").where(any_of(code, BRANCH_KERNELS, 3) & ~any_of(code, SIDE_PATTERNS, 3)).select(*KEYS)
    full = moved(skel.select(*KEYS), [(0, 0), (0, -1), (-1, 0), (-1, -1)]).groupBy(*KEYS).agg(F.count("*").alias("n")).where("n = 4")
    corners = full.select("site_id", F.col("r").alias("r0"), F.col("c").alias("c0"), "r", "c")
    corners = moved(corners, [(0, 0), (0, 1), (1, 0), (1, 1)]).join(z.select(*KEYS, "z"), KEYS, "left")
    lowest = corners.groupBy("site_id", "r0", "c0").agg(F.min_by(F.struct("r", "c"), F.struct(F.col("z").isNull(), "z", "k")).alias("p")).select("site_id", "p.r", "p.c")
    return crossing.union(lowest).distinct()


def bwmorph_diag(mask: DataFrame) -> DataFrame:
    """Adds empty cells whose only neighbours in the mask are two around a corner."""
    fill = neighbour_codes(mask).where(~F.col("inside") & F.col("code").isin(*DIAGONALS)).select(*KEYS)
    return mask.select(*KEYS).union(fill)


def border_mask(land: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Land cells off the grid's edge with a 4-neighbour that is not land."""
    code = neighbour_codes(land).where("inside")
    return code.where(F.bit_count(F.col("code").bitwiseAND(F.lit(2 + 8 + 16 + 64))) < 4).transform(with_values, _nrows=nrows, _ncols=ncols).where("r > 0 and c > 0 and r < _nrows - 1 and c < _ncols - 1").select(*KEYS)


def perimeter_mask(area: DataFrame) -> DataFrame:
    return area.select(*KEYS).join(erode(area, SQUARE), KEYS, "left_anti")


def regional_min(field: DataFrame, value: str = "d") -> DataFrame:
    """Cells that are the minimum of their 3 x 3 surroundings."""
    near = moved(field.select(*KEYS, value), SQUARE).groupBy(*KEYS).agg(F.min(value).alias("least"))
    return field.where(F.col(value).isNotNull()).join(near, KEYS).where(F.col(value) == F.col("least")).select(*KEYS)
