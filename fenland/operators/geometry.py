"""Straight lines, rotations and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rasterize_line(lines: DataFrame, ties_down: bool = True) -> DataFrame:
    """lines(r1, c1, r2, c2, ...) -> a row for each cell, with its position pos; other columns are kept.

    The major axis is the column only if |dc| > |dr|; the minor coordinate rounds half steps down or up.
    """
    dr, dc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    major, minor = F.greatest(F.abs(dr), F.abs(dc)), F.least(F.abs(dr), F.abs(dc))
    d = lines.withColumn("_maj", major).withColumn("_min", minor).withColumn("pos", F.explode(F.sequence(F.lit(0), major.cast("int"))))
    half = F.col("_maj") - 1 if ties_down else F.col("_maj")
    step = F.when(F.col("_maj") == 0, 0).otherwise(F.floor((2 * F.col("pos") * F.col("_min") + half) / (2 * F.col("_maj")))).cast("long")
    by_c = F.abs(dc) > F.abs(dr)
    r = F.col("r1") + F.signum(dr).cast("long") * F.when(by_c, step).otherwise(F.col("pos"))
    c = F.col("c1") + F.signum(dc).cast("long") * F.when(by_c, F.col("pos")).otherwise(step)
    return d.withColumn("r", r.cast("long")).withColumn("c", c.cast("long")).drop("_maj", "_min", "r1", "c1", "r2", "c2")


def rotate90(x: Column, y: Column, xm: Column, ym: Column, sign: int = 1) -> tuple[Column, Column]:
    """The point turned by 90 degrees (sign 1: counter-clockwise) around (xm, ym)."""
    return xm - sign * (y - ym), ym + sign * (x - xm)


def euclid(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.sqrt((r1 - r2) * (r1 - r2) + (c1 - c2) * (c1 - c2))


def sinuosity(sinuous: Column, straight: Column) -> Column:
    """Null where the straight length is 0."""
    return sinuous / F.nullif(straight, F.lit(0.0))


def in_bounds(points: DataFrame, nrows: int, ncols: int) -> DataFrame:
    return points.where(f"r between 0 and {nrows - 1} and c between 0 and {ncols - 1}")


def angle_between(dr1: Column, dc1: Column, dr2: Column, dc2: Column) -> Column:
    """|difference of directions| in degrees, not wrapped."""
    return F.abs(F.degrees(F.atan2(dr1, dc1) - F.atan2(dr2, dc2)))


def wrapped(angle: Column) -> Column:
    return F.when(angle > 180, 360 - angle).otherwise(angle)
