"""Joins the objects of a mask to the largest one (operator N12) and nearest pairs between components (J10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fenland.functions.tables import written

from .cells import KEYS
from .components import component_props, component_size, label, largest_component
from .edt import edt
from .geometry import rasterize_line


def closest_to_largest(labels: DataFrame, grid: DataFrame, within: float) -> DataFrame:
    """(site_id, comp, r, c, r2, c2, d): each other component's cell nearest to the largest one, and that one's cell."""
    big = largest_component(labels)
    main = written(labels.join(big, ["site_id", "comp"], "left_semi"), "main")
    other = labels.join(big, ["site_id", "comp"], "left_anti")
    d = other.join(edt(grid, main), KEYS).groupBy("site_id", "comp").agg(F.min_by(F.struct("r", "c", "d"), F.struct("d", "r", "c")).alias("p")).select("site_id", "comp", "p.*").where(F.col("d") <= within)
    # The partner lies within the distance: an equi-join on squares of that side, not all pairs.
    side = int(within) + 1
    around = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    near = d.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumn("br", F.expr(f"r div {side} + i")).withColumn("bc", F.expr(f"c div {side} + j"))
    cells = main.select("site_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.expr(f"r div {side}").alias("br"), F.expr(f"c div {side}").alias("bc"))
    far = F.pow(F.col("r") - F.col("r2"), 2) + F.pow(F.col("c") - F.col("c2"), 2)
    pairs = near.join(cells, ["site_id", "br", "bc"]).groupBy("site_id", "comp", "r", "c", "d").agg(F.min_by(F.struct("r2", "c2"), F.struct(far, "r2", "c2")).alias("q"))
    return pairs.select("site_id", "comp", "r", "c", "q.r2", "q.c2", "d")


def reconnect(mask: DataFrame, grid: DataFrame, noise: int, dist: float, rounds: int = 1000) -> DataFrame:
    """Drops noise and objects that are round (circularity below 1), small or far; joins the others to the largest by a line."""
    now = mask.select(*KEYS)
    for _ in range(rounds):
        labels = label(now)
        labels = written(labels.join(component_size(labels).where(F.col("n") >= noise), ["site_id", "comp"], "left_semi"), "objects")
        big = largest_component(labels)
        props = component_props(labels).where(F.col("circularity") >= 1).select("site_id", "comp")
        ties = written(closest_to_largest(labels, grid, dist).join(props, ["site_id", "comp"], "left_semi"), "ties")
        kept = labels.join(big.union(ties.select("site_id", "comp")), ["site_id", "comp"], "left_semi").select(*KEYS)
        lines = rasterize_line(ties.select("site_id", F.col("r").alias("r1"), F.col("c").alias("c1"), "r2", "c2"), ties_down=False).select(*KEYS)
        now = written(kept.union(lines).distinct(), "reconnected")
        if ties.isEmpty():
            return now
    return now
