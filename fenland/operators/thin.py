"""Thinning of masks to one-cell centre lines, by tiles with a halo."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from fenland.functions.helpers import TILE, thin_tile
from fenland.functions.tables import replaced, written

from .cells import KEYS

HALO = 16
#: Tiles that have changed of which the list is broadcast (24 bytes each, nine times).
BROADCAST_TILES = 50_000


def skeletonize(mask: DataFrame, tile: int = TILE, halo: int = HALO, rounds: int = 1000) -> DataFrame:
    """The mask thinned until nothing changes. A sub-iteration looks one cell around, so with a halo of as many cells as
    sub-iterations are run between exchanges the result is that of the untiled mask, whatever the tile size. Only tiles that have
    changed, or beside one that has, go into the next round."""
    passes = halo // 2 * 2
    tiles = ["site_id", "tr", "tc"]
    cells = mask.select(*(F.col(k).cast("long") for k in KEYS)).distinct()
    now = written(cells.select(*KEYS, F.expr(f"r div {tile}").alias("tr"), F.expr(f"c div {tile}").alias("tc")), "thin")
    active = None
    for _ in range(rounds):
        live = now.where("r is not null")
        spread = framed(live, tile, halo)
        if active is not None:
            spread = spread.join(active, tiles, "left_semi")
        after = spread.groupBy(*tiles).applyInPandas(partial_of(tile, halo, passes), "site_id long, r long, c long, tr long, tc long")
        if active is not None:
            after = after.unionByName(live.join(active, tiles, "left_anti").select(after.columns))
        now = replaced(after, "thin", now)
        changed = now.where("r is null").select(*tiles)
        n = changed.count()
        if not n:
            return now.select(*KEYS)
        active = beside(changed, n)
    raise RuntimeError("thinning has not settled")


def framed(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """cells for each tile that they lie in or within halo of: with tr, tc of that tile."""
    shifts = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    spread = cells.withColumn("tr", F.explode(shifts)).withColumn("tc", F.explode(shifts)).withColumn("tr", F.expr(f"r div {tile} + tr")).withColumn("tc", F.expr(f"c div {tile} + tc"))
    return spread.where(f"r between tr * {tile} - {halo} and tr * {tile} + {tile + halo - 1} and c between tc * {tile} - {halo} and tc * {tile} + {tile + halo - 1} and tr >= 0 and tc >= 0")


def beside(changed: DataFrame, n: int) -> DataFrame:
    """The n tiles of changed and those around them; they are broadcast while they are few."""
    shifts = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    out = changed.withColumn("i", F.explode(shifts)).withColumn("j", F.explode(shifts)).select("site_id", (F.col("tr") + F.col("i")).alias("tr"), (F.col("tc") + F.col("j")).alias("tc")).distinct()
    return F.broadcast(out) if n <= BROADCAST_TILES else out


def partial_of(tile: int, halo: int, passes: int):
    thin = partial(thin_tile, tile=tile, halo=halo, passes=passes)
    return lambda frame: thin(frame)
