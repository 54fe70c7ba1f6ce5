"""Cross-section anchors of connectors and rings: the least path between the two ends of a chain, and the middle of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fenland.functions.tables import scratch, written

from .cells import KEYS
from .morph import NB8, moved
from .network import geodesic_distance

#: A path of at most so many cells is short; how far from the mean distance the middle cell may be.
SHORT, TOLERANCE = 3, 0.9
OF = ["site_id", "seg"]


def path_cells(chains: DataFrame, closed: DataFrame) -> DataFrame:
    """(site_id, seg, pos, r, c): the cells of a shortest path through each chain, from one end to the other.

    chains(site_id, r, c, seg) do not touch one another; closed(site_id, seg) are the rings among them. A chain's path begins at
    its first tip in row order and ends at the cell farthest from it. A ring is cut at its first cell: the path goes on from that
    cell's first neighbour to its last one. Of the cells on shortest paths, whose hops from both ends add up to the least sum, the
    first in row order stands for each place.
    """
    with scratch(chains.sparkSession):
        rings = closed.select(*OF, F.lit(True).alias("ring")).distinct()
        every = written(chains.select(*KEYS, "seg").join(rings, OF, "left").select(*KEYS, "seg", F.coalesce("ring", F.lit(False)).alias("ring")), "loop-chains")
        near = moved(every.select(*KEYS, "seg"), NB8).join(every.select(*KEYS, "seg"), [*KEYS, "seg"]).groupBy(*KEYS, "seg").agg(F.count("*").alias("n"))
        tips = every.join(near, [*KEYS, "seg"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        first = written(tips.groupBy(*OF, "ring").agg(F.min(F.struct((~F.col("ring") & (F.col("n") > 1)).alias("inner"), "r", "c")).alias("p")).select(*OF, "ring", "p.r", "p.c"), "loop-starts")
        cut = first.where("ring")
        open_ = written(every.join(cut, [*KEYS, "seg"], "left_anti"), "loop-cut")
        beside = moved(cut.select(*KEYS, "seg"), NB8).join(open_.select(*KEYS, "seg"), [*KEYS, "seg"]).groupBy(*OF).agg(F.min(F.struct("r", "c")).alias("a"), F.max(F.struct("r", "c")).alias("b"))
        beside = written(beside, "loop-sides")
        a = first.where("not ring").select(*KEYS).union(beside.select("site_id", "a.r", "a.c"))
        # Chains do not touch, so one search serves all of them.
        h1 = written(open_.join(geodesic_distance(open_, a, hops=True), KEYS).withColumnRenamed("d", "h1"), "loop-from")
        far = h1.where("not ring").groupBy(*OF).agg(F.min_by(F.struct("r", "c"), F.struct(-F.col("h1"), "r", "c")).alias("b"))
        b = far.select("site_id", "b.r", "b.c").union(beside.select("site_id", "b.r", "b.c"))
        both = h1.join(geodesic_distance(open_, b, hops=True).withColumnRenamed("d", "h2"), KEYS).withColumn("sum", F.col("h1") + F.col("h2"))
        least = both.groupBy(*OF).agg(F.min("sum").alias("least"))
        on = both.join(least, OF).where(F.col("sum") == F.col("least")).groupBy(*OF, "ring", "h1").agg(F.min(F.struct("r", "c")).alias("p"))
        path = on.select(*OF, (F.col("h1") + F.col("ring").cast("int")).cast("long").alias("pos"), "p.r", "p.c")
        return written(path.union(cut.select(*OF, F.lit(0).cast("long"), "r", "c")), "loop-paths", kept=True)


def xs_anchor_loop(paths: DataFrame) -> DataFrame:
    """paths(site_id, seg, pos, r, c) -> (site_id, seg, rm, cm, r1, c1, r2, c2), as of xs_anchor.

    The middle is, of the cells whose distance along the path is within TOLERANCE of the rounded mean distance, the middle one in
    row order. The two points are the first two cells in row order a quarter of the path's cells away from it, or else its ends,
    turned by 90 degrees around the middle. A path of at most SHORT cells turns its end by 90 degrees both ways around its start.
    """
    along = Window.partitionBy(*OF).orderBy("pos")
    step = F.sqrt(F.pow(F.col("r") - F.lag("r").over(along), 2) + F.pow(F.col("c") - F.lag("c").over(along), 2))
    p = paths.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("d", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = p.groupBy(*OF).agg(F.count("*").alias("n"), F.bround(F.avg("d")).alias("mean"), F.min_by(F.struct("r", "c"), "pos").alias("s"), F.max_by(F.struct("r", "c"), "pos").alias("e"))
    near = p.join(whole.select(*OF, "mean"), OF).where(F.abs(F.col("d") - F.col("mean")) <= TOLERANCE)
    rank = F.row_number().over(Window.partitionBy(*OF).orderBy("r", "c"))
    size = F.count("*").over(Window.partitionBy(*OF))
    middle = near.withColumn("rank", rank).withColumn("size", size).where(F.col("rank") == F.floor(F.col("size") / 2) + 1).select(*OF, F.col("r").alias("mr"), F.col("c").alias("mc"), F.col("pos").alias("mpos"))
    off = p.join(middle, OF).join(whole.select(*OF, "n"), OF).where(F.abs(F.col("pos") - F.col("mpos")) == F.bround(F.col("n") / 4)).groupBy(*OF).agg(F.count("*").alias("found"), F.min(F.struct("r", "c")).alias("u"), F.max(F.struct("r", "c")).alias("v"))
    a = whole.join(middle, OF, "left").join(off, OF, "left")
    short, two = F.col("n") <= SHORT, F.coalesce(F.col("found"), F.lit(0)) >= 2
    pick = lambda k: (F.when(short, F.col(f"s.{k}")).otherwise(F.col(f"m{k}")), F.when(short | ~two, F.when(short, F.col(f"e.{k}")).otherwise(F.col(f"s.{k}"))).otherwise(F.col(f"u.{k}")), F.when(two & ~short, F.col(f"v.{k}")).otherwise(F.col(f"e.{k}")))
    (rm, ur, vr), (cm, uc, vc) = pick("r"), pick("c")
    a = a.select(*OF, short.alias("short"), rm.alias("rm"), cm.alias("cm"), ur.alias("ur"), uc.alias("uc"), vr.alias("vr"), vc.alias("vc"))
    sign = F.when(F.col("short"), -1).otherwise(1)
    one = F.col("rm") + (F.col("uc") - F.col("cm")), F.col("cm") - (F.col("ur") - F.col("rm"))
    other = F.col("rm") + sign * (F.col("vc") - F.col("cm")), F.col("cm") - sign * (F.col("vr") - F.col("rm"))
    return a.select(*OF, "rm", "cm", one[0].alias("r1"), one[1].alias("c1"), other[0].alias("r2"), other[1].alias("c2"))
