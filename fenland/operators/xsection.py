"""Cross-sections of segments: anchors, profiles along lines, width, depth and area; junction angles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .cells import KEYS, with_values
from .geometry import angle_between, euclid, rasterize_line, wrapped
from .morph import NB8, moved

SHORT = 3


def chain_positions(chains: DataFrame, ends: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(site_id, seg, r, c, pos): hops from the segment's start cell; ends has one start a segment."""
    from .network import geodesic_distance

    # Chains do not touch one another, so one search serves all of them.
    d = geodesic_distance(chains, ends, hops=True, rounds=rounds)
    return chains.join(d, KEYS).select("site_id", "seg", "r", "c", F.col("d").cast("long").alias("pos"))


def xs_anchor(positions: DataFrame) -> DataFrame:
    """(site_id, seg, rm, cm, r1, c1, r2, c2): the middle cell and two points, the cells 0.2 of the length to either side
    turned by 90 degrees around it; a segment of at most 3 hops turns its far end by 90 degrees both ways around its start."""
    p = positions.withColumn("most", F.max("pos").over(Window.partitionBy("site_id", "seg"))).withColumn("mean", F.bround(F.avg("pos").over(Window.partitionBy("site_id", "seg"))))
    reach = F.greatest(F.bround(F.col("most") * 0.2), F.lit(1))
    at = lambda pos: F.min(F.when(F.col("pos") == pos, F.struct("r", "c")))
    # Of several cells at the mean distance (loops have two) the middle one in row order.
    rank = F.row_number().over(Window.partitionBy("site_id", "seg", "pos").orderBy("r", "c"))
    size = F.count("*").over(Window.partitionBy("site_id", "seg", "pos"))
    p = p.withColumn("middle", rank == F.floor(size / 2) + 1)
    a = p.groupBy("site_id", "seg", "most").agg(F.min(F.when((F.col("pos") == F.col("mean")) & F.col("middle"), F.struct("r", "c"))).alias("m"), at(F.col("mean") - reach).alias("u"), at(F.col("mean") + reach).alias("v"), at(F.lit(0)).alias("s"), at(F.col("most")).alias("e"))
    short = F.col("most") <= SHORT
    m, u, v = F.when(short, F.col("s")).otherwise(F.col("m")), F.when(short, F.col("e")).otherwise(F.col("u")), F.col("v")
    a = a.select("site_id", "seg", short.alias("short"), m["r"].alias("rm"), m["c"].alias("cm"), u["r"].alias("ur"), u["c"].alias("uc"), v["r"].alias("vr"), v["c"].alias("vc"))
    turn = lambda r, c, s: (F.col("rm") + s * (c - F.col("cm")), F.col("cm") - s * (r - F.col("rm")))
    one, two, back = turn(F.col("ur"), F.col("uc"), 1), turn(F.col("vr"), F.col("vc"), 1), turn(F.col("ur"), F.col("uc"), -1)
    out = a.select("site_id", "seg", "rm", "cm", one[0].alias("r1"), one[1].alias("c1"), F.when(F.col("short"), back[0]).otherwise(two[0]).alias("r2"), F.when(F.col("short"), back[1]).otherwise(two[1]).alias("c2"))
    return out.where("rm is not null and r1 is not null and r2 is not null")


def half_lines(anchors: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """(site_id, seg, pos, r, c): cells from one anchor through the middle (pos 0) to the other, inside the grid."""
    sides = []
    for i, sign in ((1, -1), (2, 1)):
        line = rasterize_line(anchors.select("site_id", "seg", F.col("rm").alias("r1"), F.col("cm").alias("c1"), F.col(f"r{i}").alias("r2"), F.col(f"c{i}").alias("c2")))
        sides.append(line.withColumn("pos", F.col("pos") * sign))
    both = sides[0].union(sides[1].where("pos > 0"))
    return with_values(both, _nrows=nrows, _ncols=ncols).where("r between 0 and _nrows - 1 and c between 0 and _ncols - 1").select("site_id", "seg", "pos", "r", "c")


def middle_run(points: DataFrame, mask: DataFrame) -> DataFrame:
    """The points of the mask in one run without gaps through pos 0."""
    on = points.join(mask.select(*KEYS), KEYS, "left_semi")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("site_id", "seg").orderBy("pos"))
    on = on.withColumn("run", island)
    mid = on.where("pos = 0").select("site_id", "seg", "run").distinct()
    return on.join(mid, ["site_id", "seg", "run"], "left_semi").select("site_id", "seg", "pos", "r", "c")


def interpolated(profile: DataFrame, by: list[str]) -> DataFrame:
    """profile(by, pos, z) with missing z filled linearly, extrapolated at the ends; one known value is a constant."""
    w = Window.partitionBy(*by).orderBy("pos")
    known = F.when(F.col("z").isNotNull(), F.struct("pos", "z"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*by)
    p = profile.withColumn("lo", F.last(known, True).over(back)).withColumn("hi", F.first(known, True).over(ahead))
    # The two first and the two last known points, for the ends.
    rank = F.when(F.col("z").isNotNull(), F.count("z").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("nth", rank).withColumn("all", F.count("z").over(every))
    pick = lambda n: F.max(F.when(F.col("nth") == n, F.struct("pos", "z"))).over(every)
    p = p.withColumn("f1", pick(1)).withColumn("f2", pick(2)).withColumn("l1", pick(F.col("all"))).withColumn("l2", pick(F.col("all") - 1))
    a = F.when(F.col("lo").isNull(), F.col("f1")).when(F.col("hi").isNull(), F.coalesce("l2", "l1")).otherwise(F.col("lo"))
    b = F.when(F.col("lo").isNull(), F.coalesce("f2", "f1")).when(F.col("hi").isNull(), F.col("l1")).otherwise(F.col("hi"))
    p = p.withColumn("a", a).withColumn("b", b)
    slope = (F.col("b.z") - F.col("a.z")) / F.nullif((F.col("b.pos") - F.col("a.pos")).cast("double"), F.lit(0.0))
    return p.select(*by, "pos", F.coalesce("z", F.col("a.z") + F.coalesce(slope, F.lit(0.0)) * (F.col("pos") - F.col("a.pos"))).alias("z"))


def xs_measures(profile: DataFrame, by: list[str]) -> DataFrame:
    """profile(by, pos, r, c, z) -> width, depth, area, reference_area: end to end, max - min, sum of chord minus z, n times it."""
    first, last = F.min_by(F.struct("pos", "r", "c", "z"), "pos"), F.max_by(F.struct("pos", "r", "c", "z"), "pos")
    e = profile.groupBy(*by).agg(first.alias("p"), last.alias("q"), F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("depth"))
    chord = F.col("p.z") + (F.col("q.z") - F.col("p.z")) * (F.col("pos") - F.col("p.pos")) / F.nullif((F.col("q.pos") - F.col("p.pos")).cast("double"), F.lit(0.0))
    area = profile.select(*by, "pos", "z").join(e, by).groupBy(*by).agg(F.sum(F.coalesce(chord, F.col("z")) - F.col("z")).alias("area"))
    width = euclid(F.col("p.r"), F.col("p.c"), F.col("q.r"), F.col("q.c"))
    return e.select(*by, width.alias("width"), "depth", "n").join(area, by, "left").withColumn("reference_area", F.col("n") * F.col("area")).drop("n")


def cross_section(anchors: DataFrame, mask: DataFrame, cells: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """(site_id, seg, width, depth, area, reference_area): the run of creek cells through the middle, a straight line between
    its ends, elevations along it with gaps filled."""
    run = middle_run(half_lines(anchors, nrows, ncols), mask)
    ends = run.groupBy("site_id", "seg").agg(F.min_by(F.struct("r", "c"), "pos").alias("p"), F.max_by(F.struct("r", "c"), "pos").alias("q"))
    line = rasterize_line(ends.select("site_id", "seg", F.col("p.r").alias("r1"), F.col("p.c").alias("c1"), F.col("q.r").alias("r2"), F.col("q.c").alias("c2")))
    z = line.join(cells.select(*KEYS, "z"), KEYS, "left")
    by = ["site_id", "seg"]
    whole = interpolated(z.select(*by, "pos", "z"), by).join(line, [*by, "pos"])
    return xs_measures(whole, by)


def junction_angles(branches: DataFrame, chains: DataFrame, hops: int) -> DataFrame:
    """(site_id, r, c, angle_raw, angle): the least angle between the chains that leave a branch cell, each taken at the cell
    hops steps along it, or its last one."""
    start = moved(branches.select(*KEYS, F.col("r").alias("br"), F.col("c").alias("bc")), NB8).drop("k").join(chains, KEYS)
    from .network import geodesic_distance

    one = start.select(*KEYS).distinct()
    d = geodesic_distance(chains, one, hops=True)
    along = chains.join(d, KEYS)
    # A chain with both ends at branches is measured from its nearer one.
    far = start.select("site_id", "seg", "br", "bc").distinct().join(along, ["site_id", "seg"]).transform(with_values, _hops=hops).where("d <= _hops - 1")
    far = far.where(F.greatest(F.abs(F.col("r") - F.col("br")), F.abs(F.col("c") - F.col("bc"))) <= F.col("_hops"))
    tip = far.groupBy("site_id", "br", "bc", "seg").agg(F.max_by(F.struct("r", "c"), F.struct("d", -F.col("r"), -F.col("c"))).alias("p"))
    v = tip.select("site_id", "br", "bc", "seg", (F.col("p.r") - F.col("br")).alias("dr"), (F.col("p.c") - F.col("bc")).alias("dc"))
    o = v.select("site_id", "br", "bc", F.col("seg").alias("seg2"), F.col("dr").alias("dr2"), F.col("dc").alias("dc2"))
    pairs = v.join(o, ["site_id", "br", "bc"]).where("seg < seg2").withColumn("angle_raw", angle_between(F.col("dr"), F.col("dc"), F.col("dr2"), F.col("dc2")))
    return pairs.groupBy("site_id", F.col("br").alias("r"), F.col("bc").alias("c")).agg(F.min("angle_raw").alias("angle_raw"), F.min(wrapped(F.col("angle_raw"))).alias("angle"))
