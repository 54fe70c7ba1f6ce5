"""Positions along chains by pointer doubling, the skeleton contracted to its knots, and shortest paths on that graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fenland.functions.tables import scratch, written

from .cells import KEYS
from .components import label
from .morph import NB8, moved, neighbour_count

#: Cells are known by r * STRIDE + c within their site.
STRIDE = 1 << 20


def code(r: str = "r", c: str = "c"):
    return F.col(r) * STRIDE + F.col(c)


def arcs_of(cells: DataFrame) -> DataFrame:
    """(site_id, seg, u, v, w): both directions of each pair of neighbours of one chain, with the length of the step."""
    near = moved(cells.select(*KEYS, "seg", code().alias("u")), NB8).join(cells.select(*KEYS, "seg"), [*KEYS, "seg"])
    return near.select("site_id", "seg", "u", code().alias("v"), F.when(F.col("k").isin(1, 3, 4, 6), F.lit(1.0)).otherwise(F.lit(2**0.5)).alias("w"))


def path_positions(chains: DataFrame, starts: DataFrame, rounds: int = 64) -> DataFrame:
    """(site_id, seg, r, c, pos, d): hops and length from the chain's start to each of its cells.

    chains(site_id, r, c, seg) are simple paths or rings: no cell has more than two neighbours in its chain, others have no row.
    starts(site_id, r, c) are cells of them; a chain without one has no row. Each step from cell to cell points at the step that
    follows; in every round a step takes over the hops, the length and the pointer of the one it points at, so the rounds are the
    logarithm of the longest chain. A step that ends at a start has arrived, one at a chain's other end is lost.
    """
    with scratch(chains.sparkSession):
        begun = chains.select(*KEYS, "seg").join(starts.select(*KEYS).distinct(), KEYS, "left_semi").select("site_id", "seg").distinct()
        cells = chains.select(*KEYS, "seg").join(begun, ["site_id", "seg"], "left_semi")
        arcs = written(arcs_of(cells).withColumn("id", F.monotonically_increasing_id()), "arcs")
        crowded = arcs.groupBy("site_id", "seg", "u").agg(F.count("*").alias("n")).where("n > 2").select("site_id", "seg").distinct()
        arcs = arcs.join(crowded, ["site_id", "seg"], "left_anti")
        first = starts.select("site_id", code().alias("v"), F.lit(True).alias("there")).distinct()
        after = arcs.select("site_id", "seg", F.col("u").alias("v"), F.col("v").alias("then"), F.col("id").alias("next"))
        now = arcs.join(first, ["site_id", "v"], "left").join(after, ["site_id", "seg", "v"], "left").where("next is null or then <> u or there")
        # The way back is no way on; a chain's last step has none.
        now = now.groupBy("id").agg(F.lit(1).cast("long").alias("hops"), F.first("w").alias("d"), F.max("there").alias("there"), F.max(F.when(F.col("there").isNull() & (F.col("then") != F.col("u")), F.col("next"))).alias("next"))
        ends = arcs.join(now, "id", "left").select("id", F.coalesce("hops", F.lit(1)).cast("long").alias("hops"), F.coalesce("d", "w").alias("d"), F.coalesce("there", F.lit(False)).alias("there"), "next")
        now = written(ends, "jumps")
        for _ in range(rounds):
            if now.where("next is not null").isEmpty():
                break
            ahead = now.select(F.col("id").alias("next"), F.col("hops").alias("more"), F.col("d").alias("longer"), F.col("there").alias("arrives"), F.col("next").alias("then"))
            moved_on = now.join(ahead, "next", "left")
            now = written(moved_on.select("id", (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), (F.col("d") + F.coalesce("longer", F.lit(0.0))).alias("d"), F.coalesce("arrives", "there").alias("there"), F.col("then").alias("next")), "jumps")
        else:
            raise RuntimeError("positions have not settled")
        best = arcs.join(now.where("there"), "id").groupBy("site_id", "seg", F.col("u").alias("cell")).agg(F.min("hops").alias("pos"), F.min("d").alias("d"))
        own = cells.join(starts.select(*KEYS).distinct(), KEYS).join(crowded, ["site_id", "seg"], "left_anti").select("site_id", "seg", code().alias("cell"), F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("d"))
        out = best.join(own, ["site_id", "seg", "cell"], "left_anti").select("site_id", "seg", "cell", "pos", "d").union(own)
        return written(out.select("site_id", "seg", F.expr(f"cell div {STRIDE}").alias("r"), (F.col("cell") % STRIDE).alias("c"), "pos", "d"), "positions", kept=True)


def contracted_graph(skel: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges(site_id, u, v, w, seg, lo, hi) in both directions, positions(site_id, seg, r, c, pos, d)) of a skeleton.

    Its vertices are the cells with three neighbours or more (knots), the ends of the chains between them, the first cell of
    each ring, and stops(site_id, r, c). An edge joins two vertices that touch, or two that follow one another on the chain seg,
    whose cells between have the positions lo to hi.
    """
    with scratch(skel.sparkSession):
        s = written(skel.select(*KEYS).distinct(), "contracted-skel")
        knots = written(neighbour_count(s).where("n > 2").select(*KEYS), "knots")
        chains = written(label(s.join(knots, KEYS, "left_anti")).withColumnRenamed("comp", "seg"), "contracted-chains")
        n = chains.join(arcs_of(chains).groupBy("site_id", "seg", F.col("u")).agg(F.count("*").alias("n")).select("site_id", "seg", F.expr(f"u div {STRIDE}").alias("r"), (F.col("u") % STRIDE).alias("c"), "n"), [*KEYS, "seg"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        n = written(n, "contracted-degrees")
        # A path begins at its first end, a ring at its first cell.
        start = n.groupBy("site_id", "seg").agg(F.min(F.struct(F.col("n") > 1, "r", "c")).alias("p")).select("site_id", "p.r", "p.c")
        positions = path_positions(chains, start)
        tips = n.where("n < 2").select(*KEYS).union(start).union(stops.select(*KEYS).join(s, KEYS, "left_semi")).distinct()
        vertices = written(knots.union(tips.join(knots, KEYS, "left_anti")), "vertices")
        touch = moved(vertices.select(*KEYS, code().alias("u")), NB8).join(vertices, KEYS)
        steps = touch.select("site_id", "u", code().alias("v"), F.when(F.col("k").isin(1, 3, 4, 6), F.lit(1.0)).otherwise(F.lit(2**0.5)).alias("w"), F.lit(None).cast("long").alias("seg"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
        # Around a ring distances fall again after its middle: each half is a way of its own, by the cell it began with.
        on = positions.join(vertices, KEYS)
        order = Window.partitionBy("site_id", "seg").orderBy("d", "r", "c")
        follow = on.withColumn("u", F.lag(code()).over(order)).withColumn("from", F.lag("pos").over(order)).withColumn("d0", F.lag("d").over(order)).where("u is not null")
        rings = n.groupBy("site_id", "seg").agg((F.min("n") > 1).alias("ring")).where("ring").select("site_id", "seg")
        one = follow.join(rings, ["site_id", "seg"], "left_anti").select("site_id", "u", code().alias("v"), (F.col("d") - F.col("d0")).alias("w"), "seg", F.col("from").alias("lo"), F.col("pos").alias("hi"))
        both = steps.union(one).union(one.select("site_id", F.col("v").alias("u"), F.col("u").alias("v"), "w", "seg", "lo", "hi"))
        best = both.groupBy("site_id", "u", "v").agg(F.min_by(F.struct("w", "seg", "lo", "hi"), F.struct("w", "seg", "lo")).alias("e")).select("site_id", "u", "v", "e.*")
        return written(best, "contracted-edges", kept=True), written(positions, "contracted-positions", kept=True)


def shortest_paths(edges: DataFrame, ends: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(own, site_id, u, v, length): the edges, from u to v, of a shortest path for each of ends(own, site_id, a, b) from vertex a
    to b, and its length; none where no path joins them, and one row with null u where a is b.

    All searches go on together, an edge a round; a vertex farther than the end found so far is not followed. Of equal ways the
    one from the smallest predecessor counts. The path is tracked back from b by predecessors.
    """
    with scratch(edges.sparkSession):
        ends = written(ends.select("own", "site_id", "a", "b"), "path-ends")
        e = written(edges.select("site_id", F.col("u").alias("x"), F.col("v").alias("y"), "w").join(ends.select("site_id").distinct(), "site_id", "left_semi"), "path-edges")
        best = written(ends.select("own", "site_id", F.col("a").alias("x"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("before"), F.lit(True).alias("new")), "reached")
        for _ in range(rounds):
            arrived = best.join(ends, ["own", "site_id"]).where("x = b").select("own", F.col("d").alias("most"))
            go = best.where("new").join(e, ["site_id", "x"]).select("own", "site_id", F.col("y").alias("x"), (F.col("d") + F.col("w")).alias("d"), F.col("x").alias("before"))
            go = go.join(arrived, "own", "left").where("most is null or d < most - 1e-12").select("own", "site_id", "x", "d", "before", F.lit(True).alias("new"))
            old = best.withColumn("new", F.lit(False))
            best = written(old.union(go).groupBy("own", "site_id", "x").agg(F.min(F.struct("d", F.col("before"), "new")).alias("m")).select("own", "site_id", "x", "m.*"), "reached")
            if best.where("new").isEmpty():
                break
        else:
            raise RuntimeError("paths have not settled")
        found = best.join(ends, ["own", "site_id"]).where("x = b").select("own", "site_id", "x", "before", F.col("d").alias("length"))
        out, now = None, written(found, "tracked")
        for _ in range(rounds):
            part = now.select("own", "site_id", F.col("before").alias("u"), F.col("x").alias("v"), "length")
            out = part if out is None else out.union(part.where("u is not null"))
            now = written(now.where("before is not null").select("own", "site_id", F.col("before").alias("x"), "length").join(best.select("own", "site_id", "x", "before"), ["own", "site_id", "x"]).select("own", "site_id", "x", "before", "length"), "tracked")
            if now.where("before is not null").isEmpty():
                return written(out, "paths", kept=True)
        raise RuntimeError("a path goes round")


def path_cells_of(paths: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(own, site_id, r, c): the cells of paths as of shortest_paths, both ends included."""
    ends = paths.select("own", "site_id", F.explode(F.array("u", "v")).alias("cell")).where("cell is not null")
    ends = ends.select("own", "site_id", F.expr(f"cell div {STRIDE}").alias("r"), (F.col("cell") % STRIDE).alias("c"))
    ways = paths.where("u is not null").join(edges.where("seg is not null").select("site_id", "u", "v", "seg", "lo", "hi"), ["site_id", "u", "v"])
    inner = ways.join(positions.select("site_id", "seg", "r", "c", "pos"), ["site_id", "seg"]).where("pos between lo and hi").select("own", "site_id", "r", "c")
    return ends.union(inner).distinct()
