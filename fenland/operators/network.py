"""The skeleton as a network: contraction, Strahler orders, lengths, outlets, painting, distances, corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from fenland.functions.helpers import TILE, relax_tile
from fenland.functions.tables import replaced, scratch, written

from .cells import KEYS, with_values
from .components import label
from .geometry import euclid, rasterize_line, sinuosity
from .graph import connected_components
from .morph import NB8, border_mask, branch_points, bwmorph_diag, dilate, moved
from .thin import beside, framed
from .paths import STRIDE, contracted_graph, path_cells_of, shortest_paths

#: Outlets of which the list is broadcast (40 bytes each).
BROADCAST_OUTLETS = 500_000


def step_length():
    """Length of the neighbour offset k: 1 or sqrt 2."""
    return F.when(F.col("k").isin(1, 3, 4, 6), F.lit(1.0)).otherwise(F.lit(2**0.5))


def skeleton_edges(skel: DataFrame, hops: bool = False) -> DataFrame:
    """(site_id, r, c, r2, c2, w) once for each pair of 8-neighbours, the first in row order first."""
    near = moved(skel.select(*KEYS, F.col("r").alias("r0"), F.col("c").alias("c0")), NB8)
    pairs = near.join(skel.select(*KEYS), KEYS).where("r0 < r or (r0 = r and c0 < c)")
    return pairs.select("site_id", F.col("r0").alias("r"), F.col("c0").alias("c"), F.col("r").alias("r2"), F.col("c").alias("c2"), (F.lit(1.0) if hops else step_length()).alias("w"))


def geodesic_distance(mask: DataFrame, seeds: DataFrame, hops: bool = False, rounds: int = 100_000, tile: int = TILE) -> DataFrame:
    """(site_id, r, c, d): least length of a path of 8-neighbours inside the mask from the nearest seed; unreached cells are left out.

    Each tile settles its own cells, then tiles exchange a frame of one cell, until no distance changes: the rounds follow
    the tiles that a path crosses, not its cells. Only tiles that have changed, or beside one that has, go into the next round.
    """
    tiles = ["site_id", "tr", "tc"]
    own = [F.expr(f"r div {tile}").alias("tr"), F.expr(f"c div {tile}").alias("tc")]
    zero = seeds.select(*KEYS).distinct().withColumn("d", F.lit(0.0))
    now = written(mask.select(*(F.col(k).cast("long") for k in KEYS)).distinct().join(zero, KEYS, "left"), "geo")
    active = None
    for _ in range(rounds):
        spread = framed(now.select(*KEYS, "d"), tile, 1)
        if active is not None:
            spread = spread.join(active, tiles, "left_semi")
        after = spread.groupBy(*tiles).applyInPandas(lambda f: relax_tile(f, tile, hops), "site_id long, r long, c long, d double, changed boolean")
        if active is not None:
            after = after.union(now.select("*", *own).join(active, tiles, "left_anti").select(*KEYS, "d", F.lit(False)))
        now = replaced(after, "geo", now)
        changed = now.where("changed").select("site_id", *own)
        n = changed.count()
        if not n:
            return now.where("d is not null").select(*KEYS, "d")
        active = beside(changed, n)
    raise RuntimeError("distances have not settled")


def outlets(skel: DataFrame, cells: DataFrame, n: int, nrows: int, ncols: int) -> tuple[DataFrame, DataFrame]:
    """The n lowest skeleton cells of each site joined to the nearest border cell by a line: (skeleton with lines, breaches)."""
    order = Window.partitionBy("site_id").orderBy(F.col("z").asc_nulls_last(), "r", "c")
    low = skel.join(cells.select(*KEYS, "z"), KEYS, "left").withColumn("rank", F.row_number().over(order)).transform(with_values, _n=n).where("rank <= _n")
    border = border_mask(cells.where("z is not null"), nrows, ncols).select("site_id", F.col("r").alias("r2"), F.col("c").alias("c2"))
    low = written(low, "lowest")
    few = F.broadcast if low.count() <= BROADCAST_OUTLETS else lambda x: x
    near = border.join(few(low.select("site_id", F.col("r").alias("r1"), F.col("c").alias("c1"), "rank")), "site_id")
    best = near.groupBy("site_id", "rank", "r1", "c1").agg(F.min_by(F.struct("r2", "c2"), F.struct(euclid(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2")), "r2", "c2")).alias("p")).select("site_id", "rank", "r1", "c1", "p.*")
    lines = rasterize_line(best, ties_down=False).select(*KEYS)
    return skel.select(*KEYS).union(lines).distinct(), best.select("site_id", F.col("r2").alias("r"), F.col("c2").alias("c")).distinct()


def segment_graph(skel: DataFrame, cells: DataFrame, breaches: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains (site_id, r, c, seg), links (site_id, seg, node, outlet, w, n_ends) and segments (site_id, seg, len, n_cells,
    closed, n_ends).

    Chains are the components of the skeleton without branch and outlet cells; nodes the components of those cells. A
    segment's length is that of its steps and, once a node, of its shortest link to it. n_ends are the places where a chain
    touches a node, or all its nodes; closed chains are rings by themselves.
    """
    s = written(skel.select(*KEYS).distinct(), "skel")
    nodes = branch_points(s, cells)
    if breaches is not None:
        nodes = nodes.union(breaches.join(s, KEYS, "left_semi").select(*KEYS)).distinct()
    nodes = written(nodes, "nodes")
    chains = written(label(s.join(nodes, KEYS, "left_anti")).withColumnRenamed("comp", "seg"), "chains")
    groups = label(nodes).withColumnRenamed("comp", "node")
    if breaches is not None:
        out = groups.join(breaches.select(*KEYS), KEYS, "left_semi").select("site_id", "node").distinct().withColumn("outlet", F.lit(True))
        groups = groups.join(out, ["site_id", "node"], "left").withColumn("outlet", F.coalesce("outlet", F.lit(False)))
    else:
        groups = groups.withColumn("outlet", F.lit(False))
    touch = moved(chains.select(*KEYS, "seg", F.col("r").alias("r0"), F.col("c").alias("c0")), NB8).join(groups, KEYS)
    links = touch.groupBy("site_id", "seg", "node").agg(F.max("outlet").alias("outlet"), F.min(step_length()).alias("w"))
    places = euler_number(touch.select("site_id", "seg", "node", F.col("r0").alias("r"), F.col("c0").alias("c")).distinct(), ["site_id", "seg", "node"])
    links = links.join(places.withColumnRenamed("euler", "n_ends"), ["site_id", "seg", "node"])
    inner = skeleton_edges(chains).join(chains, KEYS).groupBy("site_id", "seg").agg(F.sum("w").alias("own"))
    size = chains.groupBy("site_id", "seg").agg(F.count("*").alias("n_cells")).join(euler_number(chains, ["site_id", "seg"]), ["site_id", "seg"])
    links = written(links, "links")
    ends = links.groupBy("site_id", "seg").agg(F.sum("w").alias("out"), F.sum("n_ends").alias("n_ends"))
    segs = size.join(inner, ["site_id", "seg"], "left").join(ends, ["site_id", "seg"], "left").select("site_id", "seg", (F.coalesce("own", F.lit(0.0)) + F.coalesce("out", F.lit(0.0))).alias("len"), "n_cells", (F.col("euler") <= 0).alias("closed"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"))
    return chains, links, written(segs, "segments")


def euler_number(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, euler): pieces minus rings of each group's cells, 8-connected, from the counts of its 2 x 2 windows."""
    windows = moved(cells.select(*by, *(k for k in KEYS if k not in by)), [(0, 0), (0, -1), (-1, 0), (-1, -1)])
    code = windows.groupBy(*by, *(k for k in KEYS if k not in by)).agg(F.sum(F.expr("shiftleft(1, k)")).alias("code"))
    weight = F.when(F.bit_count("code") == 1, 1).when(F.bit_count("code") == 3, -1).when(F.col("code").isin(6, 9), -2).otherwise(0)
    return code.groupBy(*by).agg((F.sum(weight) / 4).cast("long").alias("euler"))


def peeled(alive: DataFrame, links: DataFrame, first: int, rounds: int) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """alive(site_id, seg, final, closed) and links(site_id, final, node, held, n_ends) -> (peeled segments with their round and
    the ends that a node held, what is left of alive, of links). Each round takes the segments with a free end; chains that then
    meet two by two at a node are one, of the least name."""
    done = None
    for i in range(first, first + rounds):
        whole = alive.groupBy("site_id", "final").agg(F.max("closed").alias("closed"))
        deg = whole.join(links, ["site_id", "final"], "left").groupBy("site_id", "final", "closed").agg(F.coalesce(F.sum("n_ends"), F.lit(0)).alias("n_held"))
        leaves = written(deg.where("n_held <= 1 and not closed").select("site_id", "final", "n_held"), "leaves")
        if leaves.isEmpty():
            return done, alive, links
        now = alive.join(leaves, ["site_id", "final"]).select("site_id", "seg", "final", F.lit(i).alias("round"), "n_held")
        done = written(now if done is None else done.union(now), "ordered")
        alive = written(alive.join(leaves, ["site_id", "final"], "left_anti"), "alive")
        links = links.join(leaves, ["site_id", "final"], "left_anti")
        meet = links.groupBy("site_id", "node").agg(F.sum("n_ends").alias("n"), F.max("held").alias("held"), F.min("final").alias("p"), F.max("final").alias("q"))
        meet = written(meet.where("not held and n <= 2 and (n < 2 or p <> q)"), "meet")
        ids = written(alive.select("site_id", "final").distinct().withColumn("id", F.monotonically_increasing_id()), "alive-ids")
        two = meet.where("n = 2").join(ids.select("site_id", F.col("final").alias("p"), F.col("id").alias("a")), ["site_id", "p"]).join(ids.select("site_id", F.col("final").alias("q"), F.col("id").alias("b")), ["site_id", "q"])
        comp = connected_components(two.select("a", "b"))
        merged = ids.join(comp, ids["id"] == comp["node"]).select("site_id", "final", "comp")
        named = merged.join(merged.groupBy("site_id", "comp").agg(F.min("final").alias("to")), ["site_id", "comp"]).select("site_id", "final", "to")
        named = written(named, "merged")
        links = links.join(meet, ["site_id", "node"], "left_anti").join(named, ["site_id", "final"], "left").select("site_id", F.coalesce("to", "final").alias("final"), "node", "held", "n_ends")
        links = written(links.groupBy("site_id", "final", "node", "held").agg(F.sum("n_ends").alias("n_ends")), "alive-links")
        alive = written(alive.join(named, ["site_id", "final"], "left").select("site_id", "seg", F.coalesce("to", "final").alias("final"), "closed"), "alive")
    raise RuntimeError(f"segments with free ends are left after {rounds} rounds")


def strahler_order(links: DataFrame, segments: DataFrame, ordermax: int, rounds: int = 1000) -> DataFrame:
    """orders(site_id, seg, ord, final, kind): segments that have a free end are order i and are peeled; chains that then meet
    two by two are one; what has no free end at last has the order ordermax.

    kind is "leaf" for a segment between a free end and a node, "isolated" for one between two free ends; a single cell without
    neighbours has no row. Of what is left, segments that come free when outlets are ends are a "trunk", those that begin and
    end at one node or are closed a "ring", the others a "connector" of two nodes. final is the merged segment that seg was
    peeled with, the least of its segments. Only the contracted tables loop.
    """
    with scratch(segments.sparkSession):
        alone = links.select("site_id", "seg").distinct()
        kept = segments.where("n_cells > 1 or closed").unionByName(segments.where("n_cells = 1 and not closed").join(alone, ["site_id", "seg"], "left_semi"))
        alive = written(kept.select("site_id", "seg", F.col("seg").alias("final"), "closed"), "alive")
        # A ring holds its node twice, however it touches it.
        rings = segments.where("closed").select("site_id", "seg", F.lit(2).alias("twice"))
        held = links.join(rings, ["site_id", "seg"], "left").select("site_id", F.col("seg").alias("final"), "node", F.col("outlet").alias("held"), F.coalesce("twice", "n_ends").cast("long").alias("n_ends"))
        leaves, alive, left = peeled(alive, written(held, "alive-links"), 1, rounds)
        trunks, alive, left = peeled(alive, left.where("not held"), 1, rounds)
        out = []
        if leaves is not None:
            out.append(leaves.select("site_id", "seg", F.col("round").alias("ord"), "final", F.when(F.col("n_held") == 0, "isolated").otherwise("leaf").alias("kind")))
        if trunks is not None:
            out.append(trunks.select("site_id", "seg", F.lit(None).cast("int").alias("ord"), "final", F.lit("trunk").alias("kind")))
        same = left.groupBy("site_id", "final").agg((F.count("*") == 1).alias("one"))
        whole = alive.groupBy("site_id", "final").agg(F.max("closed").alias("closed")).join(same, ["site_id", "final"], "left")
        kinds = whole.select("site_id", "final", F.when(F.col("closed") | F.coalesce("one", F.lit(True)), "ring").otherwise("connector").alias("kind"))
        out.append(alive.join(kinds, ["site_id", "final"]).select("site_id", "seg", F.lit(None).cast("int").alias("ord"), "final", "kind"))
        every = with_values(reduce(DataFrame.union, out), _most=ordermax).withColumn("ord", F.least("ord", F.col("_most").cast("int")))
        return written(every.select("site_id", "seg", "ord", "final", "kind"), "orders", kept=True)


def segment_lengths(chains: DataFrame, segments: DataFrame, orders: DataFrame) -> DataFrame:
    """(site_id, ord, seg_id, seg, kind, sinuous_len, straight_len, sinuosity): merged segments, numbered in their order by first cell.

    The straight length joins the two cells of a segment that are farthest along its ends: its chain ends. A ring's length is
    the number of its cells, with one for each node on it, and its straight length null.
    """
    cells = F.col("n_cells") + F.when(F.col("closed"), 0).otherwise(F.col("n_ends") / 2)
    size = F.when(F.col("kind") == "ring", cells).otherwise(F.col("len"))
    total = segments.join(orders, ["site_id", "seg"]).groupBy("site_id", "final", "ord", "kind").agg(F.sum(size).alias("sinuous_len"))
    whole = written(chains.join(orders.select("site_id", "seg", "final"), ["site_id", "seg"]), "whole")
    degree = moved(whole.select(*KEYS, "final"), NB8).join(whole.select(*KEYS, "final"), [*KEYS, "final"]).groupBy(*KEYS, "final").agg(F.count("*").alias("n"))
    tips = whole.join(degree, [*KEYS, "final"], "left").where(F.coalesce("n", F.lit(0)) <= 1)
    ends = tips.groupBy("site_id", "final").agg(F.min(F.struct("r", "c")).alias("p"), F.max(F.struct("r", "c")).alias("q"))
    rings = orders.where("kind = 'ring'").select("site_id", "final").distinct()
    straight = ends.join(rings, ["site_id", "final"], "left_anti").select("site_id", "final", euclid(F.col("p.r"), F.col("p.c"), F.col("q.r"), F.col("q.c")).alias("straight_len"))
    out = total.join(straight, ["site_id", "final"], "left").withColumn("sinuosity", sinuosity(F.col("sinuous_len"), F.col("straight_len")))
    return out.withColumn("seg_id", F.row_number().over(Window.partitionBy("site_id", "ord").orderBy("final"))).withColumnRenamed("final", "seg")


def paint_orders(chains: DataFrame, orders: DataFrame, grid: DataFrame) -> DataFrame:
    """order_cells(site_id, r, c, ord): each order's cells with diagonal fills, thickened by as many cells; later orders cover."""
    cells = written(chains.join(orders.select("site_id", "seg", "ord"), ["site_id", "seg"]).select(*KEYS, "ord"), "painted")
    parts = None
    for i in sorted(x[0] for x in cells.select("ord").distinct().collect()):
        part = dilate(bwmorph_diag(cells.where(F.col("ord") == i)), i).withColumn("ord", F.lit(i))
        parts = part if parts is None else parts.union(part)
    if parts is None:
        return cells
    return written(parts.groupBy(*KEYS).agg(F.max("ord").alias("ord")).join(grid.select(*KEYS), KEYS, "left_semi"), "order-cells")


def snap(points: DataFrame, anchors: DataFrame, square: int = 8) -> DataFrame:
    """points(site_id, id, r, c) -> the nearest anchor cell (r2, c2) of the site, first of equal ones.

    Points look for anchors in their square of the grid and the eight around it. An anchor within a square's side is the
    nearest; points without one look again with squares four times as wide, until a square holds the grid.
    """
    a = written(anchors.select("site_id", F.col("r").alias("r2"), F.col("c").alias("c2")).distinct(), "anchors")
    left = written(points.select("site_id", "id", "r", "c").join(a.select("site_id").distinct(), "site_id", "left_semi"), "points")
    most = [x or 0 for x in left.agg(F.max(F.greatest(F.abs("r"), F.abs("c")))).first()] + [x or 0 for x in a.agg(F.max(F.greatest(F.abs("r2"), F.abs("c2")))).first()]
    out = None
    while True:
        of = lambda r, c: (F.floor(r / square).alias("tr"), F.floor(c / square).alias("tc"))
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        near = left.select("*", *of(F.col("r"), F.col("c"))).select("*", around.alias("o")).withColumns({"tr": F.col("tr") + F.col("o.i"), "tc": F.col("tc") + F.col("o.j")}).drop("o")
        far = euclid(F.col("r"), F.col("c"), F.col("r2"), F.col("c2"))
        best = near.join(a.select("*", *of(F.col("r2"), F.col("c2"))), ["site_id", "tr", "tc"]).groupBy("site_id", "id", "r", "c").agg(F.min_by(F.struct("r2", "c2"), F.struct(far, "r2", "c2")).alias("p"), F.min(far).alias("far"))
        last = square > 2 * max(most)
        found = best if last else best.where(F.col("far") <= square)
        found = written(found.select("site_id", "id", "r", "c", "p.*"), "snapped")
        out = found if out is None else out.union(found)
        if last:
            return out
        left = written(left.join(found.select("site_id", "id", "r", "c"), ["site_id", "id", "r", "c"], "left_anti"), "points")
        if left.isEmpty():
            return out
        square *= 4


def correction_paths(skel: DataFrame, corrections: DataFrame, anchors: DataFrame) -> DataFrame:
    """(site_id, id, new_order, r, c, length, straight): the cells of the shortest path along the skeleton between the snapped
    ends of each of corrections(site_id, id, r1, c1, r2, c2, new_order); none where no path joins them.

    The skeleton is contracted once for all corrections; each is a search on the contracted graph of its site.
    """
    with scratch(skel.sparkSession):
        each = written(corrections.select("site_id", "id", "new_order", F.explode(F.array(*(F.struct(F.lit(e).alias("end"), F.col(f"r{e}").alias("r"), F.col(f"c{e}").alias("c")) for e in (1, 2)))).alias("p")).select("site_id", "id", "new_order", "p.*").withColumn("own", F.monotonically_increasing_id()), "corrections")
        at = snap(each.select("site_id", F.col("own").alias("id"), "r", "c"), anchors).select(F.col("id").alias("own"), F.col("r2").alias("r"), F.col("c2").alias("c"))
        at = written(each.select("own", "site_id", "id", "new_order", "end").join(at, "own"), "snapped-ends")
        edges, positions = contracted_graph(skel, at)
        ends = at.groupBy("site_id", "id", "new_order").agg(F.min("own").alias("own"), *(F.max(F.when(F.col("end") == e, F.col(k))).alias(f"{k}{e}") for e in (1, 2) for k in "rc"))
        ends = written(ends, "correction-ends")
        paths = shortest_paths(edges, ends.select("own", "site_id", (F.col("r1") * STRIDE + F.col("c1")).alias("a"), (F.col("r2") * STRIDE + F.col("c2")).alias("b")))
        length = paths.groupBy("own").agg(F.max("length").alias("length"))
        of = ends.select("own", "id", "new_order", euclid(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2")).alias("straight")).join(length, "own")
        return written(path_cells_of(paths, edges, positions).join(of, "own").select("site_id", "id", "new_order", "r", "c", "length", "straight"), "correction-paths", kept=True)


def apply_corrections(orders_cells: DataFrame, skel: DataFrame, corrections: DataFrame, anchors: DataFrame) -> DataFrame:
    """order cells with the orders of corrections(site_id, id, r1, c1, r2, c2, new_order) on the shortest path between their
    snapped ends: the cells whose distances to both ends add up to the least sum. Later ids win."""
    path = correction_paths(skel, corrections, anchors).groupBy(*KEYS).agg(F.max_by("new_order", "id").alias("new_order"))
    return written(orders_cells.select(*KEYS, "ord").join(path, KEYS, "full").select(*KEYS, F.coalesce("new_order", "ord").alias("ord")), "corrected-cells")


def corrected_segments(skel: DataFrame, corrections: DataFrame, anchors: DataFrame) -> DataFrame:
    """(site_id, id, ord, sinuous_len, straight_len, sinuosity): the corrected paths measured again as segments of their new
    order. A path without length has no sinuosity."""
    paths = correction_paths(skel, corrections, anchors).select("site_id", "id", F.col("new_order").alias("ord"), F.col("length").alias("sinuous_len"), F.col("straight").alias("straight_len")).distinct()
    return paths.withColumn("sinuosity", sinuosity(F.col("sinuous_len"), F.col("straight_len")))


def corrected_lengths(chains: DataFrame, segments: DataFrame, orders: DataFrame, skel: DataFrame, corrections: DataFrame, anchors: DataFrame) -> DataFrame:
    """segment_lengths after corrections: their paths are segments of their own (kind "corrected", seg -1 - id), and what is left
    of the segments they go over is measured by its share of cells, so that no length counts twice. Where paths share cells each
    counts in full, as they are segments of their own."""
    paths = written(correction_paths(skel, corrections, anchors), "paths-applied")
    rest = written(chains.join(paths.select(*KEYS).distinct(), KEYS, "left_anti"), "chains-left")
    left = rest.groupBy("site_id", "seg").agg(F.count("*").alias("n_left"))
    segs = segments.join(left, ["site_id", "seg"]).withColumn("len", F.col("len") * F.col("n_left") / F.col("n_cells")).withColumn("n_cells", F.col("n_left")).drop("n_left")
    old = segment_lengths(rest, segs, orders.join(left.select("site_id", "seg"), ["site_id", "seg"], "left_semi")).drop("seg_id")
    new = paths.select("site_id", (-1 - F.col("id")).cast("long").alias("seg"), F.col("new_order").alias("ord"), F.lit("corrected").alias("kind"), F.col("length").alias("sinuous_len"), F.col("straight").alias("straight_len")).distinct()
    new = new.withColumn("sinuosity", sinuosity(F.col("sinuous_len"), F.col("straight_len")))
    return old.unionByName(new).withColumn("seg_id", F.row_number().over(Window.partitionBy("site_id", "ord").orderBy("seg")))


def branch_index(links: DataFrame, ncols: int, stride: int = 1 << 20) -> DataFrame:
    """(site_id, seg, branch_idx): the row-major index of the first cell of the branch that a segment ends at: its nearest one,
    the first of equally near ones. Segments without a branch have no row."""
    at = links.groupBy("site_id", "seg").agg(F.min_by("node", F.struct("w", "node")).alias("node"))
    return at.select("site_id", "seg", F.expr(f"(node div {stride}) * {ncols} + node % {stride}").alias("branch_idx"))


def segment_angles(links: DataFrame, angles: DataFrame, skel: DataFrame, cells: DataFrame, breaches: DataFrame | None = None) -> DataFrame:
    """(site_id, seg, angle_raw, angle): the least junction angle of the cells of the branch that the segment ends at (the one
    of branch_index), NULL if none was measured there."""
    nodes = branch_points(skel, cells)
    if breaches is not None:
        nodes = nodes.union(breaches.join(skel, KEYS, "left_semi").select(*KEYS)).distinct()
    groups = label(nodes).withColumnRenamed("comp", "node")
    least = groups.join(angles, KEYS).groupBy("site_id", "node").agg(F.min("angle_raw").alias("angle_raw"), F.min("angle").alias("angle"))
    at = links.groupBy("site_id", "seg").agg(F.min_by("node", F.struct("w", "node")).alias("node"))
    return at.join(least, ["site_id", "node"], "left").select("site_id", "seg", "angle_raw", "angle")
