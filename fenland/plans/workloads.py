"""The three main workloads, end to end over many sites."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, functions as F

from fenland.functions.tables import scratch, written
from fenland.operators import cells as ce, components, edt, loops, network, overland, summary, thin, xsection
from fenland.operators.morph import branch_points, end_points


@dataclass(frozen=True)
class Settings:
    """Parameters of a run. Each is one value for all sites or a table (site_id, value), see settings_of."""

    nrows: int
    ncols: int
    hat: float
    mhws: float
    cth: float
    lzth: float
    hzth: float
    gs: float = 1.0
    nbbreaches: int = 1
    noise: int = 5
    dist: float = 3
    smoothing: int = 1
    hole: int = 5
    small: int = 10
    large: int = 1_000_000
    ordermax: int = 4
    hops: int = 4


#: Sites of which the parameters are broadcast (a few dozen bytes each).
BROADCAST_SITES = 500_000


def settings_of(params: DataFrame) -> Settings:
    """Settings by site from params(site_id, nrows, ncols, hat, ...), one row a site; parameters without a column have their
    default for all sites. They are counted, and broadcast while they are few."""
    p = written(params, "settings")
    send = F.broadcast if p.count() <= BROADCAST_SITES else lambda x: x
    return Settings(**{f.name: send(p.select("site_id", F.col(f.name).alias("value"))) for f in fields(Settings) if f.name in p.columns})


def detected(cells: DataFrame, s: Settings) -> DataFrame:
    """Cells with HAT masked and creek, no shuffle."""
    own = hat_masked(ce.with_values(ce.abs_slope(cells), _cth=s.cth, _lzth=s.lzth, _hzth=s.hzth), s)
    return ce.detect_creek(own, F.col("_cth"), F.col("_lzth"), F.col("_hzth")).drop("_cth", "_lzth", "_hzth")


def hat_masked(cells: DataFrame, s: Settings) -> DataFrame:
    return ce.mask_above_hat(ce.with_values(cells, _hat=s.hat), F.col("_hat")).drop("_hat")


def creek_mask(cells: DataFrame, s: Settings) -> DataFrame:
    """Elevation and slope to the repaired mask."""
    raw = ce.creek_mask(detected(cells, s))
    return components.repair(raw, cells, s.nrows, s.ncols, s.small, s.large, s.smoothing, s.hole, s.small, s.large)


def ordered_network(cells: DataFrame, mask: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """skel, chains, links, segments, orders, lengths, breaches of a mask."""
    skel, breaches = network.outlets(thin.skeletonize(mask), cells, s.nbbreaches, s.nrows, s.ncols)
    skel, breaches = written(skel, "skeleton"), written(breaches, "breaches")
    chains, links, segments = network.segment_graph(skel, cells, breaches)
    orders = written(network.strahler_order(links, segments, s.ordermax), "orders")
    lengths = written(network.segment_lengths(chains, segments, orders), "lengths")
    return {"skel": skel, "breaches": breaches, "chains": chains, "links": links, "segments": segments, "orders": orders, "lengths": lengths}


def sections(cells: DataFrame, mask: DataFrame, net: dict[str, DataFrame], s: Settings) -> DataFrame:
    """Cross-section measures of each chain; connectors and rings have the anchors of loops."""
    return xsection.cross_section(section_anchors(net), mask, cells, s.nrows, s.ncols)


def section_anchors(net: dict[str, DataFrame]) -> DataFrame:
    loop = net["orders"].where("kind in ('connector', 'ring')").select("site_id", "seg")
    plain = net["chains"].join(loop, ["site_id", "seg"], "left_anti")
    anchors = xsection.xs_anchor(xsection.chain_positions(plain, starts(plain)))
    if loop.isEmpty():
        return anchors
    return anchors.union(loop_anchors(net))


def loop_anchors(net: dict[str, DataFrame]) -> DataFrame:
    """The anchors of the chains of connectors and rings."""
    loop = net["orders"].where("kind in ('connector', 'ring')").select("site_id", "seg")
    chains = net["chains"].join(loop, ["site_id", "seg"], "left_semi")
    return loops.xs_anchor_loop(loops.path_cells(chains, net["segments"].where("closed")))


def starts(chains: DataFrame) -> DataFrame:
    """One start cell for each chain: its first tip, or its first cell if it is a loop."""
    from fenland.operators.morph import NB8, moved

    near = moved(chains, NB8).join(chains, [*ce.KEYS, "seg"]).groupBy(*ce.KEYS, "seg").agg(F.count("*").alias("n"))
    tips = chains.join(near, [*ce.KEYS, "seg"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = tips.groupBy("site_id", "seg").agg(F.min(F.struct(F.col("n") > 1, "r", "c")).alias("p"))
    return first.select("site_id", "p.r", "p.c")


def anchors_of(net: dict[str, DataFrame], cells: DataFrame) -> DataFrame:
    """The cells that corrections snap to: branch and end points."""
    return branch_points(net["skel"], cells).union(end_points(net["skel"])).distinct()


def morphometry(cells: DataFrame, s: Settings, corrections: DataFrame | None = None) -> DataFrame:
    """The summary of every site and order; after corrections(site_id, id, r1, c1, r2, c2, new_order) if there are any. A
    corrected path has no cross-sections of its own."""
    with scratch(cells.sparkSession):
        return written(summarised(cells, s, corrections), "morphometry", kept=True)


def summarised(cells: DataFrame, s: Settings, corrections: DataFrame | None) -> DataFrame:
    mask = written(creek_mask(cells, s), "mask")
    net = ordered_network(cells, mask, s)
    named = net["orders"].select("site_id", "seg", "final")
    measures = sections(cells, mask, net, s).join(named, ["site_id", "seg"]).groupBy("site_id", "final").agg(*(F.avg(c).alias(c) for c in ("width", "depth", "area")))
    lengths = net["lengths"]
    if corrections is not None:
        lengths = written(network.corrected_lengths(net["chains"], net["segments"], net["orders"], net["skel"], corrections, anchors_of(net, cells)), "lengths")
    table = lengths.join(measures.withColumnRenamed("final", "seg"), ["site_id", "seg"], "left")
    branches = branch_points(net["skel"], cells)
    angles = network.segment_angles(net["links"], xsection.junction_angles(branches, net["chains"], s.hops), net["skel"], cells, net["breaches"])
    angles = summary.angle_means(angles.join(net["orders"].select("site_id", "seg", "ord"), ["site_id", "seg"]))
    return ce.order_swap(summary.order_summary(table).join(angles, ["site_id", "ord"], "left"), s.ordermax)


def overland_paths(cells: DataFrame, mask: DataFrame, s: Settings) -> DataFrame:
    """Distance to the creek, axis and prism of every site."""
    with scratch(cells.sparkSession):
        hatted = hat_masked(cells, s)
        distance = written(edt.edt(cells, mask), "distance")
        area = ce.land_mask(hatted)
        out = overland.mean_overland_path(distance, area).join(overland.major_axis(area), "site_id", "left")
        out = out.join(overland.marsh_means(hatted, mask, s.hat), "site_id").join(overland.tidal_prism(hatted, s.hat), "site_id")
        return written(out, "overland", kept=True)
