"""The registered queries of the library's operators, over the raster that the orders table holds, and their SQL."""

from __future__ import annotations

import re as re_
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fenland.operators import cells as ce, components as co, edt as ed, geometry as ge, hypsometry as hy, loops as lo, morph as mo, network as ne, overland as ov, paths as pa, reconnect as re, summary as su, thin as th, xsection as xs
from fenland.sources.fixtures import CELLS, COLS, PARAMS as P, ROWS, grids_of, orders_grid, params_of
from fenland.functions.tables import new_folder, written
from fenland.sources import grids as gr, ranges as rg, stages as st

from .workloads import Settings, creek_mask, detected, morphometry, ordered_network, overland_paths, sections

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = Settings(ROWS, COLS, **P)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = f"""WITH RECURSIVE cells AS ({CELLS.format(div="//")}),
hatted AS (SELECT site_id, r, c, CASE WHEN z <= {P['hat']} THEN z END AS z, CASE WHEN z <= {P['hat']} THEN slope END AS slope FROM cells),
zones AS (SELECT *, CASE WHEN z IS NULL THEN 'nodata' WHEN NOT coalesce(slope < {P['cth']}, false) AND z < {P['hzth']} THEN 'outer'
                         WHEN coalesce(slope < {P['cth']}, false) AND z <= {P['lzth']} THEN 'inner' ELSE 'marsh' END AS zone FROM hatted),
mask AS (SELECT site_id, r, c FROM zones WHERE zone IN ('inner', 'outer') AND z <> 0),
grid AS (SELECT site_id, r, c FROM cells),
nb AS (SELECT * FROM (VALUES (-1,-1,1),(-1,0,2),(-1,1,4),(0,-1,8),(0,1,16),(1,-1,32),(1,0,64),(1,1,128)) t(dr, dc, bit))"""
CODES = """, codes AS (SELECT site_id, r, c, CAST(sum(bit) AS BIGINT) AS code, max(own) = 1 AS inside FROM (
  SELECT site_id, r - dr AS r, c - dc AS c, bit, 0 AS own FROM {mask}, nb UNION ALL SELECT site_id, r, c, 0, 1 FROM {mask}) x GROUP BY ALL)"""
LABELS = """, seeds AS (SELECT site_id, r, c FROM {mask} m WHERE NOT EXISTS (SELECT 1 FROM {mask} n WHERE n.site_id = m.site_id
                AND ({first}))),
reach AS (SELECT site_id, r AS r0, c AS c0, r, c FROM seeds UNION
          SELECT a.site_id, r0, c0, m.r, m.c FROM reach a JOIN {mask} m ON m.site_id = a.site_id AND {near}),
labels AS (SELECT site_id, r, c, min(r0 * 1048576 + c0) AS comp FROM reach GROUP BY ALL)"""
EIGHT = {"first": "n.r = m.r AND n.c = m.c - 1 OR n.r = m.r - 1 AND n.c BETWEEN m.c - 1 AND m.c + 1", "near": "m.r BETWEEN a.r - 1 AND a.r + 1 AND m.c BETWEEN a.c - 1 AND a.c + 1"}
FOUR = {"first": "n.r = m.r AND n.c = m.c - 1 OR n.r = m.r - 1 AND n.c = m.c", "near": "abs(m.r - a.r) + abs(m.c - a.c) = 1"}


def labels_sql(mask: str, how: dict[str, str]) -> str:
    return LABELS.format(mask=mask, **how)


def query(sql: str | None = None, base: str = BASE):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = base + " " + sql
        return f

    return put


def raw_mask(spark: SparkSession, d: str) -> DataFrame:
    return ce.creek_mask(detected(orders_grid(spark, d), SETTINGS))


def hatted(spark: SparkSession, d: str) -> DataFrame:
    return ce.mask_above_hat(orders_grid(spark, d), P["hat"])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


@query(f"""SELECT site_id, r, c, z, slope, c * {P['gs']}::DOUBLE AS x, {P['gs']}::DOUBLE * ({ROWS} - 1 - r) AS y FROM cells""")
def p1_with_xy(spark, d):
    cells = orders_grid(spark, d)
    return ce.with_xy(cells, grids_of(cells))


@query("SELECT site_id, r, c, z FROM cells WHERE r < 40 AND c < 90")
def p2_crop_to_common(spark, d):
    cells = orders_grid(spark, d)
    return ce.crop_to_common(cells.select("site_id", "r", "c", "z"), grids_of(cells).withColumn("nrows", F.lit(40)).withColumn("ncols", F.lit(90)))


@query("SELECT * FROM hatted")
def p3_mask_above_hat(spark, d):
    return hatted(spark, d)


@query("SELECT site_id, r, c, z, abs(-slope) AS slope FROM cells")
def p4_abs_slope(spark, d):
    return ce.abs_slope(orders_grid(spark, d).withColumn("slope", -F.col("slope")))


@query("SELECT site_id, r // 2 AS r, c // 2 AS c, z, slope FROM cells WHERE r % 2 = 0 AND c % 2 = 0")
def p5_resample_stride(spark, d):
    return ce.resample_stride(orders_grid(spark, d), 2)


@query("SELECT site_id, r, c, z, slope, CASE WHEN zone IN ('inner', 'outer') AND z <> 0 THEN z END AS creek FROM zones")
def p6_detect_creek(spark, d):
    return detected(orders_grid(spark, d), SETTINGS)


@query("SELECT site_id, zone, count(*) AS n FROM zones GROUP BY ALL")
def p7_zone_label(spark, d):
    return ce.zone_label(hatted(spark, d), P["cth"], P["lzth"], P["hzth"]).groupBy("site_id", "zone").agg(F.count("*").alias("n"))


@query("SELECT * FROM mask")
def p8_creek_mask(spark, d):
    return raw_mask(spark, d)


@query("SELECT site_id, r, c FROM hatted WHERE z IS NOT NULL")
def p9_land_mask(spark, d):
    return ce.land_mask(hatted(spark, d))


@query(f"SELECT site_id, r, c FROM cells WHERE z >= {P['mhws']}")
def p10_above_level_mask(spark, d):
    return ce.above_level_mask(orders_grid(spark, d), P["mhws"])


FIT = """, fit AS (SELECT site_id, avg(z) AS mz, avg(c + 1) AS mx, avg(r + 1) AS my, covar_pop(z, c) AS cxz, covar_pop(z, r) AS cyz, var_pop(c) AS cxx, var_pop(r) AS cyy, covar_pop(c, r) AS cxy
  FROM cells WHERE z IS NOT NULL GROUP BY site_id),
plane AS (SELECT site_id, (cxz * cyy - cyz * cxy) / nullif(cxx * cyy - cxy * cxy, 0) AS a, (cyz * cxx - cxz * cxy) / nullif(cxx * cyy - cxy * cxy, 0) AS b, mz, mx, my FROM fit)"""


@query(FIT + " SELECT site_id, round(a, 6) AS a, round(b, 6) AS b, round(mz - a * mx - b * my, 6) AS c0, round(mz, 6) AS mean_z FROM plane")
def a2_fit_plane(spark, d):
    return rounded(ce.fit_plane(orders_grid(spark, d)))


@query(FIT + " SELECT site_id, r, c, round(z - (a * (c + 1) + b * (r + 1) + mz - a * mx - b * my) + mz, 6) AS z_flat FROM cells JOIN plane USING (site_id)")
def p11_detrend(spark, d):
    cells = orders_grid(spark, d)
    return rounded(ce.detrend(cells, ce.fit_plane(cells)).select("site_id", "r", "c", "z_flat"))


@query("SELECT site_id, r, c, CAST(r % 5 AS BIGINT) AS ord, CASE WHEN r % 5 > 0 THEN CAST(5 - r % 5 AS BIGINT) END AS rs_order FROM cells")
def p12_order_swap(spark, d):
    return ce.order_swap(orders_grid(spark, d).select("site_id", "r", "c", (F.col("r") % 5).alias("ord")), 4)


@query("SELECT site_id, r, c, CASE WHEN z - 1 > 0 THEN z - 1 END AS z FROM cells")
def p13_nullify_nonpositive(spark, d):
    return ce.nullify_nonpositive(orders_grid(spark, d).select("site_id", "r", "c", (F.col("z") - 1).alias("z")), "z")


@query("""SELECT site_id, r, c, round(CASE WHEN c % 10 = 0 THEN avg(CASE WHEN c % 10 <> 0 THEN z END) OVER (PARTITION BY site_id, r) ELSE z END, 6) AS z FROM cells""")
def p14_sentinel_fill(spark, d):
    marked = orders_grid(spark, d).select("site_id", "r", "c", F.when(F.col("c") % 10 == 0, 999.0).otherwise(F.col("z")).alias("z"))
    return rounded(ce.sentinel_fill(marked, "z", ["site_id", "r"]))


@query("SELECT site_id, r - 5 AS r, c + 5 AS c FROM mask WHERE r >= 5 AND c + 5 < 100")
def p15_in_bounds(spark, d):
    return ge.in_bounds(raw_mask(spark, d).select("site_id", (F.col("r") - 5).alias("r"), (F.col("c") + 5).alias("c")), ROWS, COLS)


@query("SELECT site_id, r, c, z FROM cells")
def s1_s2_byte_ranges(spark, d):
    """The same text by the data source of byte ranges, whose tasks number their own lines."""
    cells, path = orders_grid(spark, d), new_folder(spark, "grids")
    gr.write_ascii_grid(cells, grids_of(cells), path)
    back = rg.read_grid_ranges(spark, path, site=r"site=([^/]*)/[^/]*$").withColumns({k: F.col(k).cast("long") for k in ("site_id", "r", "c")})
    return back.join(cells.select("site_id", "r", "c"), ["site_id", "r", "c"], "left_semi")


@query("SELECT e.site_id, e.r, e.c, e.z, s.slope FROM cells e JOIN cells s USING (site_id, r, c)")
def j1_align(spark, d):
    cells = orders_grid(spark, d)
    return ce.align(cells.drop("slope"), cells.drop("z"))


@query(f"SELECT site_id, r, c, z, {P['hat']}::DOUBLE - z AS below_hat FROM cells")
def j2_params_join(spark, d):
    cells = orders_grid(spark, d)
    return cells.join(params_of(cells).select("site_id", "hat"), "site_id").select("site_id", "r", "c", "z", (F.col("hat") - F.col("z")).alias("below_hat"))


@query("SELECT a.site_id, a.r, a.c, b.r AS r2, b.c AS c2, CASE WHEN a.r = b.r OR a.c = b.c THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END AS w FROM mask a JOIN mask b ON a.site_id = b.site_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE (a.r, a.c) < (b.r, b.c)")
def j3_r1_skeleton_edges(spark, d):
    return ne.skeleton_edges(raw_mask(spark, d))


@query("SELECT p.site_id, p.r, p.c, arg_min(m.r, ((p.r-m.r)*(p.r-m.r)+(p.c-m.c)*(p.c-m.c)) * 1000000 + m.r * 1000 + m.c) AS r2, arg_min(m.c, ((p.r-m.r)*(p.r-m.r)+(p.c-m.c)*(p.c-m.c)) * 1000000 + m.r * 1000 + m.c) AS c2 FROM cells p JOIN mask m USING (site_id) GROUP BY ALL")
def j5_snap(spark, d):
    points = orders_grid(spark, d).select("site_id", (F.col("r") * 1000 + F.col("c")).alias("id"), "r", "c")
    return ne.snap(points, raw_mask(spark, d)).drop("id")


@query("SELECT g.site_id, g.r, g.c, sqrt(min((g.r-m.r)*(g.r-m.r)+(g.c-m.c)*(g.c-m.c))) AS d FROM grid g JOIN mask m ON m.site_id = g.site_id GROUP BY ALL")
def j9_n5_edt(spark, d):
    cells = orders_grid(spark, d)
    return ed.edt(cells, raw_mask(spark, d))


@query("SELECT g.site_id, g.r, g.c FROM grid g ANTI JOIN mask m USING (site_id, r, c)")
def j12_u5_complement(spark, d):
    return mo.complement(raw_mask(spark, d), orders_grid(spark, d))


@query(f"SELECT site_id, min(c * {P['gs']}::DOUBLE) AS min_x, max(c * {P['gs']}::DOUBLE) AS max_x, min({P['gs']}::DOUBLE * ({ROWS} - 1 - r)) AS min_y, max({P['gs']}::DOUBLE * ({ROWS} - 1 - r)) AS max_y, min(z) AS min_z, max(z) AS max_z, round(avg(z), 6) AS mean_depth, round(avg(slope), 6) AS mean_slope, count(z) AS n_cells FROM cells GROUP BY site_id")
def a1_site_stats(spark, d):
    cells = orders_grid(spark, d)
    return rounded(ce.site_stats(ce.with_xy(cells, grids_of(cells))))


def curve_sql(kind: str) -> str:
    if kind == "z":
        edges = ", ends AS (SELECT site_id, min(z) AS lo, max(z) AS hi FROM cells GROUP BY 1), edges AS (SELECT site_id, CAST(i AS INTEGER) AS bin, 0.03::DOUBLE + i * 0.03::DOUBLE AS edge, 0.03::DOUBLE + (i + 1) * 0.03::DOUBLE AS next FROM (SELECT site_id, unnest(range(greatest(CAST(ceil(hi / 0.03::DOUBLE) AS BIGINT), 1))) AS i FROM ends))"
    else:
        edges = ", ends AS (SELECT site_id, min(slope) AS lo, max(slope) AS hi FROM cells GROUP BY 1), edges AS (SELECT site_id, CAST(i AS INTEGER) AS bin, lo + i * (hi - lo) / 199::DOUBLE AS edge, lo + (i + 1) * (hi - lo) / 199::DOUBLE AS next FROM (SELECT site_id, lo, hi, unnest(range(200)) AS i FROM ends))"
    return edges + f""", counted AS (SELECT e.site_id, bin, edge, max(bin) OVER (PARTITION BY e.site_id) AS top, (SELECT count(*) FROM cells k WHERE k.site_id = e.site_id AND k.{kind} > e.edge AND k.{kind} <= e.next) AS n FROM edges e),
curve AS (SELECT site_id, '{kind}' AS kind, bin, edge, CASE WHEN bin = top THEN 0::DOUBLE ELSE n::DOUBLE END AS area FROM counted),
cum AS (SELECT *, sum(area) OVER (PARTITION BY site_id ORDER BY bin) AS cum_area FROM curve)"""


@query(curve_sql("z") + " SELECT * FROM cum")
def a3_a4_w1_elevation_curve(spark, d):
    return hy.histogram_area(orders_grid(spark, d), "z", P["gs"])


@query(curve_sql("slope") + " SELECT * FROM cum")
def a3_a4_w1_slope_curve(spark, d):
    return hy.histogram_area(orders_grid(spark, d), "slope", P["gs"])


@query(curve_sql("z") + " SELECT site_id, kind, bin, edge, cum_area FROM cum QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY abs(cum_area - 700), bin) = 1")
def j11_hypsometry_lookup(spark, d):
    return hy.nearest_point(hy.histogram_area(orders_grid(spark, d), "z", P["gs"]), 700.0)


@query(labels_sql("mask", EIGHT) + " SELECT * FROM labels")
def n6_components_8(spark, d):
    return co.label(raw_mask(spark, d), 8, tile=32)


@query(labels_sql("mask", FOUR) + " SELECT * FROM labels")
def n6_components_4(spark, d):
    return co.label(raw_mask(spark, d), 4, tile=32)


@query(labels_sql("mask", EIGHT) + " SELECT site_id, comp, count(*) AS n FROM labels GROUP BY ALL")
def a5_component_size(spark, d):
    return co.component_size(co.label(raw_mask(spark, d)))


@query(labels_sql("mask", EIGHT) + ", sizes AS (SELECT site_id, comp, count(*) AS n FROM labels GROUP BY ALL) SELECT site_id, comp FROM sizes QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC, comp) = 1")
def a6_largest_component(spark, d):
    return co.largest_component(co.label(raw_mask(spark, d)))


@query(labels_sql("mask", EIGHT) + """, border AS (SELECT l.* FROM labels l WHERE (SELECT count(*) FROM labels n WHERE n.site_id = l.site_id AND n.comp = l.comp AND abs(n.r - l.r) + abs(n.c - l.c) = 1) < 4),
w AS (SELECT b.site_id, b.comp, b.r, b.c, 1 + coalesce(sum(CASE WHEN n.r IS NULL THEN 0 WHEN n.r = b.r OR n.c = b.c THEN 2 ELSE 10 END), 0) AS code
      FROM border b LEFT JOIN border n ON n.site_id = b.site_id AND n.comp = b.comp AND n.r BETWEEN b.r - 1 AND b.r + 1 AND n.c BETWEEN b.c - 1 AND b.c + 1 AND (n.r <> b.r OR n.c <> b.c) GROUP BY ALL),
per AS (SELECT site_id, comp, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS p FROM w GROUP BY ALL)
SELECT site_id, comp, area, round(r_mean, 6) AS r_mean, round(c_mean, 6) AS c_mean, r_min, r_max, c_min, c_max, round(p, 6) AS perimeter, round(p * p / (4 * pi() * area), 6) AS circularity
FROM (SELECT site_id, comp, count(*) AS area, avg(r) AS r_mean, avg(c) AS c_mean, min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max FROM labels GROUP BY ALL) x JOIN per USING (site_id, comp)""")
def a7_component_props(spark, d):
    return rounded(co.component_props(co.label(raw_mask(spark, d))))


@query(labels_sql("mask", EIGHT) + " SELECT site_id, r, c FROM labels QUALIFY count(*) OVER (PARTITION BY site_id, comp) >= 10")
def n7_remove_small_objects(spark, d):
    return co.remove_small_objects(raw_mask(spark, d), P["small"])


@query(labels_sql("mask", EIGHT) + " SELECT site_id, r, c FROM labels QUALIFY count(*) OVER (PARTITION BY site_id, comp) BETWEEN 5 AND 100")
def n8_area_filter_range(spark, d):
    return co.area_filter(raw_mask(spark, d), orders_grid(spark, d), 5, 100, "range")


@query()
def n8_area_filter_reference(spark, d):
    return co.area_filter(raw_mask(spark, d), orders_grid(spark, d), P["small"], 4990)


BACK = ", back AS (SELECT g.* FROM grid g ANTI JOIN mask USING (site_id, r, c))"
OPEN = f", open AS (SELECT DISTINCT site_id, comp FROM labels WHERE r = 0 OR c = 0 OR r = {ROWS - 1} OR c = {COLS - 1})"


@query(BACK + labels_sql("back", FOUR) + OPEN + " SELECT * FROM mask UNION ALL SELECT l.site_id, l.r, l.c FROM labels l ANTI JOIN open USING (site_id, comp)")
def n9_fill_holes(spark, d):
    return co.fill_holes(raw_mask(spark, d), orders_grid(spark, d), ROWS, COLS)


@query()
def n10_fill_small_holes(spark, d):
    return co.fill_small_holes(raw_mask(spark, d), orders_grid(spark, d), ROWS, COLS, P["hole"])


@query()
def n11_repair(spark, d):
    return creek_mask(orders_grid(spark, d), SETTINGS)


@query()
def n12_reconnect(spark, d):
    return re.reconnect(raw_mask(spark, d), orders_grid(spark, d), P["noise"], P["dist"])


@query()
def j10_closest_to_largest(spark, d):
    return re.closest_to_largest(co.label(raw_mask(spark, d)), orders_grid(spark, d), 30)


DISK = "(SELECT * FROM (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) t(dr, dc))"


@query(f"SELECT DISTINCT g.site_id, g.r, g.c FROM mask m, {DISK} o, grid g WHERE g.site_id = m.site_id AND g.r = m.r + o.dr AND g.c = m.c + o.dc")
def n1_dilate(spark, d):
    return mo.dilate(raw_mask(spark, d), 1, orders_grid(spark, d))


@query(f"SELECT m.site_id, m.r - o.dr AS r, m.c - o.dc AS c FROM mask m, {DISK} o GROUP BY ALL HAVING count(*) = 5")
def n2_erode(spark, d):
    return mo.erode(raw_mask(spark, d), mo.disk(1))


@query(f""", grown AS (SELECT DISTINCT g.site_id, g.r, g.c FROM mask m, {DISK} o, grid g WHERE g.site_id = m.site_id AND g.r = m.r + o.dr AND g.c = m.c + o.dc)
SELECT w.* FROM grown w WHERE NOT EXISTS (SELECT 1 FROM {DISK} o, grid g WHERE g.site_id = w.site_id AND g.r = w.r + o.dr AND g.c = w.c + o.dc AND NOT EXISTS (SELECT 1 FROM grown x WHERE x.site_id = g.site_id AND x.r = g.r AND x.c = g.c))""")
def n3_close(spark, d):
    return mo.close(raw_mask(spark, d), 1, orders_grid(spark, d))


@query(CODES.format(mask="mask") + " SELECT site_id, r, c, CAST(bit_count(code) AS INTEGER) AS n FROM codes WHERE inside")
def n4_neighbour_count(spark, d):
    return mo.neighbour_count(raw_mask(spark, d))


@query(CODES.format(mask="mask") + " SELECT site_id, r, c FROM codes WHERE inside AND bit_count(code) <= 1")
def n18_end_points(spark, d):
    return mo.end_points(raw_mask(spark, d))


@query(CODES.format(mask="mask") + " SELECT site_id, r, c FROM codes WHERE inside AND code > 0")
def n19_remove_isolated(spark, d):
    return mo.remove_isolated(raw_mask(spark, d))


@query(CODES.format(mask="mask") + " SELECT site_id, r, c FROM mask UNION ALL SELECT site_id, r, c FROM codes WHERE NOT inside AND code IN (10, 18, 72, 80)")
def n15_bwmorph_diag(spark, d):
    return mo.bwmorph_diag(raw_mask(spark, d))


HITS = " OR ".join(f"bit_count(code & {k}) >= 3" for k in mo.BRANCH_KERNELS)
SIDES = " OR ".join(f"bit_count(code & {k}) = 3" for k in mo.SIDE_PATTERNS)


@query(CODES.format(mask="mask") + f""", sq AS (SELECT a.site_id, a.r AS r0, a.c AS c0 FROM mask a SEMI JOIN (SELECT site_id, r, c - 1 AS c FROM mask) b USING (site_id, r, c) SEMI JOIN (SELECT site_id, r - 1 AS r, c FROM mask) d USING (site_id, r, c) SEMI JOIN (SELECT site_id, r - 1 AS r, c - 1 AS c FROM mask) e USING (site_id, r, c))
SELECT site_id, r, c FROM codes WHERE inside AND ({HITS}) AND NOT ({SIDES}) UNION
SELECT site_id, r, c FROM (SELECT s.*, k.r, k.c, row_number() OVER (PARTITION BY s.site_id, r0, c0 ORDER BY k.z NULLS LAST, k.r, k.c) AS n FROM sq s JOIN cells k ON k.site_id = s.site_id AND k.r BETWEEN r0 AND r0 + 1 AND k.c BETWEEN c0 AND c0 + 1) WHERE n = 1""")
def n17_branch_points(spark, d):
    return mo.branch_points(raw_mask(spark, d), orders_grid(spark, d))


@query(f", land AS (SELECT site_id, r, c FROM hatted WHERE z IS NOT NULL) SELECT l.* FROM land l WHERE r > 0 AND c > 0 AND r < {ROWS - 1} AND c < {COLS - 1} AND (SELECT count(*) FROM land n WHERE n.site_id = l.site_id AND abs(n.r - l.r) + abs(n.c - l.c) = 1) < 4")
def n13_border_mask(spark, d):
    return mo.border_mask(ce.land_mask(hatted(spark, d)), ROWS, COLS)


PERIMETER = ", land AS (SELECT site_id, r, c FROM hatted WHERE z IS NOT NULL), per AS (SELECT l.* FROM land l WHERE (SELECT count(*) FROM land n WHERE n.site_id = l.site_id AND n.r BETWEEN l.r - 1 AND l.r + 1 AND n.c BETWEEN l.c - 1 AND l.c + 1) < 9)"


@query(PERIMETER + " SELECT * FROM per")
def n14_u4_perimeter_mask(spark, d):
    return mo.perimeter_mask(ce.land_mask(hatted(spark, d)))


@query(PERIMETER + " SELECT a.site_id, max(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) AS major_axis FROM per a JOIN per b USING (site_id) GROUP BY 1")
def a18_major_axis(spark, d):
    return ov.major_axis(ce.land_mask(hatted(spark, d)))


@query("SELECT k.site_id, k.r, k.c FROM cells k WHERE z IS NOT NULL AND z = (SELECT min(n.z) FROM cells n WHERE n.site_id = k.site_id AND n.r BETWEEN k.r - 1 AND k.r + 1 AND n.c BETWEEN k.c - 1 AND k.c + 1)")
def n20_regional_min(spark, d):
    return mo.regional_min(orders_grid(spark, d), "z")


@query("SELECT site_id, r, c FROM mask UNION SELECT site_id, r, c FROM cells WHERE z < 0.5")
def u1_union(spark, d):
    return raw_mask(spark, d).union(orders_grid(spark, d).where("z < 0.5D").select(*ce.KEYS)).distinct()


@query("SELECT m.* FROM mask m SEMI JOIN (SELECT * FROM cells WHERE z < 0.4) k USING (site_id, r, c)")
def u2_intersection(spark, d):
    return raw_mask(spark, d).join(orders_grid(spark, d).where("z < 0.4D").select(*ce.KEYS), ce.KEYS, "left_semi")


@query("SELECT m.* FROM mask m ANTI JOIN (SELECT * FROM cells WHERE z < 0.4) k USING (site_id, r, c)")
def u3_difference(spark, d):
    return raw_mask(spark, d).join(orders_grid(spark, d).where("z < 0.4D").select(*ce.KEYS), ce.KEYS, "left_anti")


@query("SELECT site_id, count(*) FILTER (r IS NOT NULL) AS creek_area FROM mask GROUP BY 1")
def a13_creek_area(spark, d):
    return raw_mask(spark, d).groupBy("site_id").agg(F.count("*").alias("creek_area"))


@query(f"SELECT site_id, count(m.k) AS creek_area, count(z) AS catchment_area, round(avg(z), 6) AS mean_elev, round(avg(CASE WHEN m.k IS NULL THEN z END), 6) AS marsh_elev, round({P['hat']}::DOUBLE - avg(z), 6) AS elev_under_hat FROM hatted h LEFT JOIN (SELECT *, 1 AS k FROM mask) m USING (site_id, r, c) GROUP BY 1")
def a14_a15_marsh_means(spark, d):
    return rounded(ov.marsh_means(hatted(spark, d), raw_mask(spark, d), P["hat"]))


@query(f"SELECT site_id, round(sum(greatest({P['hat']}::DOUBLE - z, 0::DOUBLE)), 6) AS prism FROM hatted GROUP BY 1")
def a17_tidal_prism(spark, d):
    return rounded(ov.tidal_prism(hatted(spark, d), P["hat"]))


DIST = ", dist AS (SELECT g.site_id, g.r, g.c, sqrt(min((g.r-m.r)*(g.r-m.r)+(g.c-m.c)*(g.c-m.c))) AS d FROM grid g JOIN mask m ON m.site_id = g.site_id GROUP BY ALL)"


@query(DIST + " SELECT d.site_id, round(avg(d), 6) AS mean_opl, max(d) AS max_opl FROM dist d SEMI JOIN (SELECT * FROM hatted WHERE z IS NOT NULL) h USING (site_id, r, c) GROUP BY 1")
def a16_mean_overland_path(spark, d):
    cells = orders_grid(spark, d)
    return ov.mean_overland_path(ed.edt(cells, raw_mask(spark, d)), ce.land_mask(hatted(spark, d))).withColumn("mean_opl", F.round("mean_opl", 6))


@query(DIST + """, m AS (SELECT site_id, min(d) AS least, max(d) AS most FROM dist GROUP BY 1), b AS (SELECT site_id, least, CASE WHEN most >= 10 THEN 2 WHEN most >= 4 THEN 1 ELSE 0.5 END::DOUBLE AS step, d FROM dist JOIN m USING (site_id))
SELECT site_id, CAST(floor((d - least) / step) AS BIGINT) AS band, least + floor((d - least) / step) * step AS lo, count(*) AS cells FROM b GROUP BY ALL""")
def a19_isocontour_bands(spark, d):
    cells = orders_grid(spark, d)
    return ov.isocontour_bands(ed.edt(cells, raw_mask(spark, d)))


@query(PERIMETER + DIST + ", ax AS (SELECT a.site_id, max(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) AS x FROM per a JOIN per b USING (site_id) GROUP BY 1) SELECT site_id, r, c, round(d, 6) AS d, round(d / x * 100, 6) AS d_percent FROM dist JOIN ax USING (site_id)")
def p16_percent_of_axis(spark, d):
    cells = orders_grid(spark, d)
    return rounded(ov.percent_of_axis(ed.edt(cells, raw_mask(spark, d)), ov.major_axis(ce.land_mask(hatted(spark, d)))))


@query("SELECT site_id, r, c, z FROM (SELECT k.*, row_number() OVER (PARTITION BY site_id ORDER BY z NULLS LAST, r, c) AS n FROM cells k SEMI JOIN mask USING (site_id, r, c)) WHERE n <= 3")
def w3_t1_lowest_cells(spark, d):
    w = F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("z").asc_nulls_last(), "r", "c"))
    return orders_grid(spark, d).drop("slope").join(raw_mask(spark, d), ce.KEYS, "left_semi").withColumn("n", w).where("n <= 3").drop("n")


LINES_SQL = """, lines AS (SELECT site_id, r AS r1, c AS c1, (r * 7 + 13) % 50 AS r2, (c * 3 + 29) % 100 AS c2 FROM mask),
k AS (SELECT *, abs(r2 - r1) AS ar, abs(c2 - c1) AS ac, greatest(abs(r2 - r1), abs(c2 - c1)) AS maj, least(abs(r2 - r1), abs(c2 - c1)) AS mn FROM lines),
p AS (SELECT *, unnest(range(maj + 1)) AS pos FROM k),
q AS (SELECT *, CASE WHEN maj = 0 THEN 0 ELSE (2 * pos * mn + maj - 1) // (2 * maj) END AS step FROM p)
SELECT site_id, r1 * 1000 + c1 AS line_id, CAST(pos AS INTEGER) AS pos, r1 + sign(r2 - r1) * CASE WHEN ac > ar THEN step ELSE pos END AS r, c1 + sign(c2 - c1) * CASE WHEN ac > ar THEN pos ELSE step END AS c FROM q"""


def test_lines(spark: SparkSession, d: str) -> DataFrame:
    m = raw_mask(spark, d)
    return m.select("site_id", (F.col("r") * 1000 + F.col("c")).alias("line_id"), F.col("r").alias("r1"), F.col("c").alias("c1"), ((F.col("r") * 7 + 13) % 50).alias("r2"), ((F.col("c") * 3 + 29) % 100).alias("c2"))


@query(LINES_SQL)
def g1_rasterize_line(spark, d):
    return ge.rasterize_line(test_lines(spark, d)).select("site_id", "line_id", "pos", "r", "c")


@query("SELECT site_id, r, c, CAST(50 - (r - 25) AS BIGINT) AS c2, CAST(25 + (c - 50) AS BIGINT) AS r2 FROM mask")
def g2_rotate90(spark, d):
    x, y = ge.rotate90(F.col("c"), F.col("r"), F.lit(50), F.lit(25))
    return raw_mask(spark, d).withColumn("c2", x.cast("long")).withColumn("r2", y.cast("long"))


@query("SELECT site_id, r, c, r * 100 + c AS idx, (r * 100 + c) // 100 AS r2, (r * 100 + c) % 100 AS c2 FROM mask")
def g8_r11_linear_index(spark, d):
    m = raw_mask(spark, d).withColumn("idx", ce.linear_index(COLS))
    return m.join(ce.unravel(m.select("site_id", "idx"), "idx", COLS).toDF("site_id", "idx", "r2", "c2"), ["site_id", "idx"])


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each row of a site as a profile, its creek elevations only."""
    cells = orders_grid(spark, d)
    z = F.when(F.col("z") < 1.0, F.col("z"))
    return cells.select("site_id", F.col("r").alias("seg"), F.col("c").alias("pos"), "r", "c", z.alias("z"))


PROFILE = ", prof AS (SELECT site_id, r AS seg, c AS pos, CASE WHEN z < 1.0 THEN z END AS z FROM cells)"
FILLED = PROFILE + """, known AS (SELECT *, row_number() OVER (PARTITION BY site_id, seg ORDER BY pos) AS nth, count(*) OVER (PARTITION BY site_id, seg) AS n FROM prof WHERE z IS NOT NULL),
pick AS (SELECT p.site_id, p.seg, p.pos, p.z, greatest(1, least(coalesce((SELECT max(nth) FROM known k WHERE k.site_id = p.site_id AND k.seg = p.seg AND k.pos <= p.pos), 1), (SELECT max(n) FROM known k WHERE k.site_id = p.site_id AND k.seg = p.seg) - 1)) AS i FROM prof p),
filled AS (SELECT p.site_id, p.seg, p.pos, CASE WHEN p.z IS NOT NULL THEN p.z ELSE a.z + coalesce((b.z - a.z) / (b.pos - a.pos), 0) * (p.pos - a.pos) END AS z FROM pick p
  LEFT JOIN known a ON a.site_id = p.site_id AND a.seg = p.seg AND a.nth = p.i LEFT JOIN known b ON b.site_id = p.site_id AND b.seg = p.seg AND b.nth = p.i + 1)"""


@query(FILLED + " SELECT site_id, seg, pos, round(z, 6) AS z FROM filled")
def w7_interpolate_profile(spark, d):
    return rounded(xs.interpolated(profiles(spark, d).drop("r", "c"), ["site_id", "seg"]))


@query(FILLED + """, e AS (SELECT site_id, seg, min(pos) AS p0, max(pos) AS p1, arg_min(z, pos) AS z0, arg_max(z, pos) AS z1, max(z) - min(z) AS depth, count(*) AS n FROM filled GROUP BY ALL)
SELECT site_id, seg, (p1 - p0)::DOUBLE AS width, round(depth, 6) AS depth, round(sum(z0 + (z1 - z0) * (pos - p0) / (p1 - p0) - z), 6) AS area, round(n * sum(z0 + (z1 - z0) * (pos - p0) / (p1 - p0) - z), 4) AS reference_area FROM filled JOIN e USING (site_id, seg) GROUP BY site_id, seg, p0, p1, depth, n""")
def a21_w8_xs_measures(spark, d):
    prof = profiles(spark, d)
    whole = xs.interpolated(prof.drop("r", "c"), ["site_id", "seg"]).join(prof.drop("z"), ["site_id", "seg", "pos"])
    return rounded(xs.xs_measures(whole, ["site_id", "seg"]).withColumn("reference_area", F.round("reference_area", 4)))


@query(""", pts AS (SELECT site_id, r AS seg, c - 50 AS pos, r, c FROM cells), onm AS (SELECT p.*, pos - row_number() OVER (PARTITION BY p.site_id, seg ORDER BY pos) AS run FROM pts p SEMI JOIN mask USING (site_id, r, c))
SELECT o.site_id, o.seg, o.pos, o.r, o.c FROM onm o SEMI JOIN (SELECT site_id, seg, run FROM onm WHERE pos = 0) m USING (site_id, seg, run)""")
def j7_w6_middle_run(spark, d):
    points = orders_grid(spark, d).select("site_id", F.col("r").alias("seg"), (F.col("c") - 50).alias("pos"), "r", "c")
    return xs.middle_run(points, raw_mask(spark, d))


@query("SELECT site_id, CASE n WHEN 1 THEN 'cth' WHEN 2 THEN 'lzth' ELSE 'hzth' END AS threshold, CASE n WHEN 1 THEN 8::DOUBLE WHEN 2 THEN 0.42::DOUBLE ELSE 0.52::DOUBLE END AS value FROM (SELECT DISTINCT site_id FROM cells), range(1, 4) t(n)")
def a12_threshold_table(spark, d):
    return su.threshold_table(params_of(orders_grid(spark, d)))


def named_apart(sql: str, suffix: str) -> str:
    """The tables of a curve's SQL under names of their own."""
    return re_.sub(r"\b(ends|edges|counted|curve|cum)\b", rf"\1_{suffix}", sql)


@query(named_apart(curve_sql("z"), "z") + named_apart(curve_sql("slope"), "slope") + """, thresholds AS (SELECT * FROM (VALUES ('cth', 'slope', 8::DOUBLE), ('lzth', 'z', 0.42::DOUBLE), ('hzth', 'z', 0.52::DOUBLE)) t(threshold, kind, value))
SELECT site_id, threshold, value, cum_area AS area FROM thresholds JOIN (SELECT * FROM cum_z UNION ALL SELECT * FROM cum_slope) USING (kind)
QUALIFY row_number() OVER (PARTITION BY site_id, threshold ORDER BY abs(edge - value), bin) = 1""")
def a12_threshold_areas(spark, d):
    cells = orders_grid(spark, d)
    curves = hy.histogram_area(cells, "z", P["gs"]).union(hy.histogram_area(cells, "slope", P["gs"]))
    return su.threshold_areas(su.threshold_table(params_of(cells)), curves)


SEGS = """, segs AS (SELECT site_id, r * 100 + c AS seg, 1 + c % 4 AS ord, z * 10 AS sinuous_len, CASE WHEN c % 7 > 0 THEN z * 9 END AS straight_len, slope AS width, z AS depth, CASE WHEN r % 3 > 0 THEN z END AS area FROM cells WHERE z IS NOT NULL),
seg2 AS (SELECT *, sinuous_len / nullif(straight_len, 0) AS sinuosity FROM segs)"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Cells as if they were measured segments."""
    z = F.col("z")
    s = orders_grid(spark, d).where("z is not null").select("site_id", (F.col("r") * 100 + F.col("c")).alias("seg"), (1 + F.col("c") % 4).alias("ord"), (z * 10).alias("sinuous_len"), F.when(F.col("c") % 7 > 0, z * 9).alias("straight_len"), F.col("slope").alias("width"), z.alias("depth"), F.when(F.col("r") % 3 > 0, z).alias("area"))
    return s.withColumn("sinuosity", ge.sinuosity(F.col("sinuous_len"), F.col("straight_len")))


SUMS = """count(*) AS n_segments, round(sum(sinuous_len), 6) AS total_sinuous_length, round(sum(sinuous_len) / count(*), 6) AS mean_sinuous_length, round(sum(sinuosity) / count(*), 6) AS mean_sinuosity, round(sum(width) / count(*), 6) AS mean_width,
round(sum(depth) / count(*), 6) AS mean_depth, round(sum(area) / count(*), 6) AS mean_xs_area, round(sum(straight_len), 6) AS total_channel_length, round(sum(straight_len) / count(*), 6) AS mean_channel_length FROM seg2"""


@query(SEGS + " SELECT site_id, seg, ord, sinuous_len, straight_len, width, depth, area, round(sinuosity, 6) AS sinuosity FROM seg2")
def g9_sinuosity(spark, d):
    return measured(spark, d).withColumn("sinuosity", F.round("sinuosity", 6))


@query(SEGS + f" SELECT site_id, ord, {SUMS} GROUP BY ALL")
def a9_order_summary(spark, d):
    return rounded(su.order_summary(measured(spark, d)))


@query(SEGS + f" SELECT site_id, ord, CAST(grouping(site_id, ord) AS BIGINT) AS level, {SUMS} GROUP BY ROLLUP (site_id, ord)")
def a22_order_rollup(spark, d):
    return rounded(su.order_rollup(measured(spark, d)))


@query(SEGS + " SELECT site_id, ord, round(avg(sinuous_len), 6) AS avg_sinuous_len, round(avg(sinuosity), 6) AS avg_sinuosity, round(avg(width), 6) AS avg_width, round(avg(depth), 6) AS avg_depth, round(avg(area), 6) AS avg_area FROM seg2 GROUP BY ALL")
def a10_measure_means(spark, d):
    return rounded(su.measure_means(measured(spark, d)))


@query(SEGS + " SELECT site_id, ord, count(*) AS n_segments FROM seg2 GROUP BY ALL")
def a8_count_segments(spark, d):
    return su.count_segments(measured(spark, d))


@query(SEGS + " SELECT site_id, round_even(avg(sinuous_len) * 0.2, 0) AS vector_length FROM seg2 WHERE ord = 2 GROUP BY 1")
def a20_vector_length(spark, d):
    return su.vector_length(measured(spark, d))


@query(SEGS + " SELECT site_id, ord, round(avg(nullif(CASE WHEN seg % 4 = 0 THEN 0 ELSE width END, 0)), 6) AS mean_angle FROM seg2 GROUP BY ALL")
def a11_angle_means(spark, d):
    return rounded(su.angle_means(measured(spark, d).withColumn("angle", F.when(F.col("seg") % 4 == 0, 0.0).otherwise(F.col("width")))))


@query()
def n16_skeletonize(spark, d):
    return th.skeletonize(raw_mask(spark, d), tile=32, halo=8)


@query()
def r2_geodesic_distance(spark, d):
    m = raw_mask(spark, d)
    return ne.geodesic_distance(m, m.where("r = 0"))


def network_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    cells = orders_grid(spark, d)
    mask = written(creek_mask(cells, SETTINGS), "mask")
    return cells, mask, ordered_network(cells, mask, SETTINGS)


@query()
def r7_j4_outlets(spark, d):
    return network_of(spark, d)[2]["breaches"]


@query()
def r3_segment_graph(spark, d):
    return network_of(spark, d)[2]["segments"]


@query()
def r4_r5_r6_strahler_order(spark, d):
    return network_of(spark, d)[2]["orders"]


@query()
def r8_g6_segment_lengths(spark, d):
    return network_of(spark, d)[2]["lengths"]


@query()
def r9_paint_orders(spark, d):
    cells, _, net = network_of(spark, d)
    return ne.paint_orders(net["chains"], net["orders"], cells)


@query()
def r10_apply_corrections(spark, d):
    cells, _, net = network_of(spark, d)
    painted = net["chains"].join(net["orders"], ["site_id", "seg"]).select(*ce.KEYS, "ord")
    fix = cells.select("site_id").distinct().select("site_id", F.lit(1).alias("id"), F.lit(2).alias("r1"), F.lit(50).alias("c1"), F.lit(40).alias("r2"), F.lit(50).alias("c2"), F.lit(4).alias("new_order"))
    return ne.apply_corrections(painted, net["skel"], fix, mo.branch_points(net["skel"], cells).union(mo.end_points(net["skel"])))


@query()
def g3_g5_cross_sections(spark, d):
    cells, mask, net = network_of(spark, d)
    return sections(cells, mask, net, SETTINGS)


@query()
def g7_j8_junction_angles(spark, d):
    cells, _, net = network_of(spark, d)
    return xs.junction_angles(mo.branch_points(net["skel"], cells), net["chains"], 4)


@query()
def r11_branch_index(spark, d):
    return ne.branch_index(network_of(spark, d)[2]["links"], COLS)


@query()
def j8_a11_segment_angles(spark, d):
    cells, _, net = network_of(spark, d)
    return ne.segment_angles(net["links"], xs.junction_angles(mo.branch_points(net["skel"], cells), net["chains"], SETTINGS.hops), net["skel"], cells, net["breaches"])


@query()
def r10_corrected_segments(spark, d):
    cells, _, net = network_of(spark, d)
    fix = cells.select("site_id").distinct().select("site_id", F.lit(1).alias("id"), F.lit(2).alias("r1"), F.lit(50).alias("c1"), F.lit(40).alias("r2"), F.lit(50).alias("c2"), F.lit(4).alias("new_order"))
    return ne.corrected_segments(net["skel"], fix, mo.branch_points(net["skel"], cells).union(mo.end_points(net["skel"])))


@query()
def workload_morphometry(spark, d):
    return morphometry(orders_grid(spark, d), SETTINGS)


def centre_line(cells: DataFrame) -> DataFrame:
    """A correction for every site: the middle of its trunk gets order 4."""
    return cells.select("site_id").distinct().select("site_id", F.lit(1).alias("id"), F.lit(2).alias("r1"), F.lit(50).alias("c1"), F.lit(40).alias("r2"), F.lit(50).alias("c2"), F.lit(4).alias("new_order"))


@query()
def r10_corrected_morphometry(spark, d):
    cells = orders_grid(spark, d)
    return morphometry(cells, SETTINGS, centre_line(cells))


@query()
def g4_xs_anchor_loop(spark, d):
    """The anchors of loops for every chain of the network; rings are those that are closed by themselves."""
    _, _, net = network_of(spark, d)
    return lo.xs_anchor_loop(lo.path_cells(net["chains"], net["segments"].where("closed")))


@query()
def r2_chain_positions(spark, d):
    """Hops and lengths along the skeleton's chains without knots, for each of its cells."""
    _, _, net = network_of(spark, d)
    return pa.contracted_graph(net["skel"], net["breaches"])[1]


@query(SEGS + f" SELECT site_id, ord, {SUMS} GROUP BY ALL")
def t4_s6_written_summary(spark, d):
    """The order summary written in the order of sites and orders, and read back."""
    table = rounded(su.order_summary(measured(spark, d)))
    path = new_folder(spark, "summary")
    gr.write_summary(table, path)
    return gr.read_summary(spark, path, table.schema)


@query("SELECT site_id, r, c, z FROM cells")
def s1_s2_ascii_round_trip(spark, d):
    """The elevation grids of all sites as text, read back by their headers."""
    cells, path = orders_grid(spark, d), new_folder(spark, "grids")
    gr.write_ascii_grid(cells, grids_of(cells), path)
    back = gr.read_ascii_grid(spark, path, site=r"site=([^/]*)/[^/]*$").withColumns({"site_id": F.col("site_id").cast("long"), "r": F.col("r").cast("long"), "c": F.col("c").cast("long")})
    return back.join(cells.select("site_id", "r", "c"), ["site_id", "r", "c"], "left_semi")


@query("SELECT e.site_id, e.r, e.c, e.z, s.slope FROM cells e JOIN cells s USING (site_id, r, c)")
def j1_s5_bucketed_align(spark, d):
    """Elevation and slope as bucketed tables, joined cell by cell where they lie."""
    cells, names = orders_grid(spark, d), [f"fenland_{k}_{uuid.uuid4().hex}" for k in ("z", "slope")]
    try:
        z, slope = (st.write_bucketed(cells.select(*ce.KEYS, k), n, 16) for k, n in zip(("z", "slope"), names, strict=True))
        return written(st.joined(z, slope).select(*ce.KEYS, "z", "slope"), "bucketed-align")
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


@query()
def workload_overland(spark, d):
    cells = orders_grid(spark, d)
    return overland_paths(cells, raw_mask(spark, d), SETTINGS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload_morphometry(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
