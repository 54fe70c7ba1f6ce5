import numpy as np

from fenland.functions.helpers import thin_block
from fenland.operators import components, morph, network, thin, xsection
from fenland.sources import fixtures


def frame(spark, cells, site=0):
    return spark.createDataFrame([(site, int(r), int(c)) for r, c in cells], "site_id long, r long, c long")


def cells_of(df):
    return {(x.r, x.c) for x in df.collect()}


def test_thinning_is_the_same_for_any_tile(spark):
    rng = np.random.default_rng(3)
    m = rng.random((40, 40)) < 0.75
    want = m
    while True:
        after = thin_block(want, 2)
        if (after == want).all():
            break
        want = after
    got = thin.skeletonize(frame(spark, zip(*np.nonzero(m))), tile=16, halo=4)
    assert cells_of(got) == set(zip(*(x.tolist() for x in np.nonzero(want))))


def test_labels_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(4)
    m = frame(spark, zip(*np.nonzero(rng.random((30, 30)) < 0.45)))
    a, b = ({tuple(x) for x in components.label(m, 8, tile=t).collect()} for t in (7, 64))
    assert a == b


def test_y_network_has_two_orders(spark):
    cells = {(r, 10) for r in range(10, 21)} | {(9 - i, 9 - i) for i in range(8)} | {(9 - i, 11 + i) for i in range(8)}
    skel = frame(spark, cells)
    z = skel.withColumn("z", skel["r"] * 0.0)
    chains, links, segments = network.segment_graph(skel, z, frame(spark, [(20, 10)]))
    orders = sorted(x.ord for x in network.strahler_order(links, segments, 4).select("final", "ord").distinct().collect())
    assert orders == [1, 1, 2]  # two segments of order 1 meet in one of order 2


def test_geodesic_distance_crosses_tiles(spark):
    line = frame(spark, [(0, c) for c in range(40)])
    got = {x.c: x.d for x in network.geodesic_distance(line, frame(spark, [(0, 0)]), tile=8).collect()}
    assert got == {c: float(c) for c in range(40)}


def test_end_points_of_an_isolated_cell(spark):
    assert cells_of(morph.end_points(frame(spark, [(5, 5)]))) == {(5, 5)}


def y_network(spark):
    cells = {(r, 10) for r in range(10, 21)} | {(9 - i, 9 - i) for i in range(8)} | {(9 - i, 11 + i) for i in range(8)}
    skel = frame(spark, cells)
    z = skel.withColumn("z", skel["r"] * 0.0)
    return skel, z, *network.segment_graph(skel, z, frame(spark, [(20, 10)]))


def test_angles_and_branch_index_of_a_y(spark):
    skel, z, chains, links, _ = y_network(spark)
    nodes = cells_of(morph.branch_points(skel, z))
    first = min(nodes)
    index = {x.branch_idx for x in network.branch_index(links.where("not outlet"), 100).collect()}
    assert index == {first[0] * 100 + first[1]}
    angles = xsection.junction_angles(morph.branch_points(skel, z), chains, 4)
    got = network.segment_angles(links, angles, skel, z, frame(spark, [(20, 10)])).collect()
    arms = sorted(x.angle for x in got if x.angle is not None)
    assert len(got) == 3 and len(arms) >= 2 and all(60 <= a <= 120 for a in arms)


def test_corrections_are_painted_and_measured(spark):
    skel, _, _, _, _ = y_network(spark)
    fix = spark.createDataFrame([(0, 1, 2, 3, 19, 9, 7), (0, 2, 10, 11, 15, 10, 8)], "site_id long, id int, r1 int, c1 int, r2 int, c2 int, new_order int")
    ends = frame(spark, [(2, 2), (2, 18), (20, 10), (10, 10), (15, 10)])
    painted = {(x.r, x.c): x.ord for x in network.apply_corrections(skel.selectExpr("*", "1 as ord"), skel, fix, ends).collect()}
    assert painted[2, 2] == 7 and painted[20, 10] == 7 and painted[2, 18] == 1 and painted[12, 10] == 8 and painted[16, 10] == 7
    got = {x.id: x for x in network.corrected_segments(skel, fix, ends).collect()}
    assert abs(got[1].sinuous_len - (8 * 2**0.5 + 10)) < 1e-9 and abs(got[1].straight_len - (18**2 + 8**2) ** 0.5) < 1e-9
    assert got[2].ord == 8 and got[2].sinuous_len == 5 and got[2].sinuosity == 1


def test_snap_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    points, anchors = rng.integers(0, 300, (200, 2)), rng.integers(0, 300, (12, 2))
    p = spark.createDataFrame([(0, i, int(r), int(c)) for i, (r, c) in enumerate(points)] + [(1, 0, 5, 5)], "site_id long, id int, r int, c int")
    got = {(x.site_id, x.id): (x.r2, x.c2) for x in network.snap(p, frame(spark, [*anchors, *anchors])).collect()}
    want = {(0, i): min(((int(a), int(b)) for a, b in anchors), key=lambda q: ((q[0] - r) ** 2 + (q[1] - c) ** 2, q)) for i, (r, c) in enumerate(points)}
    assert got == want


def test_middle_of_equally_distant_cells(spark):
    """A ring of 8 cells from (0, 1): two cells are at each distance, the second in row order is the middle."""
    ring = [(0, 1, 0), (0, 0, 1), (0, 2, 1), (1, 0, 2), (1, 2, 2), (2, 0, 3), (2, 2, 3), (2, 1, 4)]
    p = spark.createDataFrame([(0, 1, r, c, d) for r, c, d in ring], "site_id long, seg long, r long, c long, pos long")
    got = xsection.xs_anchor(p).collect()
    assert [(x.rm, x.cm) for x in got] == [(1, 2)]


def test_phony_surface_is_scaled(spark):
    got = fixtures.phony_surface(fixtures.phony_network(spark, 2)).groupBy("site_id").agg({"z": "max", "c": "count"}).collect()
    assert len(got) == 2 and all(x["max(z)"] == 100.0 and x["count(c)"] > 200 for x in got)
