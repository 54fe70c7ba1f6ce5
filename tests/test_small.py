"""Repair, reconnection, outlets, lengths, painting and sections against plain versions on small grids."""

import math

import numpy as np
import pytest

from fenland.operators import components, morph, network, reconnect, xsection

ROWS, COLS = 24, 30


def frame(spark, cells, site=0):
    return spark.createDataFrame([(site, int(r), int(c)) for r, c in sorted(cells)], "site_id long, r long, c long")


def cells_of(df):
    return {(x.r, x.c) for x in df.collect()}


def grid(spark):
    return frame(spark, {(r, c) for r in range(ROWS) for c in range(COLS)})


def pieces(cells, eight=True):
    left, out = set(cells), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            p = todo.pop()
            own.add(p)
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    q = (p[0] + a, p[1] + b)
                    if (eight or not (a and b)) and q in left:
                        left.discard(q)
                        todo.append(q)
        out.append(own)
    return out


def every():
    return {(r, c) for r in range(ROWS) for c in range(COLS)}


def plain_area(m, low, high):
    m = set().union(*[p for p in pieces(m) if len(p) >= low])
    return m.union(*[p for p in pieces(every() - m) if len(p) < ROWS * COLS - high])


def plain_holes(m, most):
    inner = [p for p in pieces(every() - m, eight=False) if not any(r in (0, ROWS - 1) or c in (0, COLS - 1) for r, c in p)]
    return m.union(*[p for p in pieces(set().union(*inner)) if len(p) < most])


def plain_close(m, radius):
    disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    grown = {(r + a, c + b) for r, c in m for a, b in disk} & every()
    return {(r, c) for r, c in grown if all((r + a, c + b) in grown or (r + a, c + b) not in every() for a, b in disk)}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_a_plain_one(spark, seed):
    rng = np.random.default_rng(seed)
    m = set(zip(*(x.tolist() for x in np.nonzero(rng.random((ROWS, COLS)) < 0.5)), strict=True))
    g = grid(spark)
    assert cells_of(components.area_filter(frame(spark, m), g, 4, ROWS * COLS - 6)) == plain_area(m, 4, ROWS * COLS - 6)
    assert cells_of(components.fill_small_holes(frame(spark, m), g, ROWS, COLS, 4)) == plain_holes(m, 4)
    want = plain_holes(plain_area(plain_close(plain_area(m, 4, ROWS * COLS - 6), 1), 3, ROWS * COLS - 5), 6)
    assert cells_of(components.repair(frame(spark, m), g, ROWS, COLS, 4, ROWS * COLS - 6, 1, 6, 3, ROWS * COLS - 5)) == want


def test_reconnect_joins_what_is_near_and_long(spark):
    """A bar is joined to the main channel at its nearest cell; a far bar, a speck of noise and a round blob go."""
    main = {(r, c) for r in range(2, 22) for c in (10, 11)}
    bar = {(r, 14) for r in range(2, 22)}
    far = {(r, 28) for r in range(2, 22)}
    blob = {(15, 5), (15, 6), (16, 5), (16, 6)}
    noise = {(20, 20)}
    m = frame(spark, main | bar | far | blob | noise)
    labels = components.label(m)
    near = {(x.r, x.c): (x.r2, x.c2, x.d) for x in reconnect.closest_to_largest(labels, grid(spark), 100.0).collect()}
    want = {}
    for p in (bar, far, blob, noise):
        d, r, c = min((min((r - a) ** 2 + (c - b) ** 2 for a, b in main), r, c) for r, c in p)
        _, r2, c2 = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in main)
        want[r, c] = (r2, c2, math.sqrt(d))
    assert near == want
    joined = cells_of(reconnect.reconnect(m, grid(spark), 3, 6.0))
    assert joined == main | bar | {(2, 12), (2, 13)}


def test_outlets_are_the_lowest_cells_joined_to_the_border(spark):
    rng = np.random.default_rng(6)
    z = {(r, c): (None if c < 3 else float(rng.integers(0, 90))) for r in range(ROWS) for c in range(COLS)}
    skel = {(12, c) for c in range(8, 25)} | {(r, 15) for r in range(6, 18)}
    cells = spark.createDataFrame([(0, r, c, v) for (r, c), v in z.items()], "site_id long, r long, c long, z double")
    got, breaches = network.outlets(frame(spark, skel), cells, 3, ROWS, COLS)
    land = {p for p, v in z.items() if v is not None}
    border = {(r, c) for r, c in land if 0 < r < ROWS - 1 and 0 < c < COLS - 1 and any(q not in land for q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)))}
    low = sorted(skel, key=lambda p: (z[p], p))[:3]
    want = {min(border, key=lambda q: (math.hypot(q[0] - r, q[1] - c), q)) for r, c in low}
    assert cells_of(breaches) == want
    lines = cells_of(got)
    assert skel | want <= lines and len(pieces(lines)) == 1


def test_lengths_and_painting_of_a_bend(spark):
    """A bent segment has the length of its steps, and its order is painted as wide as its number."""
    bend = [(10, c) for c in range(3, 9)] + [(10 + i, 8 + i) for i in range(1, 6)]
    skel = frame(spark, bend)
    chains, links, segments = network.segment_graph(skel, skel.withColumn("z", skel["r"] * 0.0))
    orders = network.strahler_order(links, segments, 4)
    (x,) = network.segment_lengths(chains, segments, orders).collect()
    assert abs(x.sinuous_len - (5 + 5 * 2**0.5)) < 1e-9 and abs(x.straight_len - math.hypot(5, 10)) < 1e-9
    painted = {(y.r, y.c): y.ord for y in network.paint_orders(chains, orders.selectExpr("site_id", "seg", "2 as ord"), grid(spark)).collect()}
    filled = cells_of(morph.bwmorph_diag(skel))
    want = {(r + a, c + b) for r, c in filled for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4} & every()
    assert set(painted) == want and set(painted.values()) == {2}


def test_section_of_a_straight_channel(spark):
    """A channel of five rows: the section runs straight across it, its depth is that of the middle row."""
    mask = {(r, c) for r in range(8, 13) for c in range(COLS)}
    depth = {8: 1.0, 9: 0.5, 10: 0.0, 11: 0.5, 12: 1.0}
    cells = spark.createDataFrame([(0, r, c, depth.get(r, 2.0)) for r in range(ROWS) for c in range(COLS)], "site_id long, r long, c long, z double")
    line = spark.createDataFrame([(0, 1, 10, c, c - 4) for c in range(4, 27)], "site_id long, seg long, r long, c long, pos long")
    (x,) = xsection.cross_section(xsection.xs_anchor(line), frame(spark, mask), cells, ROWS, COLS).collect()
    assert (x.width, x.depth) == (4.0, 1.0) and abs(x.area - (0.5 + 1.0 + 0.5)) < 1e-9 and abs(x.reference_area - 10.0) < 1e-9
