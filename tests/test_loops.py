"""Kinds of segments on planted networks, and anchors of rings and connectors against a plain path."""

from collections import deque

import numpy as np
import pytest

from fenland.operators import loops, network


def frame(spark, cells, site=0):
    return spark.createDataFrame([(site, int(r), int(c)) for r, c in cells], "site_id long, r long, c long")


def diamond(r, c, n):
    """A ring of single cells around (r, c): 4 n cells, each with two neighbours."""
    return {(r + i, c + n - abs(i)) for i in range(-n, n + 1)} | {(r + i, c - n + abs(i)) for i in range(-n, n + 1)}


def orders_of(spark, cells, outlets=(), ordermax=4):
    skel = frame(spark, cells)
    chains, links, segments = network.segment_graph(skel, skel.withColumn("z", skel["r"] * 0.0), frame(spark, outlets))
    return chains, segments, network.strahler_order(links, segments, ordermax)


def kinds(orders):
    return sorted({(x.final, x.kind, x.ord) for x in orders.collect()}, key=lambda x: (x[1], x[0]))


def test_closed_ring_alone(spark):
    ring = diamond(20, 20, 8)
    chains, segments, orders = orders_of(spark, ring)
    assert [(k, o) for _, k, o in kinds(orders)] == [("ring", 4)]
    (x,) = network.segment_lengths(chains, segments, orders).collect()
    assert x.kind == "ring" and x.sinuous_len == len(ring) == 32 and x.straight_len is None and x.sinuosity is None


def test_ring_on_a_trunk(spark):
    ring, trunk = diamond(20, 20, 8), {(r, 20) for r in range(29, 41)}
    chains, segments, orders = orders_of(spark, ring | trunk, [(40, 20)])
    assert [(k, o) for _, k, o in kinds(orders)] == [("ring", 4), ("trunk", 4)]
    got = {x.kind: x for x in network.segment_lengths(chains, segments, orders).collect()}
    assert abs(got["ring"].sinuous_len - len(ring)) <= 2 and got["ring"].straight_len is None
    assert got["trunk"].sinuosity is not None


def test_two_rings_with_a_connector(spark):
    cells = diamond(20, 20, 8) | diamond(20, 60, 8) | {(20, c) for c in range(29, 52)} | {(r, 60) for r in range(29, 40)}
    _, _, orders = orders_of(spark, cells, [(39, 60)])
    found = [k for _, k, o in kinds(orders) if o == 4]
    assert found.count("connector") == 1 and found.count("ring") == 2 and found.count("trunk") == 1
    leaves = diamond(20, 20, 8) | {(20, c) for c in range(29, 52)}
    _, _, orders = orders_of(spark, leaves)
    assert [(k, o) for _, k, o in kinds(orders)] == [("leaf", 1), ("ring", 4)]


def test_isolated_cells_go_and_isolated_segments_stay(spark):
    cells = {(5, 5)} | {(10, c) for c in range(10)}
    chains, segments, orders = orders_of(spark, cells)
    assert [(k, o) for _, k, o in kinds(orders)] == [("isolated", 1)]
    assert [x.sinuous_len for x in network.segment_lengths(chains, segments, orders).collect()] == [9.0]


def test_outlets_hold_a_trunk_until_the_end(spark):
    cells = {(r, 10) for r in range(10, 21)} | {(9 - i, 9 - i) for i in range(8)} | {(9 - i, 11 + i) for i in range(8)}
    _, _, orders = orders_of(spark, cells, [(20, 10)])
    assert sorted((k, o) for _, k, o in kinds(orders)) == [("leaf", 1), ("leaf", 1), ("leaf", 2)]


def plain_path(cells, start, end):
    """Cells of a path of the fewest steps."""
    before, todo = {start: None}, deque([start])
    while todo:
        p = todo.popleft()
        for q in sorted((p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if q in cells and q not in before:
                before[q] = p
                todo.append(q)
    path = [end]
    while before[path[-1]] is not None:
        path.append(before[path[-1]])
    return path[::-1]


def plain_anchor(path):
    n = len(path)
    if n <= 3:
        (r, c), (er, ec) = path[0], path[-1]
        return (r, c, r + (ec - c), c - (er - r), r - (ec - c), c + (er - r))
    d = np.cumsum([0.0] + [np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:])])
    near = sorted(p for p, x in zip(path, d) if abs(x - round(float(np.mean(d)))) <= 0.9)
    m = near[len(near) // 2]
    off = sorted(p for i, p in enumerate(path) if abs(i - path.index(m)) == round(n / 4))
    u, v = off[:2] if len(off) >= 2 else (path[0], path[-1])
    return (*m, m[0] + (u[1] - m[1]), m[1] - (u[0] - m[0]), m[0] + (v[1] - m[1]), m[1] - (v[0] - m[0]))


@pytest.mark.parametrize("corner", [False, True])
def test_anchors_of_a_ring_and_a_connector_equal_a_plain_path(spark, corner):
    ring = diamond(30, 30, 9) | ({(22, 31)} if corner else set())
    bend = [(50, c) for c in range(20)] + [(50 + i, 19 + i) for i in range(1, 8)] + [(57, c) for c in range(27, 33)] + ([(58, 32)] if corner else [])
    short = [(70, 70), (71, 71), (71, 72)]
    rows = [(0, r, c, i) for i, of in enumerate((ring, bend, short)) for r, c in of] + [(1, r, c, 1) for r, c in bend]
    chains = spark.createDataFrame(rows, "site_id long, r long, c long, seg long")
    closed = spark.createDataFrame([(0, 0)], "site_id long, seg long")
    paths = loops.path_cells(chains, closed)
    got = {(x.site_id, x.seg): tuple(x)[2:] for x in loops.xs_anchor_loop(paths).collect()}
    first = min(ring)
    sides = sorted(p for p in ring if p != first and max(abs(p[0] - first[0]), abs(p[1] - first[1])) == 1)
    cut = [first, *plain_path(ring - {first}, sides[0], sides[-1])]
    line = plain_path(set(bend), (50, 0), (58, 32) if corner else (57, 32))
    assert got[0, 0] == plain_anchor(cut)
    assert got[0, 1] == got[1, 1] == plain_anchor(line)
    assert got[0, 2] == plain_anchor(short)
    assert len(got) == 4
