"""Positions on chains and shortest paths against plain searches."""

import heapq
import random

import pytest

from fenland.operators import network, paths, xsection


def frame(spark, cells, site=0):
    return spark.createDataFrame([(site, int(r), int(c)) for r, c in cells], "site_id long, r long, c long")


def near(cells, p):
    return sorted((p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (p[0] + a, p[1] + b) in cells)


def walk(r, n):
    """A random chain of n cells of which none has more than two neighbours."""
    while True:
        path = [(500, 500)]
        while len(path) < n:
            p = path[-1]
            free = [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (0, 1) if (a or b)]
            free = [q for q in free if q not in path and [x for x in near(set(path), q)] == [p]]
            if not free:
                break
            path.append(r.choice(free))
        if len(path) == n:
            return path


@pytest.mark.parametrize("n", [1, 2, 3, 150])
def test_positions_equal_hops(spark, n):
    r = random.Random(n)
    chains = [walk(r, n), walk(r, max(1, n // 3))]
    ring = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)]
    rows = [(s, p, q, 10 * s + i) for s in (0, 1) for i, c in enumerate(chains) for p, q in [(a, b + 2000 * i) for a, b in c]] + [(2, p, q, 7) for p, q in ring] + [(2, p + 50, q, 8) for p, q in ring]
    starts = [(0, *chains[0][0]), (0, chains[1][-1][0], chains[1][-1][1] + 2000), (1, *chains[0][n // 2]), (2, 0, 1)]
    got = {(x.site_id, x.seg, x.r, x.c): x.pos for x in paths.path_positions(spark.createDataFrame(rows, "site_id long, r long, c long, seg long"), spark.createDataFrame(starts, "site_id long, r long, c long")).collect()}
    want = {(0, 0, *p): i for i, p in enumerate(chains[0])}
    want |= {(0, 1, a, b + 2000): i for i, (a, b) in enumerate(chains[1][::-1])}
    want |= {(1, 10, *p): abs(i - n // 2) for i, p in enumerate(chains[0])}
    want |= {(2, 7, *p): min(i, 8 - i) for i, p in enumerate(ring)}
    assert got == want


def test_rounds_are_the_logarithm(spark, monkeypatch):
    done = []
    original = paths.written
    monkeypatch.setattr(paths, "written", lambda df, name, kept=False: (done.append(name), original(df, name, kept))[1])
    line = spark.createDataFrame([(0, 0, c, 1) for c in range(1000)], "site_id long, r long, c long, seg long")
    got = {x.c: x.pos for x in paths.path_positions(line, frame(spark, [(0, 0)])).collect()}
    assert got == {c: c for c in range(1000)}
    assert done.count("jumps") <= 12


def plain_length(cells, a, b):
    far, todo = {a: 0.0}, [(0.0, a)]
    while todo:
        d, p = heapq.heappop(todo)
        if d > far[p]:
            continue
        for q in near(cells, p):
            e = d + (1.0 if p[0] == q[0] or p[1] == q[1] else 2**0.5)
            if e < far.get(q, 1e18) - 1e-12:
                far[q] = e
                heapq.heappush(todo, (e, q))
    return far.get(b)


def test_corrections_take_shortest_paths(spark):
    """On random skeletons with knots, rings and pieces apart, from any cell to any cell."""
    r = random.Random(9)
    cells = {(r.randrange(22), r.randrange(22)) for _ in range(170)} | {(30, c) for c in range(20)} | {(30 + i, 25 + abs(3 - i)) for i in range(7)} | {(30 + i, 31 - abs(3 - i)) for i in range(7)}
    some = sorted(cells)
    fixes = [(0, i, *r.choice(some), *r.choice(some), 5) for i in range(14)] + [(0, 20, 30, 0, 30, 19, 2), (0, 21, 30, 5, 30, 5, 2)]
    skel = frame(spark, cells)
    got = {}
    for x in network.correction_paths(skel, spark.createDataFrame(fixes, "site_id long, id int, r1 long, c1 long, r2 long, c2 long, new_order int"), skel).collect():
        got.setdefault(x.id, []).append(x)
    for _, i, r1, c1, r2, c2, _ in fixes:
        want = plain_length(cells, (r1, c1), (r2, c2))
        if want is None:
            assert i not in got
            continue
        on = {(x.r, x.c) for x in got[i]}
        assert {abs(x.length - want) < 1e-9 for x in got[i]} == {True}
        assert {(r1, c1), (r2, c2)} <= on and on <= cells
        assert abs(plain_length(on, (r1, c1), (r2, c2)) - want) < 1e-9


def test_corrected_totals(spark):
    """The corrected path counts in its new order and no more in its old ones."""
    cells = {(r, 10) for r in range(10, 21)} | {(9 - i, 9 - i) for i in range(8)} | {(9 - i, 11 + i) for i in range(8)}
    skel = frame(spark, cells)
    chains, links, segments = network.segment_graph(skel, skel.withColumn("z", skel["r"] * 0.0), frame(spark, [(20, 10)]))
    orders = network.strahler_order(links, segments, 4)
    fix = spark.createDataFrame([(0, 1, 2, 2, 20, 10, 3)], "site_id long, id int, r1 int, c1 int, r2 int, c2 int, new_order int")
    ends = frame(spark, [(2, 2), (2, 18), (20, 10)])
    before = {(x.ord, x.seg): x.sinuous_len for x in network.segment_lengths(chains, segments, orders).collect()}
    after = {(x.ord, x.kind): x for x in network.corrected_lengths(chains, segments, orders, skel, fix, ends).collect()}
    assert sorted(o for o, _ in before) == [1, 1, 2]
    assert set(after) == {(1, "leaf"), (3, "corrected")}
    assert abs(after[3, "corrected"].sinuous_len - (8 * 2**0.5 + 10)) < 1e-9
    assert after[1, "leaf"].sinuous_len in before.values()
