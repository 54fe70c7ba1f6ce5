"""No side of a join goes through the driver for the size of its files: cells compress to a byte or less a row."""

import pytest
from pyspark.sql import functions as F

from fenland.functions.tables import MEASURED, PLANNED, written
from fenland.operators import network
from fenland.plans import registry

#: Bytes up to which a side is broadcast here; of cells that is at most MOST rows, in files it would be tens of times as many.
BYTES = 200_000
MOST = BYTES // 24
SITES = 400


@pytest.fixture
def threshold(spark):
    before = spark.conf.get(PLANNED)
    spark.conf.set(PLANNED, str(BYTES))
    yield
    assert spark.conf.get(PLANNED) == str(BYTES)
    assert spark.conf.get(MEASURED, None) is None
    spark.conf.set(PLANNED, before)


def largest_broadcast(spark, run):
    """The most rows that a broadcast of the jobs of run() held."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {e.executionId() for e in (store.executionsList().apply(i) for i in range(store.executionsList().size()))}
    before, most = ids(), 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for i in ids() - before:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for n in (nodes.apply(k) for k in range(nodes.size())):
            if n.name() == "BroadcastExchange":
                for m in (n.metrics().apply(k) for k in range(n.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def cells_of(spark, parts):
    """written(site_id, r, c) of SITES sites alike, by (r, c) of one."""
    one = spark.createDataFrame(sorted(parts), "r long, c long")
    return written(spark.range(SITES).withColumnRenamed("id", "site_id").crossJoin(one).repartition(4, "site_id").sortWithinPartitions("site_id", "r", "c"), "sites")


def grid(spark):
    return cells_of(spark, [(r, c) for r in range(12) for c in range(40)])


def crossing(spark):
    """A line along row 5 that forks, in every site."""
    return cells_of(spark, {(5, c) for c in range(1, 21)} | {(4 - i, 21 + i) for i in range(4)} | {(6 + i, 21 + i) for i in range(5)})


def network_of(spark):
    skel = crossing(spark)
    z = written(grid(spark).withColumn("z", F.col("c") * 1.0), "z")
    chains, links, segments = network.segment_graph(skel, z, skel.where("c = 1"))
    return skel, z, chains, segments, network.strahler_order(links, segments, 4)


def test_painting_broadcasts_no_grid(spark, threshold):
    chains = written(crossing(spark).where("r = 5").withColumn("seg", F.lit(1)), "chains")
    orders = chains.select("site_id", "seg").distinct().withColumn("ord", F.lit(1))
    found = []
    assert largest_broadcast(spark, lambda: found.append(network.paint_orders(chains, orders, grid(spark)).count())) <= MOST
    assert found == [SITES * (22 + 2 * 20)]


def test_contraction_broadcasts_no_skeleton(spark, threshold):
    skel = crossing(spark)
    z = written(grid(spark).withColumn("z", F.col("c") * 1.0), "z")
    found = []
    assert largest_broadcast(spark, lambda: found.append(network.segment_graph(skel, z, skel.where("c = 1"))[2].count())) <= MOST
    assert found == [SITES * 3]


def test_outlets_broadcast_no_border(spark, threshold):
    skel = crossing(spark)
    z = written(grid(spark).withColumn("z", F.col("c") * 1.0), "z")
    found = []
    assert largest_broadcast(spark, lambda: found.append([written(x, "outlets").count() for x in network.outlets(skel, z.where("r % 2 = 0"), 1, 12, 40)])) <= MOST
    assert found[0][1] == SITES


def test_lengths_broadcast_no_chains(spark, threshold):
    _, _, chains, segments, orders = network_of(spark)
    found = []
    assert largest_broadcast(spark, lambda: found.append(written(network.segment_lengths(chains, segments, orders), "lengths").count())) <= MOST
    assert found == [orders.select("site_id", "final").distinct().count()]


def corrections_of(skel):
    return skel.select("site_id").distinct().selectExpr("site_id", "1 AS id", "5 AS r1", "3 AS c1", "5 AS r2", "18 AS c2", "4 AS new_order")


def test_corrections_broadcast_no_cells(spark, threshold):
    skel = crossing(spark)
    painted = skel.withColumn("ord", F.lit(1))
    found = []
    assert largest_broadcast(spark, lambda: found.append(network.apply_corrections(painted, skel, corrections_of(skel), skel).where("ord = 4").count())) <= MOST
    assert found == [SITES * 16]


def test_corrected_segments_broadcast_no_cells(spark, threshold):
    skel = crossing(spark)
    found = []
    assert largest_broadcast(spark, lambda: found.append(network.corrected_segments(skel, corrections_of(skel), skel).select("sinuous_len", "straight_len").distinct().collect())) <= MOST
    assert [tuple(x) for x in found[0]] == [(15.0, 15.0)]


@pytest.mark.parametrize("name", ("workload_morphometry", "r10_corrected_morphometry"))
def test_morphometry_broadcasts_no_grid(spark, name):
    before = spark.conf.get(PLANNED)
    spark.conf.set(PLANNED, "24000")
    try:
        assert largest_broadcast(spark, lambda: registry.queries()[name](spark, "/root/testdata/sf0.001").count()) <= 1000
    finally:
        spark.conf.set(PLANNED, before)
