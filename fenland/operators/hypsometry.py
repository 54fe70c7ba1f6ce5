"""Area by value of elevation and slope, and its point lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STEP, SLOPE_EDGES = 0.03, 200


def histogram_edges(cells: DataFrame, kind: str) -> DataFrame:
    """edges(site_id, bin, lo, hi): z by steps of 0.03 from 0.03 to below 0.03 + max; slope 200 even edges from min to max."""
    m = cells.groupBy("site_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi"))
    if kind == "z":
        n, edge = F.ceil(F.col("hi") / STEP).cast("int"), lambda i: F.lit(STEP) + i * F.lit(STEP)
    else:
        n, edge = F.lit(SLOPE_EDGES), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / F.lit(float(SLOPE_EDGES - 1))
    return m.where("hi is not null").withColumn("bin", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))).select("site_id", "bin", edge(F.col("bin")).alias("edge"), edge(F.col("bin") + 1).alias("next"))


def histogram_area(cells: DataFrame, kind: str, gs: float) -> DataFrame:
    """curve(site_id, kind, bin, edge, area, cum_area): cells in (edge, next] times gs squared, by the lower edge; the last is 0.

    The bin is found by arithmetic and checked against the edges of its neighbours, so a rounded quotient cannot misplace it.
    """
    edges = histogram_edges(cells, kind)
    m = cells.groupBy("site_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi"))
    v = F.col(kind)
    guess = F.floor(v / STEP) - 1 if kind == "z" else F.floor((v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * (SLOPE_EDGES - 1))
    near = cells.where(v.isNotNull()).join(m, "site_id").select("site_id", v.alias("v"), guess.cast("int").alias("g")).groupBy("site_id", "v", "g").agg(F.count("*").alias("n"))
    near = near.withColumn("bin", F.explode(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1)))
    counts = near.join(edges, ["site_id", "bin"]).where("v > edge and v <= next").groupBy("site_id", "bin").agg(F.sum("n").alias("n"))
    last = Window.partitionBy("site_id")
    curve = edges.join(counts, ["site_id", "bin"], "left").withColumn("top", F.max("bin").over(last)).withColumn("area", F.when(F.col("bin") == F.col("top"), 0.0).otherwise(F.coalesce("n", F.lit(0)) * gs * gs))
    run = Window.partitionBy("site_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return curve.select("site_id", F.lit(kind).alias("kind"), "bin", "edge", "area", F.sum("area").over(run).alias("cum_area"))


def nearest_point(curve: DataFrame, area: float) -> DataFrame:
    """The curve's bin whose cumulative area is nearest; the lower bin of two."""
    return curve.groupBy("site_id", "kind").agg(F.min_by(F.struct("bin", "edge", "cum_area"), F.struct(F.abs(F.col("cum_area") - area), "bin")).alias("p")).select("site_id", "kind", "p.*")
