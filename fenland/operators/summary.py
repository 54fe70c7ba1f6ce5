"""Summaries by order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MEASURES = ("sinuous_len", "sinuosity", "width", "depth", "area")


def sums_by_order(segments: DataFrame) -> list:
    n = F.count("*")
    mean = lambda c: (F.sum(c) / F.nullif(n.cast("double"), F.lit(0.0)))
    out = [n.alias("n_segments"), F.sum("sinuous_len").alias("total_sinuous_length"), mean("sinuous_len").alias("mean_sinuous_length"), mean("sinuosity").alias("mean_sinuosity")]
    out += [mean(c).alias(a) for c, a in (("width", "mean_width"), ("depth", "mean_depth"), ("area", "mean_xs_area"))]
    return out + [F.sum(F.col("straight_len")).alias("total_channel_length"), mean("straight_len").alias("mean_channel_length")]


def order_summary(segments: DataFrame) -> DataFrame:
    """A row for each (site, order): means are sums over the number of segments, so a null measure counts as 0."""
    return segments.groupBy("site_id", "ord").agg(*sums_by_order(segments))


def order_rollup(segments: DataFrame) -> DataFrame:
    """The same by (site, order), by site, and over all."""
    return segments.rollup("site_id", "ord").agg(F.grouping_id().alias("level"), *sums_by_order(segments))


def measure_means(segments: DataFrame) -> DataFrame:
    """Plain means of the measured values."""
    return segments.groupBy("site_id", "ord").agg(*(F.avg(c).alias(f"avg_{c}") for c in MEASURES))


def angle_means(angles: DataFrame) -> DataFrame:
    """Mean angle by order; zeros are no angles."""
    return angles.groupBy("site_id", "ord").agg(F.avg(F.nullif(F.col("angle"), F.lit(0.0))).alias("mean_angle"))


def vector_length(segments: DataFrame) -> DataFrame:
    """0.2 of the mean sinuous length of order 2, rounded half to even."""
    return segments.where("ord = 2").groupBy("site_id").agg(F.bround(F.avg("sinuous_len") * 0.2).alias("vector_length"))


def threshold_table(params: DataFrame) -> DataFrame:
    return params.select("site_id", F.expr("stack(3, 'cth', cth, 'lzth', lzth, 'hzth', hzth) as (threshold, value)"))


def threshold_areas(thresholds: DataFrame, curves: DataFrame) -> DataFrame:
    """(site_id, threshold, value, area): the cumulative area of the slope curve at cth and of the elevation curve at lzth and
    hzth, at the edge nearest to the value, the lower of two."""
    named = thresholds.withColumn("kind", F.when(F.col("threshold") == "cth", "slope").otherwise("z"))
    near = named.join(curves, ["site_id", "kind"]).groupBy("site_id", "threshold", "value")
    return near.agg(F.min_by("cum_area", F.struct(F.abs(F.col("edge") - F.col("value")), "bin")).alias("area"))


def count_segments(segments: DataFrame) -> DataFrame:
    return segments.groupBy("site_id", "ord").agg(F.count("*").alias("n_segments"))
