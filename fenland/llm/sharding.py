"""Sharding by proportional stratified interleaving (operator 5). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import host_of, sized_join, written

SHARDS, SEED = 8, 11
#: Rows of a bucket in which ranks are counted by a window; the number of buckets follows the input.
BUCKET = 4096


def starts(counts: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """counts(group, bucket, n) -> with start, the sum of n of the buckets before; two levels, so that no window is long."""
    two = counts.withColumn("_fl_super", (F.col(bucket) / BUCKET).cast("long"))
    upper = two.groupBy(*group, "_fl_super").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy(*group).orderBy("_fl_super").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select(*group, "_fl_super", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*group, "_fl_super").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return two.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(upper, [*group, "_fl_super"]).select(*group, bucket, (F.col("base") + F.col("own")).alias("start"))


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, host, shard, slot) for each row: shards differ by one row at most, each with the mixture of all.

    Rows of a source are ranked in the order of a seeded hash of id and text; a row's place is (rank - u) / rows of its
    source with a seeded u in (0, 1] for each source, so that the rows of many small sources do not meet in one place; all rows are ordered by place, then source and rank, and cut into equal shards. Ranks are counted in buckets of
    the hash and of the place, so neither a hot source nor the whole table is one window. Null sources are the source '';
    null texts have size 1 and the CRC of nothing; repeated rows are ranked each, in either order. Other columns are left out.
    """
    data = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), host_of(F.col(source)).alias("host"))
    rows = written(rows.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), 1)), "shard-rows")
    totals = written(rows.groupBy("host").agg(F.count("*").alias("of")), "shard-totals")
    n = totals.agg(F.sum("of")).first()[0] or 0
    rows = sized_join(rows, totals, "host", "inner").withColumn("bucket", bucket_of(F.shiftrightunsigned("key", 32), F.floor(F.col("of") / BUCKET) + 1))
    first = written(starts(rows.groupBy("host", "bucket").agg(F.count("*").alias("n")), ["host"], "bucket"), "shard-starts")
    own = Window.partitionBy("host", "bucket").orderBy("key", "doc_id", "text_crc32")
    ranked = sized_join(rows.withColumn("own", F.row_number().over(own)), first, ["host", "bucket"], "inner").withColumn("rank", F.col("start") + F.col("own"))
    placed = ranked.withColumn("place", (F.col("rank") - offset_of(seed)) / F.col("of")).withColumn("span", F.floor(F.col("place") * (n // BUCKET + 1)))
    placed = written(placed.select("doc_id", "size", "text_crc32", "host", "rank", "place", "span"), "shard-places")
    first = written(starts(placed.groupBy("span").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "span").drop("all"), "shard-spans")
    order = Window.partitionBy("span").orderBy("place", "host", "rank")
    out = sized_join(placed.withColumn("own", F.row_number().over(order)), first, "span", "inner").withColumn("at", F.col("start") + F.col("own") - 1)
    return out.withColumn("shard", F.expr(f"(at * {shards}) div {max(n, 1)}").cast("int")).withColumn("slot", F.col("at") - F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")).select("doc_id", "size", "text_crc32", "host", "shard", "slot")


def offset_of(seed: int) -> Column:
    """A number in (0, 1] by the source."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("host")), 11) + 1) * F.lit(2.0**-53)


def bucket_of(key31: Column, buckets: Column) -> Column:
    """Of buckets equal ranges of 31-bit keys."""
    return F.shiftright(key31 * buckets, 31)


def query(docs: DataFrame) -> DataFrame:
    return interleaved(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("host").alias("source"))
