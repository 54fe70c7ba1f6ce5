"""Benchmark decontamination by spaced-seed hashing (operator 7). DataFrame functions only.

Words are lower-cased and stripped of what is neither letter nor digit. Fixed masks choose the words of a short span that
enter a seed; the others may be substituted. Wherever the words differ that the comparison below forgives, a mask still
fits between them, for items of any length sought; tests enumerate this. Seeds of benchmark items and of documents are joined on their hashes. A hit
gives a diagonal (document position minus item position), along which the aligned words are compared: a document is
contaminated by an item if a window of WINDOW aligned words, or the whole item if it is shorter, has MATCHES or more equal
words (in proportion for shorter items).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import sized_join, text_key, within_bytes, written

#: Word positions that enter a seed. The two hit every pattern of equal words that is accepted in windows of LEAST_WORDS to
#: WINDOW words; masks of five words would need three for 13 words alone.
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5))
#: Equal words asked of a window; items shorter than it are compared whole, in proportion.
WINDOW, MATCHES = 13, 10
#: Items with fewer words are too short to tell a leak from chance and are not sought.
LEAST_WORDS = 6


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seed_at(number: int, mask: tuple[int, ...]) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.xxhash64(F.lit(number), *(F.get("codes", i + F.lit(j)) for j in mask)).alias("seed"), i.alias("pos"))


def seeds(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """df(keys, tokens, codes) -> keys, seed, pos: a row for each mask and position it fits at."""
    n = F.size("codes")
    picked = []
    for m, mask in enumerate(MASKS):
        reach = mask[-1] + 1
        hashes = F.transform(F.sequence(F.lit(0), n - reach), seed_at(m, mask))
        picked.append(F.when(n >= reach, hashes).otherwise(F.array().cast("array<struct<seed:bigint,pos:int>>")))
    return df.select(*keys, F.explode(F.concat(*picked)).alias("s")).select(*keys, F.col("s.seed").alias("seed"), F.col("s.pos").alias(pos))


#: A document's row is known by its id and 128 bits of its text.
KEY = ["doc_id", "key1", "key2"]


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, key1, key2, item_id, n_equal, n_window), as contaminated has it for each text under each id."""
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("tokens")).where(F.size("tokens") >= LEAST_WORDS)
    items = written(items.groupBy("tokens").agg(F.min("item_id").alias("item_id")).withColumn("codes", F.transform("tokens", lambda w: F.xxhash64(w))).withColumn("item", F.monotonically_increasing_id()), "items")
    slim = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text).cast("string")), tokens(F.col(text)).alias("tokens"))
    coded = slim.select(*KEY, F.transform("tokens", lambda w: F.xxhash64(w)).alias("codes"))
    probe = written(seeds(items, ["item"], "ipos"), "item-seeds")
    hits = sized_join(seeds(coded, KEY, "dpos"), probe, "seed", "inner")
    # Pre-aggregated before it is dealt: a row for each document, item and diagonal.
    diagonals = written(hits.groupBy(*KEY, "item", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.count("*").alias("hits")), "diagonals")
    same = coded["doc_id"].eqNullSafe(diagonals["doc_id"]) & (coded["key1"] == diagonals["key1"]) & (coded["key2"] == diagonals["key2"])
    near = sized_join(coded, diagonals, same, "inner").select(*(coded[k] for k in KEY), "codes", "item", "shift")
    both = near.join(within_bytes(items.select("item", "item_id", F.col("codes").alias("icodes"))), "item")
    equal = F.transform("icodes", lambda c, i: F.when((i + F.col("shift") >= 0) & F.coalesce(F.get("codes", i + F.col("shift")) == c, F.lit(False)), 1).otherwise(0))
    both = both.select(*KEY, "item_id", equal.alias("equal"))
    width = F.least(F.lit(WINDOW), F.size("equal"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - width + 1), lambda i: F.aggregate(F.slice("equal", i, width), F.lit(0), lambda a, x: a + x)))
    both = both.withColumn("n_window", width).withColumn("n_equal", best).where(F.col("n_equal") * WINDOW >= F.col("n_window") * MATCHES)
    return both.groupBy(*KEY, "item_id").agg(F.max("n_equal").cast("long").alias("n_equal"), F.max("n_window").cast("long").alias("n_window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_equal, n_window): for each contaminated document and item text its best window.

    Items of equal words are one item, of the smallest id. Texts are judged one by one; of several under one id, or without
    one, the best window of each item is reported. Empty and null texts match nothing.
    """
    rows = contaminated_rows(docs, benchmark, doc_id, text, item_id, item_text)
    return rows.groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.max("n_window").alias("n_window"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no item contaminates, with their columns as they are. A row goes for its own text alone, whatever
    other rows have its id."""
    leaked = written(contaminated_rows(docs, benchmark, doc_id, text, "item_id", "text").select(F.col("key1").alias("_fl_leak1"), F.col("key2").alias("_fl_leak2")).distinct(), "leaked")
    one, two = text_key(F.col(text).cast("string"))
    return sized_join(docs, leaked, (one == F.col("_fl_leak1")) & (two == F.col("_fl_leak2")), "left_anti")
