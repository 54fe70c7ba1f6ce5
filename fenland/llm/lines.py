"""Line statistics by site, used by the quality rules (operator 2) and the line dedup (operator 6). DataFrame functions only.

Lines are the pieces between \\n; a normalised line is lower-cased, its runs of blanks are one blank, its ends are trimmed.
Lines without a word are never counted or removed. Every document is a page of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import host_of, small, text_key, within_bytes, written

BLANKS = r"[\x20\x09-\x0D]"
#: For trim functions: the same characters.
TRIM = " \t\n\x0b\f\r"


def raw_lines(text: Column) -> Column:
    return F.split(text, "\n")


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(TRIM))), BLANKS + "+", " ")


def line_key(line: Column) -> Column:
    """A 64-bit key of the normalised line; null if it has no word."""
    normal = normal_line(line)
    return F.when(normal != "", F.xxhash64(normal))


#: The frequent lines of a host ride on its rows while no host has more than so many; beyond, each page is joined to its own.
HOST_LINES = 1_000
#: Of the pages' frequent lines those of this share or more are joined by broadcast where the others are not.
HOT_SHARE = 1e-6


def frequent_lines(docs: DataFrame, source: str, text: str, share: float, least: int) -> DataFrame:
    """(host, line, on): the keys of lines on more than share of their host's pages and on least or more, and on how many.

    Every document is a page, copies too; a line counts once a page. Counts are added up before they are dealt, so a line on
    a third of all pages is no hot task.
    """
    page = docs.select(host_of(F.col(source)).alias("host"), F.col(text).alias("text"))
    total = page.groupBy("host").agg(F.count("*").alias("pages"))
    keys = page.select("host", F.explode(F.array_distinct(F.transform(raw_lines(F.col("text")), line_key))).alias("line")).where("line is not null")
    count = keys.groupBy("host", "line").agg(F.count("*").alias("on"))
    # A line on at least `least` pages is kept for the join with the totals only.
    return count.where(F.col("on") >= least).join(total, "host").where(F.col("on") > share * F.col("pages")).select("host", "line", "on")


def places_of_lines(docs: DataFrame, found: DataFrame, source: str, text: str) -> DataFrame:
    """(host, key1, key2, at): for each text of a host the places, from 0 and ascending, of its lines that found has for the host.

    Copies share a row. Lines on HOT_SHARE or more of all, 1 / HOT_SHARE at most, are joined by broadcast, so that none is a hot
    key of the shuffle of the others; a text's places are gathered into sets before they are dealt.
    """
    lines = docs.select(host_of(F.col(source)).alias("host"), *text_key(F.col(text)), F.posexplode(F.transform(raw_lines(F.col(text)), line_key)).alias("at", "line")).where("line is not null")
    often = F.col("on") >= HOT_SHARE * (found.agg(F.sum("on")).first()[0] or 0)
    hits = lines.join(F.broadcast(found.where(often)), ["host", "line"], "left_semi").union(lines.join(found.where(~often), ["host", "line"], "left_semi"))
    return hits.groupBy("host", "key1", "key2").agg(F.sort_array(F.collect_set("at")).alias("at"))


def marks(at: Column) -> Column:
    """Ascending places as an array with true there and false between them; null for null."""
    gap = lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
    return F.flatten(F.transform(at, gap))


def with_line_marks(docs: DataFrame, source: str, text: str, share: float, least: int, host_lines: int = HOST_LINES) -> DataFrame:
    """docs with _fl_marks: for each place of raw_lines of text whether its line is frequent on the host; places past the end of
    the array are not, and null has none.

    The keys of each host's frequent lines are broadcast and searched if they are few in each host and small in bytes;
    beyond that each text is joined to the places of its own frequent lines. The marks are the same.
    """
    found = written(frequent_lines(docs, source, text, share, least), "frequent-lines")
    host = host_of(docs[source])
    if (found.groupBy("host").count().agg(F.max("count")).first()[0] or 0) <= host_lines and small(found):
        known = found.groupBy(F.col("host").alias("_fl_host")).agg(F.collect_list("line").alias("_fl_lines"))
        out = docs.join(F.broadcast(known), host == F.col("_fl_host"), "left").drop("_fl_host")
        each = F.transform(raw_lines(F.col(text)), lambda x: F.coalesce(F.array_contains("_fl_lines", line_key(x)), F.lit(False)))
        return out.withColumn("_fl_marks", F.when(F.col("_fl_lines").isNotNull(), each)).drop("_fl_lines")
    own = written(places_of_lines(docs, found, source, text).toDF("_fl_host", "_fl_key1", "_fl_key2", "_fl_at"), "line-places")
    one, two = text_key(docs[text])
    same = (host == own["_fl_host"]) & (one == own["_fl_key1"]) & (two == own["_fl_key2"])
    out = docs.join(within_bytes(own), same, "left").drop("_fl_host", "_fl_key1", "_fl_key2")
    return out.withColumn("_fl_marks", marks(F.col("_fl_at"))).drop("_fl_at")
