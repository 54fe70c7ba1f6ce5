"""Quality rules with cross-document line frequency (operator 2). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .linededup import LINES_SQL
from .lines import BLANKS, TRIM, raw_lines, with_line_marks

#: A line is removed from pages of a host that has it on more than SHARE of its pages and on LEAST or more of them.
SHARE, LEAST = 0.02, 3
#: A document is depleted if less than this share of its words is left without such lines.
LEFT = 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def word_list(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIM)), BLANKS + "+"), lambda w: w != "")


def with_quality(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """docs with the columns of the base rules, n_left_words, base_failed and kept, all with the prefix _fl_.

    Null and empty texts have no words and fail the base. Repeated rows are treated alike; other columns, also of the names
    of the results, are left alone. A text's 8-word windows are compared by 64-bit hashes within the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    known = with_line_marks(docs, source, text, SHARE, LEAST)
    a = known.withColumn("_fl_words", word_list(F.col(text))).withColumn("_fl_lines_all", F.filter(raw_lines(t), lambda x: F.btrim(x, F.lit(TRIM)) != ""))
    n = F.size("_fl_words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_fl_words"), i, WINDOW))))
    a = a.withColumn("_fl_windows", windows)
    some = F.size(F.array_distinct("_fl_windows")) < F.size("_fl_windows")
    order = F.when(some, F.sort_array(F.transform("_fl_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    a = a.withColumn("_fl_order", order)
    near = lambda i, j: F.coalesce(F.get("_fl_order", i)["h"] == F.get("_fl_order", j)["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("_fl_order", lambda x, i: near(i, i - 1) | near(i, i + 1)), lambda x: x["i"]))
    a = a.withColumn("_fl_twice", twice)
    # A repeated window adds the words up to the next one, 8 at most.
    covered = F.aggregate("_fl_twice", F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum"), i.alias("last")), lambda acc: acc["sum"])
    # Named twice, so that the marks are not made again for each line.
    gone = F.filter(raw_lines(t), lambda x, i: F.coalesce(F.get("_fl_marks", i), F.lit(False)))
    a = a.withColumn("_fl_gone", F.when(F.size("_fl_marks") > 0, gone))
    lost = F.coalesce(F.aggregate("_fl_gone", F.lit(0), lambda acc, x: acc + F.size(word_list(x))), F.lit(0))
    long = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, TRIM, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size("_fl_lines_all") - F.size(F.array_distinct("_fl_lines_all")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_left_words": n - lost,
    }
    a = a.withColumns({f"_fl_{k}": v.cast("long") for k, v in long.items()})
    failed = (F.col("_fl_n_words") < 20) | (100 * F.col("_fl_n_repeat_words") > 30 * F.col("_fl_n_words"))
    a = a.withColumn("_fl_base_failed", failed).withColumn("_fl_kept", ~failed & (F.col("_fl_n_left_words") >= LEFT * F.col("_fl_n_words")))
    return a.drop("_fl_words", "_fl_lines_all", "_fl_windows", "_fl_order", "_fl_twice", "_fl_gone", "_fl_marks")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left_words")


def query(docs: DataFrame) -> DataFrame:
    return with_quality(docs.select("doc_id", "source", "text")).select("doc_id", *(F.col(f"_fl_{k}").alias(k) for k in RESULTS))


def keep_good(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns as they are."""
    # A filter is not pushed below a projection that is not deterministic; pushed, it would have all arrays made again for
    # each of their elements.
    known = with_quality(docs, source, text).withColumn("_fl_row", F.monotonically_increasing_id())
    return known.where(F.col("_fl_kept") & (F.col("_fl_row") >= 0)).select(*docs.columns)


SQL = (
    "WITH " + LINES_SQL.format(least=LEAST, share=f"CAST({SHARE} AS DOUBLE)") + r""",
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT rid, pos, list_aggregate(words[pos:pos + 7], 'string_agg', ' ') AS w
        FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS pos FROM d WHERE len(words) >= 8)),
rep AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, pos - before)) AS n FROM (SELECT rid, pos, coalesce(lag(pos) OVER (PARTITION BY rid ORDER BY pos), -8) AS before FROM rep) GROUP BY rid),
ln AS (SELECT rid, host, line, regexp_replace(lower(trim(line, E' \t\n\x0b\f\r')), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
       FROM (SELECT rid, host, unnest(string_split(text, E'\n')) AS line FROM d)),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln WHERE norm <> '' GROUP BY rid),
lost AS (SELECT rid, sum(len(regexp_extract_all(ln.line, '[^\x20\x09-\x0D]+'))) AS n FROM ln JOIN frequent f ON f.host = ln.host AND f.line = ln.norm GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(list_aggregate(words, 'string_agg', '')) AS BIGINT) AS chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(words) - coalesce(lost.n, 0) AS BIGINT) AS n_left_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_left_words >= """ + f"{LEFT}" + r""" * n_words AS kept, n_left_words FROM m"""
)
