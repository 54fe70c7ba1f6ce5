"""Line dedup by site-relative frequency (operator 6). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lines import raw_lines, with_line_marks

#: A line goes if it stands on more than RATIO of its host's pages; LEAST pages are what tells a line from one that repeats by chance.
RATIO, LEAST = 0.02, 3


def drop_boilerplate_lines(docs: DataFrame, source: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """docs with text without the lines that stand on more than ratio of the host's pages and on least or more of them.

    Every row and column stays; _fl_kept has the lines that stay and _fl_n_lines their number before. A null text stays
    null with null counts, an empty text stays empty; the other lines, blank ones too, keep their order and bytes. Every
    row is a page of its host; null hosts are the host ''. Repeated rows are treated alike.
    """
    known = with_line_marks(docs, source, text, ratio, least)
    lines = raw_lines(F.col(text))
    keep = F.filter(lines, lambda x, i: ~F.coalesce(F.get("_fl_marks", i), F.lit(False)))
    return known.withColumn("_fl_n_lines", F.size(lines)).withColumn("_fl_kept", F.when(F.size("_fl_marks") > 0, keep).otherwise(lines)).withColumn(text, F.array_join("_fl_kept", "\n")).drop("_fl_marks")


def query(docs: DataFrame) -> DataFrame:
    out = drop_boilerplate_lines(docs.select("doc_id", "source", "text"))
    lost = F.col("_fl_n_lines") - F.size("_fl_kept")
    return out.select("doc_id", "source", F.when(F.col("text").isNotNull(), F.col("_fl_n_lines").cast("long")).alias("n_lines"), F.when(F.col("text").isNotNull(), lost.cast("long")).alias("n_dropped"), "text")


#: The lines CTE is shared with the quality rules.
LINES_SQL = r"""
pages AS (SELECT row_number() OVER () AS page, coalesce(source, '') AS host, text FROM documents),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
page_lines AS (SELECT DISTINCT host, page, regexp_replace(lower(trim(line, E' \t\n\x0b\f\r')), '[\x20\x09-\x0D]+', ' ', 'g') AS line
               FROM (SELECT host, page, unnest(string_split(text, E'\n')) AS line FROM pages)),
frequent AS (SELECT host, line FROM page_lines JOIN totals USING (host) WHERE line <> ''
             GROUP BY host, line HAVING count(*) >= {least} AND count(*) > {share} * max(pages))"""

SQL = (
    "WITH " + LINES_SQL.format(least=LEAST, share=f"CAST({RATIO} AS DOUBLE)") + r""",
split AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, E'\n') AS lines FROM documents),
each AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos, coalesce(source, '') AS host FROM split),
stay AS (SELECT rid, string_agg(e.line, E'\n' ORDER BY pos) FILTER (f.line IS NULL) AS text, count(*) AS n_lines, count(f.line) AS n_dropped
         FROM each e LEFT JOIN frequent f ON f.host = e.host
          AND f.line = regexp_replace(lower(trim(e.line, E' \t\n\x0b\f\r')), '[\x20\x09-\x0D]+', ' ', 'g') GROUP BY rid)
SELECT doc_id, source, n_lines, n_dropped, CASE WHEN split.text IS NOT NULL THEN coalesce(stay.text, '') END AS text
FROM split LEFT JOIN stay USING (rid)"""
)
