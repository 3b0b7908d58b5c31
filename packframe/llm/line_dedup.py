"""Line dedup by site-relative frequency.

Pages are grouped by host.  A line's ratio is the number of the host's pages
that contain it over the host's pages; lines above ``ratio`` that are on at
least ``min_pages`` pages of the host are boilerplate there, and are dropped
from its pages.  Lines are compared without white space around them; blank
lines are never boilerplate.  Kept lines stay as they were, in their order.

A host's list is short however large the host (at most lines per page / ratio),
so the lists are joined to the pages, not the lines: by broadcast where all
lists fit, else by a shuffle on the host.

Null text stays null, empty text stays empty; a page that is all boilerplate
becomes empty.  Pages with a null host form one host of their own.  Repeated
rows count as pages.  Columns other than the two named pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packframe.llm.common import BROADCAST_BYTES, checkpoint, fresh, ref

RATIO, MIN_PAGES = 0.05, 5


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h, n_pages, host_pages, ratio) of the lines to drop, h the 64-bit hash that stands for the line.

    Lines are counted and dropped by hash: what is shuffled is 16 bytes a host and
    line.  A line that isn't boilerplate goes only if it shares its hash with one of its
    host's, at most (lines a page / ratio) lines: for a page of 1000 lines and a ratio
    of 1 in 20, a chance of 1 in 10**15 a line.
    """
    table = pages.select(ref(pages, host).alias("host"), ref(pages, text).cast("string").alias("t"))
    totals = checkpoint(table.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")))
    page_lines = table.select("host", F.explode(F.array_distinct(F.transform(lines(F.col("t")), key))).alias("line")).filter("line <> ''")
    counts = page_lines.groupBy("host", F.xxhash64("line").alias("h")).agg(F.count(F.lit(1)).alias("n_pages"))
    likely = counts.filter(F.col("n_pages") >= min_pages)
    likely = likely.join(F.broadcast(totals) if totals.count() * 64 <= BROADCAST_BYTES else totals, likely["host"].eqNullSafe(totals["host"])).drop(totals["host"])
    likely = likely.filter(F.col("n_pages") > F.col("host_pages") * ratio)
    return likely.withColumn("ratio", F.col("n_pages") / F.col("host_pages"))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None) -> DataFrame:
    """The pages with their boilerplate lines dropped; ``dropped`` names a column to add for how many went."""
    at, listed, kept, rest = fresh(pages, "_host", "_lines", "_kept", "_text")
    found = boilerplate(pages, host, text, ratio, min_pages)
    lists = checkpoint(found.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias(listed)).select(F.col("host").alias(at), listed))
    size = lists.agg(F.sum(F.size(listed) * 8 + 64)).first()[0] or 0
    joined = pages.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, ref(pages, host).eqNullSafe(F.col(at)), "left")
    # no list: every line is kept, and the text isn't taken apart
    joined = joined.withColumn(kept, F.when(F.col(listed).isNotNull(), F.filter(lines(ref(pages, text)), lambda x: ~F.array_contains(listed, F.xxhash64(key(x))))))
    joined = joined.withColumn(rest, F.when(F.col(kept).isNull(), ref(pages, text)).otherwise(F.array_join(kept, "\n")))
    extra = [] if dropped is None else [F.coalesce(F.size(lines(ref(pages, text))) - F.size(kept), F.lit(0)).alias(dropped)]
    return joined.select(*[F.col(rest).alias(c) if c == text else ref(pages, c) for c in pages.columns if c != dropped], *extra)


SQL = f"""
WITH l AS (
  SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM documents),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line),
t AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
b AS (SELECT source, list(line) AS bl FROM c JOIN t USING (source) WHERE n >= {MIN_PAGES} AND n > host_pages * {RATIO}::DOUBLE GROUP BY source),
k AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines, bl FROM documents LEFT JOIN b USING (source)),
f AS (SELECT *, CASE WHEN bl IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bl, trim(x, ' ' || chr(9) || chr(13)))) END AS kept FROM k)
SELECT doc_id, source, (len(lines) - len(kept))::INT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM f
"""
