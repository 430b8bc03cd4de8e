"""Boilerplate lines by their frequency within a host; DataFrame functions only.

For each host, the pages that contain a line are divided by the pages of the
host; lines above a ratio are dropped.  Each row is a page.  With
``copies_once`` rows of equal text are one page: where near-duplicate removal
follows, a text that is often copied is no boilerplate, and nothing would be
left of it to be found.  Lines are compared without the blanks around them, and
pages whole, by a 64-bit hash and their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Boilerplate lines that are broadcast (8 bytes each); with more, pages and lines meet by a shuffle on the host and one of SALTS numbers.
BROADCAST_LINES, SALTS = 1 << 20, 64


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _keys(text: str) -> Column:
    """A number for each line: the hash of its length and of what stands in it; 0 for blank lines.

    Numbers, as distinct structs would be found by comparing all with all.
    """
    return F.transform(_lines(text), lambda x: F.when(_bare(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.length(_bare(x)), _bare(x))))


def boilerplate_lines(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int = 1, copies_once: bool = False) -> DataFrame:
    """The lines to drop: ``host, line (see _keys), pages, host_pages``."""
    pages = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("n")).alias("page"), F.col(text).alias("text"))
    number = F.count_distinct("page") if copies_once else F.count("*")
    totals = pages.groupBy("host").agg(number.alias("host_pages"))
    each = pages.select("host", "page", F.explode(F.array_distinct(_keys("text"))).alias("line")).where("line <> 0")
    if copies_once:
        # The page is part of the key of the first exchange, so a line on a third of all pages is dealt out evenly.
        each = each.distinct()
    counts = each.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, counts["host"].eqNullSafe(totals["host"])).select(counts["host"], "line", "pages", "host_pages").where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 1, copies_once: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text`` and, with ``counts``, ``n_lines`` and ``n_dropped``.

    A line is dropped where more than ``ratio`` of its host's pages, and ``min_pages`` at least,
    contain it; each page counts once, however often it repeats the line.  A share of exactly
    ``ratio`` stays.  Blank lines stay.  Null hosts are one host of their own.  A null text stays null,
    has no lines and is no page; an empty text has one line, an empty one.  Repeated rows are pages
    each, unless ``copies_once``.  Very long texts are taken whole.  An empty table gives none.  Other
    columns pass through, whatever their names; columns named as the counts are replaced by them.
    """
    found = materialize(boilerplate_lines(docs, host, text, ratio, min_pages, copies_once).select("host", "line"), "boilerplate")
    n = found.count()
    # At most (lines of a page) / ratio lines of one host can pass, so the arrays are bounded whatever the host's size.
    by_host = found.groupBy(F.col("host").alias("h")).agg(F.collect_set("line").alias("drop"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("own"), F.col(text).alias("text"))
    if n <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(by_host), F.col("own").eqNullSafe(F.col("h")), "left")
    else:
        by_host = by_host.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        rows = rows.join(by_host, F.col("own").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("part")), "left")
    key = lambda x: F.xxhash64(F.length(_bare(x)), _bare(x))
    kept = F.when(F.col("drop").isNull(), _lines("text")).otherwise(F.filter(_lines("text"), lambda x: ~F.array_contains(F.col("drop"), key(x))))
    rows = rows.select("row", "text", kept.alias("kept"))
    size = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("long")
    new = {"n_lines": size(_lines("text")), "n_dropped": size(_lines("text")) - size(F.col("kept"))} if counts else {}
    old = [(F.array_join("kept", "\n") if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c not in new]
    return rows.select(*old, *[c.alias(name) for name, c in new.items()])


def line_dedup_sql(ratio: float, min_pages: int = 1, copies_once: bool = False) -> str:
    """DuckDB SQL for the query over documents."""
    once = "DISTINCT source, text," if copies_once else "source,"
    return f"""
WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT {once} unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM l WHERE text IS NOT NULL),
t AS (SELECT source, count({"DISTINCT " if copies_once else ""}text) AS n FROM l GROUP BY source),
c AS (SELECT source, line, count(*) AS pages FROM e WHERE line <> '' GROUP BY source, line),
b AS (SELECT c.source, list(c.line) AS drop_lines FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE c.pages >= {min_pages} AND c.pages > {ratio}::DOUBLE * t.n GROUP BY c.source),
k AS (SELECT l.doc_id, l.source, l.text, l.lines, CASE WHEN b.drop_lines IS NULL THEN l.lines ELSE
      list_filter(l.lines, lambda x: NOT list_contains(b.drop_lines, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
      FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
CASE WHEN text IS NULL THEN 0 ELSE len(lines) END::BIGINT AS n_lines,
CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END::BIGINT AS n_dropped FROM k"""
