"""Boilerplate lines by site-relative frequency, in DataFrame operations only.

Group by host, divide the number of a host's pages that hold a line by the
number of its pages, and drop lines above a ratio.  A line is a text between
line feeds, compared without blanks, tabs and carriage returns at its ends; a
line without anything else, or on one page alone, is never dropped.

Scale: lines are counted by 128 bits of hash, once per page, with partial sums
before the shuffle, so a host or line with a third of all rows costs no task
more than others.  Only (host, line) counts that reach ``min_pages`` are joined
with the host totals.  The hashes of lines come back to the pages by a join
that AQE may split; texts are shuffled once, by page.

Defined results: a null host is a site of its own (the same as an empty name);
a null text stays null and counts as a page without lines; an empty text stays
empty; rows that repeat are pages of their own; a page all of whose lines go
has an empty text; an empty table gives an empty result.  Columns beyond those
named are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized

RATIO = 0.05
#: A line that one page alone holds is no boilerplate, however few pages its host has.
MIN_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line, null for blank ones."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line) of the lines to drop, from ``pages`` (host, lines: array of keys)."""
    counts = (
        pages.select("host", F.explode(F.array_distinct(F.filter("lines", lambda k: k.isNotNull()))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("with_line"))
        .where(F.col("with_line") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, "host").where(F.col("with_line") > F.lit(ratio) * F.col("total")).select("host", "line")


def without_boilerplate(
    pages: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``pages`` with their boilerplate lines dropped from the text.

    Returns struct ``page`` with all columns as they were, ``n_lines``,
    ``n_dropped`` and ``text`` (what is left).
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    # A page has no key that is sure to be unique, so that a hash of its row stands for it; equal rows share one.
    hashable = [F.col(f"`{c}`") for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.struct(F.xxhash64(*hashable).alias("a"), F.xxhash64(F.lit("row"), *hashable).alias("b"))
    kept = pages.select(F.struct("*").alias("page"), host.alias("host"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    keyed = kept.select("row", "host", F.transform(_lines("text"), _key).alias("lines"))
    keyed = materialized(keyed, "line-keys")
    bad = boilerplate(keyed.select("host", "lines"), ratio, min_pages)
    placed = keyed.select("row", "host", F.posexplode("lines").alias("at", "line")).where("line IS NOT NULL")
    drops = placed.join(bad, ["host", "line"], "left_semi").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("drop"))
    joined = kept.join(drops, "row", "left")
    lines, drop = _lines(F.col("text")), F.coalesce("drop", F.array().cast("array<int>"))
    joined = joined.select("page", "text", lines.alias("lines"), drop.alias("drop"))
    # What stands between two dropped lines, for each pair of neighbours: linear in the lines.
    edges = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), F.col("drop")).alias("a"),
        F.concat(F.col("drop"), F.array(F.size("lines"))).alias("b"),
    )
    left = F.flatten(F.transform(edges, lambda e: F.slice("lines", e["a"] + 2, e["b"] - e["a"] - 1)))
    clean = F.when(F.size("drop") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        "page",
        F.when(F.col("text").isNotNull(), F.size("lines")).otherwise(0).cast("long").alias("n_lines"),
        F.size("drop").cast("long").alias("n_dropped"),
        clean.alias("text"),
    )


def oracle(table: str = "documents", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same over ``documents`` in SQL."""
    return f"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text FROM {table}),
lines AS (
  SELECT r, host, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos,
         unnest(string_split(text, chr(10))) AS line
  FROM pages WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines),
counts AS (SELECT host, bare, count(DISTINCT r) AS n FROM keyed WHERE bare <> '' GROUP BY host, bare),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
bad AS (SELECT host, bare FROM counts JOIN totals USING (host) WHERE n >= {min_pages} AND n > {ratio} * total),
marked AS (SELECT k.*, b.bare IS NOT NULL AS gone FROM keyed k LEFT JOIN bad b ON k.host = b.host AND k.bare = b.bare),
joined AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY r)
SELECT p.doc_id, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_dropped, 0) AS n_dropped, j.text
FROM pages p LEFT JOIN joined j USING (r)"""
