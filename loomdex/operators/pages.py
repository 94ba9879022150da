"""Pages of PDF and Office documents: running headers and page numbers out, titles marked, paragraphs joined, chunks cut.

A page is a row and its lines an array, worked on in the row by built-in functions. What repeats over pages is counted in one
aggregate by document and line over the few lines at page edges; at most twelve lines of a document can be on half of its pages,
so they come back to the pages as one small array for each document.

Null texts are empty pages. Line ends may be LF, CR LF or CR.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import chunking as K

LONGEST, SHARE = 120, 0.5


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")


def _edges(filled: Column) -> Column:
    """Of the places of filled lines, the first and the last two if there are up to five, else three and three."""
    n = F.size(filled)
    few = n <= 5
    top, bottom = F.when(few, 1).otherwise(3), F.when(few, 2).otherwise(3)
    return F.array_union(F.slice(filled, F.lit(1), top), F.slice(filled, F.greatest(n - bottom + 1, F.lit(1)), bottom))


def lined(pages: DataFrame) -> DataFrame:
    """Pages with their lines, these in normal form, the places of filled ones and of those at the edges."""
    p = pages.withColumn("_lines", _lines(F.col("text"))).withColumn("_normal", F.transform("_lines", X.normal_line))
    places = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.get("_normal", i) != "")
    return p.withColumn("_filled", places).withColumn("_edge", _edges(F.col("_filled")))


def running_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, running): the edge lines on at least two and at least half of a document's pages; documents without any are left out."""
    p = lined(pages)
    mine = F.array_distinct(F.filter(F.transform("_edge", lambda i: F.get("_normal", i)), lambda x: F.char_length(x) <= LONGEST))
    # the row of a page itself, under an empty line, counts the document's pages
    each = p.select("doc_id", F.explode(F.array_append(mine, F.lit(""))).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    # over the counts, not by a join with them, for which all pages would be read and cut into lines once more
    total = F.max(F.when(F.col("line") == "", F.col("n"))).over(W.partitionBy("doc_id"))
    often = each.withColumn("_pages", total).where((F.col("line") != "") & F.col("doc_id").isNotNull() & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") * SHARE))))
    return often.groupBy("doc_id").agg(F.collect_list("line").alias("running"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) without running lines at their edges and without page numbers as first or last line."""
    names = pages.columns
    # texts are moved, not their lines
    p = lined(pages.join(running_lines(pages), "doc_id", "left"))
    running = F.coalesce("running", F.array().cast("array<string>"))
    ends = F.array(F.element_at("_filled", 1), F.element_at("_filled", -1))

    def stays(i):
        line = F.get("_normal", i)
        repeats = F.array_contains("_edge", i) & F.array_contains(running, line)
        number = F.array_contains(ends, i) & X.is_page_number(F.get("_lines", i))
        return (line == "") | ~(repeats | number)

    left = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), stays)
    filled = F.size("_filled") > 0  # an array of nothing has no first element
    text = F.when(filled, F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")).otherwise(F.array_join("_lines", "\n"))
    return p.withColumn("text", text).select(*names)


def paragraphs(text: Column) -> Column:
    """The text in paragraphs: line ends and blanks made alike, words broken at line ends mended, titles as headings of their own,
    wrapped lines joined; Markdown tables keep their lines."""
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x00", ""), r"\r\n?|\f", "\n")
    t = X.dehyphenate(F.translate(t, "\u00a0", " "))
    line = lambda x: F.when(X.is_section_title(x), F.concat(F.lit("\n# "), x, F.lit("\n"))).otherwise(x)
    lines = F.transform(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), line)
    parts = F.split(F.array_join(lines, "\n"), r"\n\s*\n+")

    def whole(p):
        table = p.rlike(r"(?m)^\|[^\n]+\|\n\|[-:\s|]+\|")
        return F.regexp_replace(F.when(table, p).otherwise(F.regexp_replace(p, r"\n+", " ")), r"[ \t]{2,}|\t", " ")

    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(F.transform(parts, whole), lambda p: p != ""), "\n\n")


def with_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages with the usable tables (doc_id, page, seq, rows) that were found on them below their text, as Markdown."""

    @F.pandas_udf("string")
    def rendered(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: K.render_table([list(x) for x in r]))

    good = tables.where(X.usable_table(F.col("rows"))).select("doc_id", "page", "seq", rendered("rows").alias("_table"))
    good = good.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "_table"))).alias("_tables"))
    below = F.transform("_tables", lambda t: t["_table"])
    own = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    text = F.array_join(F.filter(F.concat(F.array(own), F.coalesce(below, F.array().cast("array<string>"))), lambda x: x != ""), "\n\n")
    return pages.join(good, ["doc_id", "page"], "left").withColumn("text", text).select(*pages.columns)


def page_chunks(pages: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, page, chunk_index, content) of pages, cleaned and in paragraphs; tables over four fifths of a chunk are split by rows."""
    K.check(size, overlap)

    @F.pandas_udf("array<string>")
    def cut(col: pd.Series) -> pd.Series:
        return col.map(lambda t: K.chunks(K.split_tables(t, int(size * 0.8)), size, overlap) if t else [])

    text = clean_pages(pages).select("doc_id", "page", paragraphs(F.col("text")).alias("text"))
    return text.select("doc_id", "page", F.posexplode(cut("text")).alias("chunk_index", "content"))
