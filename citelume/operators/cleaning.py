"""Cleaning of pages: repeated headers and footers, page numbers, broken words, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

HEADING = r"^(?:\d+(?:\.\d+)*)?[\t-\r\x1C-\x20]*[A-Z][A-Za-z0-9 ,/\-&()]+$"
PAGE_NUMBER = r"^(?:\d{1,4}|page[\t-\r\x1C-\x20]+\d{1,4}|[ivxlcdm]+)$"


def lines(text: Column) -> Column:
    """Normalised lines, blank ones included."""
    return F.transform(F.split(text, T.LINE_END, -1), T.normalized)


def is_page_number(line: Column) -> Column:
    return F.lower(line).rlike(PAGE_NUMBER)


def is_heading(line: Column) -> Column:
    """Looks like a heading: short, without a final stop, a capitalised or numbered line, or all upper case."""
    return (T.word_count(line) <= 14) & (F.length(line) <= 120) & ~line.endswith(".") & (line.rlike(HEADING) | T.is_upper(line))


def repeated_marginals(pages: DataFrame) -> DataFrame:
    """(doc_id, line, n, pages, is_header, is_footer): first or last two lines that at least 35 % of a document's pages
    share, two pages at least, and of less than 120 characters. Page numbers don't count."""
    filled = F.filter(lines(F.coalesce("text", F.lit(""))), lambda x: x != "")
    ends = pages.select("doc_id", filled.alias("x"))
    tops = F.transform(F.slice("x", 1, 2), lambda v: F.struct(F.lit("header").alias("kind"), v.alias("line")))
    bottoms = F.transform(F.when(F.size("x") > 2, F.slice("x", -2, 2)).otherwise(F.col("x")), lambda v: F.struct(F.lit("footer").alias("kind"), v.alias("line")))
    each = ends.select("doc_id", F.explode(F.concat(tops, bottoms)).alias("e")).select("doc_id", "e.*").filter(~is_page_number(F.col("line")))
    counted = each.groupBy("doc_id", "line").agg(F.count_if(F.col("kind") == "header").alias("tops"), F.count_if(F.col("kind") == "footer").alias("bottoms"))
    least = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).withColumn("least", F.greatest(F.lit(2), F.ceil(F.col("pages") * 35 / 100)))
    out = counted.join(least, "doc_id").filter(F.length("line") < 120)
    return out.select("doc_id", "line", "pages", (F.col("tops") >= F.col("least")).alias("is_header"), (F.col("bottoms") >= F.col("least")).alias("is_footer")).filter("is_header or is_footer")


def mended(text: Column) -> Column:
    """Carriage returns as newlines, words that a hyphen breaks over a line joined."""
    return F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def page_paragraphs(text: Column, marginals: Column) -> Column:
    """Paragraphs of a page: marginal lines and page numbers go, blank lines and headings end one, others are joined by a
    blank or, after a hyphen, glued."""
    kept = F.filter(lines(mended(text)), lambda x: (x == "") | ~(F.array_contains(marginals, x) | is_page_number(x)))
    # 2: a break, 1: a line's end inside a paragraph
    marked = F.transform(kept, lambda x: F.when(x == "", F.lit("\2")).when(is_heading(x), F.concat(F.lit("\2"), x, F.lit("\2"))).otherwise(x))
    joined = F.regexp_replace(F.array_join(marked, "\1"), "[\1\2]*\2[\1\2]*", "\2")
    merged = F.replace(F.replace(joined, F.lit("-\1"), F.lit("")), F.lit("\1"), F.lit(" "))
    return F.filter(F.transform(F.split(merged, "\2", -1), T.normalized), lambda p: p != "")


def clean_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_number, text) with cleaned text: paragraphs parted by an empty line. Other columns stay."""
    marks = repeated_marginals(pages).groupBy("doc_id").agg(F.collect_set("line").alias("_marginals"))
    out = pages.join(marks, "doc_id", "left").withColumn("_marginals", F.coalesce("_marginals", F.array().cast("array<string>")))
    body = T.normalized(F.array_join(page_paragraphs(F.coalesce("text", F.lit("")), F.col("_marginals")), "\n\n"))
    return out.withColumn("text", body).drop("_marginals")
