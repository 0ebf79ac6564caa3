"""Blocks of pages with the section and subsection they stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import SCIENTIFIC, Lexicon

NUMBERED = rf"^\d+(?:\.\d+)*{T.BLANK}+[A-Z][A-Za-z0-9 ,/\-&()]+$"
PLAIN = r"^[A-Z][A-Za-z0-9 ,/\-&()]+$"


def canonical_section(value: Column, lexicon: Lexicon = SCIENTIFIC) -> Column:
    """The first section of the lexicon that value names, else value itself in matchable form."""
    match = T.matchable(F.coalesce(value, F.lit("")))
    out = F
    for name, variants in lexicon.sections:
        out = out.when(T.contains_any(match, variants), F.lit(name))
    return out.otherwise(match) if lexicon.sections else match


def is_heading(paragraph: Column, lexicon: Lexicon = SCIENTIFIC) -> Column:
    p = T.normalized(paragraph)
    known = canonical_section(p, lexicon).isin([name for name, _ in lexicon.sections])
    return (T.word_count(p) <= 14) & (F.length(p) <= 140) & ~p.endswith(".") & (known | p.rlike(NUMBERED) | p.rlike(PLAIN) | T.is_upper(p))


def heading_level(heading: Column) -> Column:
    return F.when(heading.rlike(r"^\d+\.\d+"), 2).when(heading.rlike(rf"^\d+{T.BLANK}+"), 1).when(T.word_count(heading) <= 6, 1).otherwise(2)


def blocks(pages: DataFrame, lexicon: Lexicon = SCIENTIFIC, break_: str = r"\n{2,}", exclude_references: bool = True) -> DataFrame:
    """(doc_id, page_number, pos, text, is_heading, level, section, subsection, excluded) of cleaned pages.

    A section is the last heading of level 1 so far, "Front Matter" before any; a subsection is the last heading of level 2
    since. Windows are by document, so a task holds a document's blocks, as chunking needs anyway.
    """
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), break_, -1), T.stripped), lambda p: p != "")
    each = pages.select("doc_id", "page_number", F.posexplode(parts).alias("pos", "raw")).withColumn("text", T.normalized(F.col("raw"))).drop("raw")
    each = each.withColumn("is_heading", is_heading(F.col("text"), lexicon)).withColumn("level", F.when(F.col("is_heading"), heading_level(F.col("text"))))
    so_far = Window.partitionBy("doc_id").orderBy("page_number", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.coalesce(F.last(F.when(F.col("level") == 1, F.col("text")), ignorenulls=True).over(so_far), F.lit("Front Matter"))
    heading = F.last(F.when(F.col("is_heading"), F.struct("level", "text")), ignorenulls=True).over(so_far)
    out = each.withColumn("section", section).withColumn("_h", heading).withColumn("subsection", F.when(F.col("_h.level") == 2, F.col("_h.text"))).drop("_h")
    own = F.when(F.col("is_heading"), F.col("text")).otherwise(F.col("section"))
    return out.withColumn("excluded", (canonical_section(own, lexicon) == "references") if exclude_references else F.lit(False))
