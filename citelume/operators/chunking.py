"""Chunks of blocks under a token budget, with overlap, within a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T


def fragments(text: Column, budget: int) -> Column:
    """A block's text, or if it is over the budget, runs of sentences packed up to it; a longer sentence stays whole."""
    parts = F.transform(T.sentences(text), lambda s: F.struct(s.alias("s"), T.token_count(s).alias("n")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("run"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["run"]) > 0) & (a["n"] + x["n"] > budget)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(T.stripped(F.array_join(a["run"], " "))))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x["s"])).otherwise(F.concat(a["run"], F.array(x["s"]))).alias("run"),
            F.when(full, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
        )

    packed = F.aggregate(parts, empty, step, lambda a: F.concat(a["done"], F.array(T.stripped(F.array_join(a["run"], " ")))))
    return F.when(T.token_count(text) <= budget, F.array(text)).otherwise(packed)


def pack(blocks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, start_page, end_page, page_numbers, section, subsection, text, token_count, summary).

    A document's fragments are folded in order: a chunk ends where the section or subsection changes, or the next fragment
    would pass the budget; in the latter case it begins with the last fragments of the one before, whole ones until they
    hold the overlap's tokens. The fold is one aggregate over a document's array; no document's text leaves its row.
    """
    s = settings or Settings()
    body = blocks.filter("not is_heading and not excluded").filter(T.stripped(F.col("text")) != "")
    each = body.select("doc_id", "page_number", "pos", "section", "subsection", F.posexplode(fragments(F.col("text"), s.chunk_size_tokens)).alias("part", "text"))
    row = F.struct("page_number", "pos", "part", "section", "subsection", "text", T.token_count(F.col("text")).alias("n"))
    docs = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("f"))
    none = F.filter("f", lambda x: F.lit(False))
    start = F.struct(F.filter(F.array(F.col("f")), lambda x: F.lit(False)).alias("done"), none.alias("run"), F.lit(0).alias("n"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])

    def tail(run: Column) -> Column:
        # fragments whose followers don't hold the overlap yet
        size = F.size(run)
        keep = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (total(F.slice(run, i + 1, size)) < s.chunk_overlap_tokens))
        return F.slice(run, F.array_min(keep), size)

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a["run"], -1)
        same = last["section"].eqNullSafe(x["section"]) & last["subsection"].eqNullSafe(x["subsection"])
        cut = (F.size(a["run"]) > 0) & (~same | (a["n"] + x["n"] > s.chunk_size_tokens))
        before = F.when(cut, F.when(same, tail(a["run"])).otherwise(F.slice(a["run"], 1, 0))).otherwise(a["run"])
        run = F.concat(before, F.array(x))
        return F.struct(F.when(cut, F.concat(a["done"], F.array(a["run"]))).otherwise(a["done"]).alias("done"), run.alias("run"), total(run).alias("n"))

    chunks = F.aggregate("f", start, step, lambda a: F.concat(a["done"], F.array(a["run"])))
    out = docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "c"))
    pages = F.array_sort(F.array_distinct(F.transform("c", lambda x: x["page_number"])))
    text = T.stripped(F.array_join(F.transform("c", lambda x: x["text"]), "\n\n"))
    out = out.select(
        "doc_id", F.format_string("%s:%04d", F.col("doc_id").cast("string"), "chunk_index").alias("chunk_id"), "chunk_index", F.array_min(pages).alias("start_page"), F.array_max(pages).alias("end_page"),
        pages.alias("page_numbers"), F.col("c")[0]["section"].alias("section"), F.col("c")[0]["subsection"].alias("subsection"), text.alias("text"),
    )
    out = out.withColumn("token_count", T.token_count(F.col("text")))
    return out.withColumn("summary", T.truncated(F.col("text"), 180) if s.generate_chunk_summary else F.lit(None).cast("string"))
