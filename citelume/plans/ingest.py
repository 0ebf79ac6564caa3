"""From pages to labelled chunks, and what an ingest does to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..lexicon import SCIENTIFIC, Lexicon
from ..operators import chunking, cleaning, enrichment, quality, structure


def chunks_of(pages: DataFrame, documents: DataFrame, settings: Settings | None = None, lexicon: Lexicon = SCIENTIFIC) -> DataFrame:
    """Labelled chunks of pages (doc_id, page_number, text), with the bibliographic columns of documents (doc_id,
    source_file, title, authors, year, venue)."""
    s = settings or Settings()
    blocks = structure.blocks(cleaning.clean_pages(pages), lexicon, s.paragraph_break, s.exclude_references)
    made = quality.scored_chunks(chunking.pack(blocks, s), s, lexicon)
    made = enrichment.enriched_chunks(made, lexicon) if s.metadata_enrichment_enabled else enrichment.unlabelled(made)
    return made.join(documents.select("doc_id", "source_file", "title", "authors", "year", "venue"), "doc_id")


def decisions(incoming: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """incoming (source_file, checksum, error) with status: failed, skipped (the stored checksum is equal and force isn't
    set), updated (the source is known) or ingested."""
    known = catalog.select("source_file", F.col("checksum").alias("_stored"))
    out = incoming.join(known, "source_file", "left")
    same = F.coalesce(F.col("_stored") == F.col("checksum"), F.lit(False)) & F.lit(not force)
    return out.withColumn("status", F.when(same, "skipped").when(F.col("error").isNotNull(), "failed").when(F.col("_stored").isNotNull(), "updated").otherwise("ingested")).drop("_stored")


def rollup(results: DataFrame) -> DataFrame:
    """One row: files processed (failed ones too), ingested (updated ones too), skipped, chunks created."""
    return results.agg(F.count("*").alias("processed_files"), F.count_if(F.col("status").isin("ingested", "updated")).alias("ingested_files"), F.count_if(F.col("status") == "skipped").alias("skipped_files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("chunks_created"))
