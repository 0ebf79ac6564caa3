"""Ingesting page files as they arrive: a file stream, each micro-batch upserted into the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Engine

PAGES = "source_file string, checksum string, page_number int, text string, arrived timestamp"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of PAGES from Parquet files that appear in a folder."""
    return spark.readStream.schema(PAGES).parquet(folder)


def ingest_stream(pages: DataFrame, checkpoint: str, upsert: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch to upsert and stops when all that is there is read. A batch that is given again after a
    failure has the same number, and an upsert by key leaves the same state."""
    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()


def into(engine: Engine) -> Callable[[DataFrame, int], None]:
    """What ingest_stream() needs to parse, chunk, label and store each micro-batch of pages in an engine's catalog. A file's
    pages should arrive together; pages that arrive later replace those before. Files whose checksum is stored are
    skipped, so a batch that is given again changes nothing."""

    def upsert(pages: DataFrame, number: int) -> None:
        if not pages.isEmpty():
            engine.ingest_pages(pages)

    return upsert


def arrivals(pages: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, pages, files) of arrivals; later ones than the watermark don't count."""
    seen = pages.withWatermark("arrived", late).groupBy(F.window("arrived", window))
    return seen.agg(F.count("*").alias("pages"), F.approx_count_distinct("source_file").alias("files"))
