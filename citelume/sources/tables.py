"""The driver's tables as the engine's: pages, documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in far fewer pieces, as one small file does; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a document, its turns as pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def raw_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a chunk of one page; its language stands for a section, its number gives a year."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_file"), F.concat(F.lit("Paper "), F.col("doc_id")).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Ada Smith"), F.lit("Bo Li"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("Chi Wu"))).otherwise(F.array().cast("array<string>")).alias("authors"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("year"), (F.col("doc_id") % 9 + 1).cast("int").alias("start_page"), F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: (F.col("doc_id") % 9 + 1 + i).cast("int")).alias("page_numbers"),
        F.when(F.col("lang") == "en", "results and discussion").when(F.col("lang") == "de", "introduction").when(F.col("lang") == "fr", "abstract").otherwise("methods").alias("section"), F.lit(None).cast("string").alias("subsection"), "text",
    )
