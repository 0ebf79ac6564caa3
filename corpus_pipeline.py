"""A training corpus from raw documents: quality, near-duplicates, contamination, mixture, token shards.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of any
name; all but the last return the columns they get, with their values.

* quality: texts without words go; a null doc_id is judged as any other; rows are judged one by one.
* near_dedup: equal texts are near-duplicates, texts without words of each other; rows of equal doc_id are one document, of
  which one row stays; rows of a null doc_id stay.
* decontamination: a text without words stays; rows are judged one by one.
* mixture: a null source is a source; a null text has size 0 and is taken as often as whole repetitions say.
* tokens: a null text is an end of text alone; no documents give no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citelume.llm import decontamination, mixing, quality, simhash, token_shards
from citelume.llm.common import named, release, scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash's classes, every link of them confirmed, and what they miss."""
    return simhash.distinct_documents(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the contract's rule."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; a row for each sequence."""
    return token_shards.materialise(docs)


STAGES = [("quality", keep_good), ("near_dedup", keep_distinct), ("decontamination", keep_uncontaminated), ("mixture", mix_sources), ("tokens", write_tokens)]
#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. What a stage leaves behind goes as soon as
    its documents are written, but for the last stage's, whose shards are the product."""
    docs, before = table(spark, sf_dir, "documents"), named()
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = scratch(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        if stage is not write_tokens:
            release(spark, before, keep=(path,))
    return docs
