"""The driver's queries over this subpackage's operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprint, line_dedup, mixing, pii, quality, simhash, suffix_tree, token_shards, url_filter
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lambda spark, d: line_dedup.query(table(spark, d, "documents")),
        "op2_suffix_tree_scoring": lambda spark, d: suffix_tree.query(table(spark, d, "documents")),
        "op3_personal_data": lambda spark, d: pii.query(table(spark, d, "documents")),
        "op4_quality_classifier": lambda spark, d: quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_simhash_near_dedup": lambda spark, d: simhash.query(table(spark, d, "documents")),
        "op6_decontamination": lambda spark, d: decontamination.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op7_token_shards": lambda spark, d: token_shards.query(table(spark, d, "documents")),
        "op8_document_fingerprints": lambda spark, d: fingerprint.query(table(spark, d, "documents")),
        "op9_source_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
        "op10_url_filter": lambda spark, d: url_filter.query(table(spark, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op6_decontamination": decontamination.SQL, "op9_source_mixing": mixing.SQL, "op10_url_filter": url_filter.SQL}
