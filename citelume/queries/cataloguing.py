"""Queries over the catalog: lists, lookups, upserts, ingest decisions, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lexicon import SYNTHETIC
from ..operators import chunking, citations, structure
from ..plans import catalog, ingest
from ..sources.tables import conversation_pages, raw_chunks, table
from . import sql as S
from .ingesting import SMALL
from .ingesting import SQL as INGESTING
from .labelling import CHUNKS, scored

#: SQL of the chunks that the engine makes of the conversations.
PACKED = INGESTING["chunk_pack"]


def _documents(spark, d):
    x = table(spark, d, "documents")
    return x.select(F.concat(F.lit("file"), F.col("doc_id")).alias("source_file"), F.col("doc_id").cast("string").alias("doc_id"), F.sha1(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("checksum"), F.when(F.col("doc_id") % 7 > 0, 2000 + F.col("doc_id") % 25).cast("int").alias("year"), F.concat(F.lit("Paper "), F.col("doc_id")).alias("title"), F.col("doc_id").alias("n"), "lang")


def listed(spark, d):
    """The whole list, in order."""
    return catalog.listed(_documents(spark, d)).select("doc_id", "year", "title")


def upserted(spark, d):
    docs = _documents(spark, d)
    new = docs.filter("n % 3 = 0").withColumn("lang", F.lit("new"))
    return catalog.upserted(docs.filter("n % 5 <> 0"), new).select("source_file", "doc_id", "lang")


def _decided(spark, d, force=False):
    docs = _documents(spark, d)
    stored = docs.filter("n % 2 = 0").withColumn("checksum", F.when(F.col("n") % 10 == 0, "old").otherwise(F.col("checksum")))
    incoming = docs.withColumn("error", F.when(F.col("n") % 11 == 0, "no pages"))
    return ingest.decisions(incoming, stored, force)


def rolled(spark, d):
    r = _decided(spark, d).withColumn("chunks", F.when(F.col("status").isin("ingested", "updated"), F.col("n") % 4).otherwise(0))
    return ingest.rollup(r)


def migrated(spark, d):
    old = raw_chunks(spark, d).select(F.col("chunk_id").cast("string").alias("chunk_id"), "doc_id", "text", F.when(F.col("chunk_id") % 2 == 0, 0.5).alias("generic_background_score"))
    m = catalog.migrated(old)
    return m.select("chunk_id", "generic_background_score", "reference_contamination_score", "is_reference_heavy", F.col("summary").isNull().alias("no_summary"))


def revectored(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    new = e.filter("chunk_id % 3 = 0").select("chunk_id", F.transform("embedding", lambda x: F.lit(0.0).cast("float")).alias("embedding"))
    return catalog.with_vectors(e, new).select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def json_rows(spark, d):
    c = raw_chunks(spark, d).withColumn("citation", citations.citation())
    return c.select("chunk_id", F.to_json(F.struct("chunk_id", "title", "year", "citation")).alias("body"))


def digested(spark, d):
    """All chunks of the documents of a source, which stand for a document's chunks."""
    c = catalog.digest(scored(spark, d).withColumns({"doc_id": F.col("source_file"), "start_page": F.lit(1), "end_page": F.lit(1)}), "src3")
    return c.select("chunk_id", "section", "token_count", F.array_join("defect_terms", ",").alias("defect_terms"), F.array_join("evidence_types", ",").alias("roles"), "is_reference_heavy")


QUERIES = {
    "catalog_list": listed,
    "catalog_lookup": lambda s, d: catalog.by_id(_documents(s, d), "7").select("doc_id", "source_file", "checksum"),
    "catalog_lookup_by_source": lambda s, d: catalog.by_source(_documents(s, d), s.createDataFrame([("file3",), ("file5",), ("nowhere",)], "source_file string")).select("source_file", "doc_id"),
    "document_digest": digested,
    "catalog_upsert": upserted,
    "ingest_status": lambda s, d: _decided(s, d).select("source_file", "status"),
    "ingest_status_forced": lambda s, d: _decided(s, d, True).select("source_file", "status"),
    "ingest_rollup": rolled,
    "health_counts": lambda s, d: catalog.counted(_documents(s, d), chunking.pack(structure.blocks(conversation_pages(s, d), SYNTHETIC, SMALL.paragraph_break), SMALL)),
    "schema_migration": migrated,
    "reembed_by_key": revectored,
    "json_response": json_rows,
}
_D = "WITH d AS (SELECT 'file' || doc_id AS source_file, CAST(doc_id AS VARCHAR) AS doc_id, sha1(coalesce(text, '')) AS checksum, CASE WHEN doc_id % 7 > 0 THEN CAST(2000 + doc_id % 25 AS INT) END AS year, 'Paper ' || doc_id AS title, doc_id AS n, lang FROM documents)"
_C = _D + ", c AS (SELECT source_file, CASE WHEN n % 10 = 0 THEN 'old' ELSE checksum END AS stored FROM d WHERE n % 2 = 0)"


def _status(force: bool) -> str:
    skip = "" if force else "WHEN stored = checksum THEN 'skipped' "
    return f"SELECT d.source_file, n, CASE {skip}WHEN n % 11 = 0 THEN 'failed' WHEN stored IS NOT NULL THEN 'updated' ELSE 'ingested' END AS status FROM d LEFT JOIN c ON d.source_file = c.source_file"


_PGS = "CASE WHEN doc_id % 3 = 0 THEN 'p. ' || (doc_id % 9 + 1) ELSE 'pp. ' || (doc_id % 9 + 1) || '-' || (doc_id % 9 + 1 + doc_id % 3) END"
SQL = {
    "catalog_list": _D + " SELECT doc_id, year, title FROM d ORDER BY coalesce(year, 0) DESC, title",
    "catalog_lookup": _D + " SELECT doc_id, source_file, checksum FROM d WHERE doc_id = '7'",
    "catalog_lookup_by_source": _D + " SELECT source_file, doc_id FROM d WHERE source_file IN ('file3', 'file5', 'nowhere')",
    "catalog_upsert": _D + " SELECT source_file, doc_id, CASE WHEN n % 3 = 0 THEN 'new' ELSE lang END AS lang FROM d WHERE n % 3 = 0 OR n % 5 <> 0",
    "ingest_status": _C + f" SELECT source_file, status FROM ({_status(False)})",
    "ingest_status_forced": _C + f" SELECT source_file, status FROM ({_status(True)})",
    "ingest_rollup": _C + f" SELECT count(*) AS processed_files, count(*) FILTER (WHERE status IN ('ingested', 'updated')) AS ingested_files, count(*) FILTER (WHERE status = 'skipped') AS skipped_files, CAST(sum(CASE WHEN status IN ('ingested', 'updated') THEN n % 4 ELSE 0 END) AS BIGINT) AS chunks_created FROM ({_status(False)})",
    "health_counts": f"SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM ({PACKED})) AS chunks",
    "document_digest": f"WITH {CHUNKS} SELECT doc_id AS chunk_id, section, CAST({S.count('text', S.TOKEN)} AS INT) AS token_count, array_to_string(defects, ',') AS defect_terms, array_to_string(roles, ',') AS roles, heavy AS is_reference_heavy FROM chunk WHERE source = 'src3'",
    "schema_migration": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS generic_background_score, 0.0::DOUBLE AS reference_contamination_score, false AS is_reference_heavy, true AS no_summary FROM documents",
    "reembed_by_key": "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(list_sum(embedding::DOUBLE[]), 6) END AS total FROM embeddings",
    "json_response": f"""SELECT doc_id AS chunk_id, '{{"chunk_id":' || doc_id || ',"title":"Paper ' || doc_id || '","year":' || (2000 + doc_id % 25) || ',"citation":"[' || CASE doc_id % 3 WHEN 0 THEN 'Smith et al.' WHEN 1 THEN 'Wu' ELSE 'Paper ' || doc_id END || ', ' || (2000 + doc_id % 25) || ', ' || {_PGS} || ']"}}' AS body FROM documents""",
}
