"""The engine's seven calls: ingest, reindex, list and get documents, query, retrieve context, health."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs
from .config import Settings
from .lexicon import SCIENTIFIC, Lexicon
from .operators import enrichment, evidence, frontmatter, fusion, vectors
from .plans import ingest, requests, retrieval
from .plans.catalog import DOCUMENTS, Catalog, by_id, digest, listed, with_vectors
from .plans.requests import Request
from .sources import pages as files


@dataclass
class Answer:
    """What a batch of requests gives: frames keyed by query_id, and summaries of the requests."""

    summaries: dict[int, str]
    results: DataFrame
    evidence: DataFrame
    themes: DataFrame
    hints: DataFrame
    diagnostics: DataFrame
    timings_ms: dict[str, float] = field(default_factory=dict)


def _loaded(make: Callable | None, what: str) -> Callable | None:
    """make, if what it makes loads here; else None and a warning: the engine then does without."""
    if make is None:
        return None
    try:
        make()
        return make
    except Exception as e:
        warnings.warn(f"{what} doesn't load, the engine does without: {e}", stacklevel=3)
        return None


class Engine:
    """Everything over one catalog. parsers turn files into pages; embed makes a model that turns texts into vectors, which
    are stored and searched (None, or one that doesn't load: vectors are hashed when searched for); reranker makes a model
    that scores (query, text) pairs (None, or one that doesn't load: a heuristic); forward is called with each answer's
    rows as JSON."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, lexicon: Lexicon = SCIENTIFIC, parsers: tuple[files.Parser, ...] = (files.pdf_with_pypdf, files.pdf_with_pymupdf), embed: Callable | None = None, forward: Callable[[list[str]], None] | None = None, reranker: Callable | None = None) -> None:
        self.spark, self.settings, self.lexicon, self.parsers, self.forward = spark, settings or Settings(), lexicon, parsers, forward
        self.embed, self.reranker = _loaded(embed, "the embedding model"), _loaded(reranker, "the reranking model")
        if self.embed is None and self.settings.embedding_backend != "hashing":
            warnings.warn(f"no model for the backend {self.settings.embedding_backend}: vectors are hashed", stacklevel=2)
        self.catalog = Catalog(spark, self.settings.storage_dir)

    # --- writing

    def ingest(self, paths: str | list[str], force: bool = False, pattern: str = "*.pdf") -> DataFrame:
        """A row for each file of a folder or list: source_file, status, error, chunks. Files whose checksum is stored are
        skipped unless forced. Raises ValueError if there are none."""
        try:
            found = files.files(self.spark, paths, pattern)
            empty = found.isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise ValueError(f"no such folder: {paths}") from e
            raise
        if empty:
            raise ValueError(f"no files {pattern} in {paths}")
        return self._ingested(files.parsed(found, self.parsers), force)

    def upload(self, content: Iterable[tuple[str, bytes]], force: bool = False) -> DataFrame:
        """As ingest(), for files that come as (name, bytes). Each goes to a folder of its own below storage_dir, so the same
        file uploaded twice is two documents. Raises ValueError if there are none, or a name isn't a plain file name."""
        rows = []
        for name, data in content:
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"not a file name: {name!r}")
            rows.append((f"{self.settings.storage_dir.rstrip('/')}/uploads/{uuid.uuid4().hex}/{name}", bytearray(data)))
        if not rows:
            raise ValueError("no files")
        return self._ingested(files.parsed(self.spark.createDataFrame(rows, "path string, content binary"), self.parsers), force)

    def ingest_pages(self, pages: DataFrame, force: bool = False) -> DataFrame:
        """As ingest(), for pages that are parsed already: source_file, checksum, page_number, text."""
        return self._ingested(files.from_pages(pages), force)

    def _ingested(self, rows: DataFrame, force: bool) -> DataFrame:
        begun, parsed = time.perf_counter(), rows.persist()
        decided = ingest.decisions(parsed.select("source_file", "doc_id", "checksum", "error"), self.catalog.read("documents"), force).persist()
        wanted = parsed.join(decided.filter(F.col("status").isin("ingested", "updated")).select("source_file"), "source_file", "left_semi")
        front = frontmatter.front_matter(wanted.withColumn("first_page", F.get("pages", F.lit(0))["text"]))
        made = ingest.chunks_of(files.page_rows(wanted), front, self.settings, self.lexicon).persist()
        counts = enrichment.document_rollup(made)
        labels = F.map_from_arrays(F.array(*map(F.lit, ("defect_terms", "materials", "process_types", "reference_heavy_chunks"))), F.array(F.array_join("defect_terms", ","), F.array_join("materials", ","), F.array_join("process_types", ","), F.col("reference_heavy_chunks").cast("string")))
        documents = front.join(counts, "doc_id").withColumn("raw_metadata", F.map_concat(F.map_filter("raw_metadata", lambda k, v: ~k.isin("defect_terms", "materials", "process_types", "reference_heavy_chunks")), labels))
        documents = documents.withColumn("page_count", F.size("pages")).withColumn("ingested_at", F.current_timestamp()).select(DOCUMENTS.names)
        chunks = vectors.embedded(made, self.embed) if self.embed else made
        self.catalog.upsert(documents, chunks.join(documents.select("doc_id"), "doc_id", "left_semi"))
        out = decided.join(counts.select("doc_id", F.col("chunk_count").alias("chunks")), "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        fruitless = F.col("status").isin("ingested", "updated") & (F.col("chunks") == 0)
        out = out.withColumn("error", F.when(fruitless, "no retrievable chunks").otherwise(F.col("error"))).withColumn("status", F.when(fruitless, "failed").otherwise(F.col("status")))
        path = f"{self.settings.storage_dir.rstrip('/')}/ingests/{uuid.uuid4().hex}"
        out.select("source_file", "status", "error", "chunks").write.parquet(path)
        for kept in (made, decided, parsed):
            kept.unpersist()
        done = self.spark.read.parquet(path)
        logs.event("ingest", **ingest.rollup(done).first().asDict(), seconds=round(time.perf_counter() - begun, 3))
        return done

    def reindex(self, paths: str | list[str] | None = None, force: bool = True, pattern: str = "*.pdf") -> dict[str, int]:
        """With paths a forced ingest; without, all stored chunks get new vectors."""
        if paths is not None:
            r = ingest.rollup(self.ingest(paths, force, pattern)).first()
            return {"documents": r["ingested_files"], "chunks": r["chunks_created"]}
        chunks = self.catalog.read("chunks")
        if self.embed:
            self.catalog.write("chunks", with_vectors(chunks, vectors.embedded(chunks.select("chunk_id", "text"), self.embed).select("chunk_id", "embedding")))
        r = chunks.agg(F.countDistinct("doc_id"), F.count("*")).first()
        return {"documents": r[0], "chunks": r[1]}

    # --- reading

    def list_documents(self) -> DataFrame:
        return listed(self.catalog.read("documents"))

    def get_document(self, doc_id: str) -> tuple[Any, DataFrame]:
        """(document, its chunks in short). Raises KeyError if there is none."""
        rows = by_id(self.catalog.read("documents"), doc_id).take(1)
        if not rows:
            raise KeyError(doc_id)
        return rows[0], digest(self.catalog.read("chunks"), doc_id)

    def query(self, asked: Request | Iterable[Request], timed: bool = False) -> Answer:
        """One plan answers all requests; the frames run when they are read. timed: each stage is run and timed by itself, as
        dense_search_ms, sparse_search_ms, fusion_ms (with features), rerank_ms and total_ms; else only planning is timed."""
        begun = time.perf_counter()
        batch = [asked] if isinstance(asked, Request) else list(asked)
        rows, intents = requests.frames(self.spark, batch, self.settings, self.lexicon)
        chunks = self.catalog.read("chunks")
        took: dict[str, float] = {}
        if timed:
            ranked = self._timed(chunks, rows, intents, took)
        else:
            ranked = retrieval.answered(chunks, rows, intents, self.settings, self.lexicon, self.embed, self.reranker)
        found = evidence.extracted(ranked, self.lexicon)
        results = ranked.withColumn("score", F.round("score", 4))
        answer = Answer({r["query_id"]: r["summary"] for r in rows.select("query_id", "summary").collect()}, results, found, evidence.theme_summary(found), evidence.reasoning_hints(found), retrieval.diagnostics(chunks, rows, self.settings))
        answer.timings_ms |= took or {"planning_ms": round((time.perf_counter() - begun) * 1000, 2)}
        logs.event("query", requests=len(batch), **answer.timings_ms)
        if self.forward:
            self.forward(json_rows(results))
        return answer

    def _timed(self, chunks: DataFrame, rows: DataFrame, intents: DataFrame, took: dict[str, float]) -> DataFrame:
        s, begun = self.settings, time.perf_counter()

        def run(name: str, frame: DataFrame | None) -> DataFrame | None:
            at = time.perf_counter()
            if frame is not None:
                frame = frame.persist()
                frame.count()
            took[f"{name}_ms"] = round((time.perf_counter() - at) * 1000, 2)
            return frame

        dense, sparse = retrieval.searched(chunks, rows, intents, s, self.embed)
        dense, sparse = run("dense_search", dense), run("sparse_search", sparse)
        most = intents.count() * (s.dense_top_k + s.sparse_top_k)
        best = run("fusion", retrieval.scored(chunks, rows, fusion.reciprocal_rank(dense, sparse, s.fusion_rrf_k), most, s, self.lexicon))
        ranked = run("rerank", retrieval.cut(best, s, self.reranker))
        took["total_ms"] = round((time.perf_counter() - begun) * 1000, 2)
        return ranked

    def retrieve_context(self, asked: Request | Iterable[Request]) -> tuple[Answer, DataFrame]:
        """The answer, and for each request the text that packs its ranked, cited results."""
        answer = self.query(asked)
        return answer, evidence.context_pack(answer.results)

    def health(self) -> dict[str, Any]:
        documents, chunks = self.catalog.counts()
        return {"status": "ok", "documents": documents, "chunks": chunks, "storage_dir": self.settings.storage_dir, "vector_backend": "parquet"}


def json_rows(results: DataFrame) -> list[str]:
    """A batch's ranked results (top_k a request) as JSON."""
    shown = ("query_id", "rank", "chunk_id", "score", "source_file", "title", "authors", "year", "page_numbers", "section", "subsection", "citation", "text", "debug_reasons")
    return [r[0] for r in results.orderBy("query_id", "rank").select(F.to_json(F.struct(*shown))).collect()]

