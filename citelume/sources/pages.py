"""Files as rows, and pages from files by pluggable parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: (path, content) to (page texts, metadata).
Parser = Callable[[str, bytes], tuple[list[str], dict[str, Any]]]
PAGES = "path string, source_file string, file_name string, stem string, doc_id string, checksum string, pages array<struct<page_number:int,text:string>>, raw_metadata map<string,string>, error string"


def pdf_with_pypdf(path: str, content: bytes) -> tuple[list[str], dict[str, Any]]:
    import io

    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    return [page.extract_text() or "" for page in reader.pages], {str(k).lstrip("/").lower(): str(v) for k, v in (reader.metadata or {}).items()}


def pdf_with_pymupdf(path: str, content: bytes) -> tuple[list[str], dict[str, Any]]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        return [page.get_text() for page in document], {str(k).lower(): str(v) for k, v in (document.metadata or {}).items() if v}


def text_pages(path: str, content: bytes) -> tuple[list[str], dict[str, Any]]:
    """Plain text whose pages end in form feeds."""
    return content.decode("utf-8", "replace").split("\f"), {}


def files(spark: SparkSession, paths: str | list[str], pattern: str = "*.pdf") -> DataFrame:
    """path and content of the files of a folder (not below it) that match the pattern, or of listed paths."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if isinstance(paths, str) else reader).load(paths).select("path", "content")


def parsed(found: DataFrame, parsers: tuple[Parser, ...] = (pdf_with_pypdf, pdf_with_pymupdf)) -> DataFrame:
    """A row for each file, its pages by the first parser that finds one; error says why none did."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                pages, metadata, tried = [], {}, []
                for parse in parsers:
                    try:
                        texts, metadata = parse(path, content)
                        if pages := [{"page_number": i, "text": t or ""} for i, t in enumerate(texts, 1)]:
                            break
                        tried.append(f"{parse.__name__}: no pages")
                    except Exception as e:  # one bad file must not stop the batch
                        tried.append(f"{parse.__name__}: {e}")
                rows.append((path, pages, list(metadata.items()), None if pages else "; ".join(tried) or "no parser"))
            path, pages, metadata, error = zip(*rows, strict=True) if rows else [()] * 4
            kind = pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(pages, kind), pa.array(metadata, pa.map_(pa.string(), pa.string())), pa.array(error, pa.string()), b.column("checksum")], names=["path", "pages", "raw_metadata", "error", "checksum"])

    summed = found.withColumn("checksum", F.sha1("content"))
    out = summed.mapInArrow(run, "path string, pages array<struct<page_number:int,text:string>>, raw_metadata map<string,string>, error string, checksum string")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    out = out.withColumn("source_file", F.regexp_replace("path", "^file:/*", "/")).withColumn("file_name", name).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", ""))
    return out.withColumn("doc_id", T.stable_id(F.col("source_file"))).select([f.strip().split(" ")[0] for f in ("path", "source_file", "file_name", "stem", "doc_id", "checksum", "pages", "raw_metadata", "error")])


def from_pages(pages: DataFrame) -> DataFrame:
    """The rows of parsed() from pages (source_file, checksum, page_number, text): a row for each file. Files whose pages
    differ in their checksum count by the greatest."""
    name = F.regexp_extract("source_file", r"[^/]*$", 0)
    listed = F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))))
    out = pages.groupBy("source_file").agg(F.max("checksum").alias("checksum"), listed.alias("pages"))
    out = out.withColumns({"path": F.col("source_file"), "file_name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "doc_id": T.stable_id(F.col("source_file")), "raw_metadata": F.create_map().cast("map<string,string>"), "error": F.lit(None).cast("string")})
    return out.select([f.strip().split(" ")[0] for f in ("path", "source_file", "file_name", "stem", "doc_id", "checksum", "pages", "raw_metadata", "error")])


def page_rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", "p.text")
