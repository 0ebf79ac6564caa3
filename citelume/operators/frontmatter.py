"""Title, authors, year and venue from a first page and a file's own metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .cleaning import lines

YEAR = r"(?:19|20)\d{2}"


def front_lines(text: Column) -> Column:
    return F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: x != "")


def split_authors(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(raw, F.lit(" and "), F.lit(",")), ",", -1), T.stripped), lambda a: a != "")


def looks_like_authors(line: Column) -> Column:
    parts = F.filter(F.transform(F.split(line, ",", -1), T.stripped), lambda a: a != "")
    words = T.words(line)
    capital = lambda w: T.is_upper(F.substring(w, 1, 1))
    few = F.size(words).between(2, 6) & capital(F.get(words, F.lit(0))) & capital(F.get(words, F.lit(1))) & ~F.lower(line).contains("abstract")
    return F.when(line.contains(","), (F.size(parts) >= 2) & F.forall(parts, lambda p: p.contains(" "))).otherwise(few)


def _given(metadata: Column, key: str) -> Column:
    return F.nullif(T.normalized(F.coalesce(metadata[key], F.lit(""))), F.lit(""))


def _until(xs: Column, stop) -> Column:
    """xs before the first that stops."""
    at = F.array_position(F.transform(xs, stop), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(xs, F.lit(1), at - 1)).otherwise(xs)


def title(front: Column, metadata: Column, stem: Column) -> Column:
    some = _until(F.slice(front, 1, 6), lambda x: F.lower(x).startswith("abstract") | looks_like_authors(x))
    some = F.filter(some, lambda x: F.length(x).between(7, 199))
    inferred = F.when(F.size(front) == 0, stem).when(F.size(some) > 0, T.stripped(F.array_join(F.slice(some, 1, 2), " "))).otherwise(F.get(front, F.lit(0)))
    return F.coalesce(_given(metadata, "title"), inferred)


def authors(front: Column, metadata: Column) -> Column:
    some = _until(F.slice(front, 2, 4), lambda x: F.lower(x).contains("abstract"))
    first = F.get(F.filter(some, lambda x: x.contains(",") | F.lower(x).contains(" and ")), F.lit(0))
    return F.coalesce(split_authors(_given(metadata, "author")), split_authors(first), F.array().cast("array<string>"))


def year(front: Column, metadata: Column, stem: Column) -> Column:
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), YEAR, 0), F.lit(""))
    return F.coalesce(*[found(metadata[k]) for k in ("creationdate", "moddate", "subject")], found(F.array_join(F.slice(front, 1, 15), "\n")), found(stem)).cast("int")


def venue(front: Column, metadata: Column) -> Column:
    named = F.filter(F.slice(front, 1, 12), lambda x: T.contains_any(F.lower(x), ("journal", "conference", "proceedings", "transactions")))
    return F.coalesce(*[_given(metadata, k) for k in ("subject", "keywords", "producer")], F.get(named, F.lit(0)))


def front_matter(files: DataFrame) -> DataFrame:
    """files (first_page, raw_metadata map<string,string>, stem) with title, authors, year and venue."""
    out = files.withColumn("_front", front_lines(F.col("first_page")))
    front, metadata, stem = F.col("_front"), F.col("raw_metadata"), F.col("stem")
    return out.withColumns({"title": title(front, metadata, stem), "authors": authors(front, metadata), "year": year(front, metadata, stem), "venue": venue(front, metadata)}).drop("_front")
