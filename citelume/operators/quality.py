"""Quality of chunks: reference contamination, generic background, bibliography tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..lexicon import SCIENTIFIC, Lexicon

YEAR = r"\b(?:19|20)\d{2}\b"
MARKER = rf"\[[0-9,\-{T.BLANKS}]+\]|\([A-Z][A-Za-z]+,{T.BLANK}*(?:19|20)\d{{2}}\)"
AUTHOR_YEAR = rf"[A-Z][A-Za-z\-]+(?:{T.BLANK}+et al\.)?,?{T.BLANK}*\(?\d{{4}}\)?"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _share(n: Column, most: int) -> Column:
    return F.least(n, F.lit(most)) / F.lit(float(most))


def explanatory_ratio(text: Column, lexicon: Lexicon = SCIENTIFIC) -> Column:
    """The share of sentences with an explaining word."""
    return T.let(T.matchable_sentences(text), lambda parts: F.size(F.filter(parts, lambda s: s.rlike(lexicon.explanatory))) / F.size(parts))


def reference_score(text: Column, section: Column, ratio: Column, lexicon: Lexicon = SCIENTIFIC, detect: bool = True, match: Column | None = None) -> Column:
    """How much a chunk is a bibliography, 0 to 1. section: section and subsection, blank-joined; ratio: explanatory_ratio;
    match: matchable text, if it is at hand."""
    if not detect:
        return F.lit(0.0)
    if match is not None:
        return _reference_score(text, match, section, ratio, lexicon)
    return T.let(T.matchable(text), lambda match: _reference_score(text, match, section, ratio, lexicon))


def _reference_score(text: Column, match: Column, section: Column, ratio: Column, lexicon: Lexicon) -> Column:
    counts = F.struct(_count(match, r"\bdoi\b").alias("doi"), _count(match, r"\bet al\b").alias("et_al"), _count(text, AUTHOR_YEAR).alias("authors"))
    return T.let(counts, lambda n: _weighed(text, section, ratio, n["doi"], n["et_al"], n["authors"], lexicon))


def _weighed(text: Column, section: Column, ratio: Column, doi: Column, et_al: Column, authors: Column, lexicon: Lexicon) -> Column:
    score = (
        F.lit(0.3) * T.contains_any(T.matchable(section), lexicon.reference_sections).cast("double")
        + F.lit(0.18) * _share(doi, 2)
        + F.lit(0.12) * _share(_count(F.lower(text), "https?://"), 2)
        + F.lit(0.16) * _share(et_al, 3)
        + F.lit(0.1) * _share(F.length(text) - F.length(F.replace(text, F.lit(";"), F.lit(""))), 6)
        + F.lit(0.12) * _share(_count(text, MARKER), 4)
        + F.lit(0.16) * _share(authors, 4)
        + F.lit(0.08) * _share(_count(text, YEAR), 6)
        + F.lit(0.08) * (1 - ratio)
    )
    return T.let(score, lambda x: T.clamped(F.when((doi > 0) & ((et_al >= 2) | (authors >= 2)), F.greatest(x, F.lit(0.8))).otherwise(x)))


def background_score(text: Column, lexicon: Lexicon = SCIENTIFIC, match: Column | None = None) -> Column:
    phrases = lambda m: sum((m.rlike(p).cast("int") for p in lexicon.background), F.lit(0))
    found = T.let(T.matchable(text), phrases) if match is None else phrases(match)
    return T.clamped(found / T.sentence_count(text) * 1.5)


def paragraph_score(paragraph: Column, lexicon: Lexicon = SCIENTIFIC) -> Column:
    """How much a paragraph is a list of references, 0 to 1."""
    found = T.let(T.matchable(paragraph), lambda match: sum((_count(match, p) for p in lexicon.reference_like), F.lit(0)))
    ratio = explanatory_ratio(paragraph, lexicon)
    return T.clamped(F.lit(0.4) * _share(found, 4) + F.lit(0.25) * _share(_count(paragraph, YEAR), 4) + F.lit(0.2) * _share(_count(paragraph, ";"), 4) + F.lit(0.15) * (1 - ratio))


def paragraphs(text: Column, break_: str = r"\n{2,}") -> Column:
    return F.filter(F.transform(F.split(text, break_, -1), T.stripped), lambda p: p != "")


def tail_trimmed(text: Column, lexicon: Lexicon = SCIENTIFIC, break_: str = r"\n{2,}") -> Column:
    """struct(text, trimmed): without what follows a bibliography's heading, then without trailing reference paragraphs.
    If nothing would be left, or there is no paragraph, the whole text."""

    def before(parts: Column) -> Column:
        headed = F.array_position(F.transform(parts, lambda p: T.contains_any(T.matchable(p), lexicon.reference_sections)), F.lit(True)).cast("int")
        return T.let(headed, lambda h: F.struct(parts.alias("parts"), (h > 0).alias("headed"), F.when(h > 0, F.slice(parts, F.lit(1), h - 1)).otherwise(parts).alias("before")))

    def last(x: Column) -> Column:
        # how many paragraphs remain up to the last that isn't a list of references
        prose = F.reverse(F.transform(x["before"], lambda p: paragraph_score(p, lexicon) < 0.7))
        at = T.let(F.array_position(prose, F.lit(True)).cast("int"), lambda i: F.when(i > 0, F.size(x["before"]) - i + 1).otherwise(0))
        return T.let(at, lambda k: F.struct((x["headed"] | (k < F.size(x["before"]))).alias("cut"), F.slice(x["before"], F.lit(1), k).alias("kept"), x["parts"].alias("parts")))

    def out(x: Column) -> Column:
        some = F.size(x["kept"]) > 0
        return F.struct(F.when(some, T.normalized(F.array_join(x["kept"], "\n\n"))).otherwise(T.normalized(text)).alias("text"), (some & x["cut"]).alias("trimmed"))

    return T.let(T.let(T.let(paragraphs(text, break_), before), last), out)


def scored_chunks(chunks: DataFrame, settings: Settings | None = None, lexicon: Lexicon = SCIENTIFIC) -> DataFrame:
    """Chunks with tails cut, tokens counted again and quality scores beside them.

    Adds or replaces text, token_count, reference_tail_trimmed, reference_contamination_score, generic_background_score and
    is_reference_heavy. A null text is empty.
    """
    s = settings or Settings()
    text = F.coalesce("text", F.lit(""))
    cut = tail_trimmed(text, lexicon) if s.post_chunk_trim_reference_tails else F.struct(T.normalized(text).alias("text"), F.lit(False).alias("trimmed"))
    section = F.concat_ws(" ", F.col("section"), F.col("subsection"))
    out = chunks.withColumn("_cut", cut).withColumn("text", F.col("_cut.text")).withColumn("reference_tail_trimmed", F.col("_cut.trimmed")).drop("_cut")
    out = out.withColumn("token_count", T.token_count(F.col("text"))).withColumn("_match", T.matchable(F.col("text"))).withColumn("_ratio", explanatory_ratio(F.col("text"), lexicon))
    out = out.withColumn("reference_contamination_score", reference_score(F.col("text"), section, F.col("_ratio"), lexicon, s.reference_detection_enabled, F.col("_match")))
    out = out.withColumn("generic_background_score", background_score(F.col("text"), lexicon, F.col("_match"))).drop("_ratio", "_match")
    return out.withColumn("is_reference_heavy", F.col("reference_contamination_score") >= s.reference_exclusion_threshold)
