"""Labels of chunks by lexicon, and how directly a chunk is evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import SCIENTIFIC, Lexicon, Terms


def labels(match: Column, terms: Terms, ordered: bool = False) -> Column:
    """Names of the terms found in matchable text: sorted, or in the lexicon's order."""
    found = T.let(match, lambda m: F.array_compact(F.array(*[F.when(m.rlike(T.any_of(patterns)), F.lit(name)) for name, patterns in terms])))
    return found if ordered else F.array_sort(F.array_distinct(found))


def mentions(match: Column, terms: Terms) -> Column:
    """A map from each parameter found to the distinct texts that name it, sorted."""
    names = F.array(*[F.lit(name) for name, _ in terms])
    found = [F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(match, F.lit(p), F.lit(0)) for p in patterns]))) for _, patterns in terms]
    return F.map_filter(F.map_from_arrays(names, F.array(*found)), lambda _, v: F.size(v) > 0)


def source_type(match: Column, roles: Column, lexicon: Lexicon = SCIENTIFIC) -> Column:
    experimental, review = match.rlike(lexicon.experimental), match.rlike(lexicon.review)
    return F.when(experimental & review, "mixed").when(experimental | F.array_contains(roles, "result"), "experimental").when(review, "review").otherwise("unclear")


def directness(defects: Column, parameters: Column, roles: Column, reference: Column, background: Column, lexicon: Lexicon = SCIENTIFIC) -> Column:
    any_role = lambda names: F.arrays_overlap(roles, F.array(*map(F.lit, names))).cast("int")
    score = (
        F.lit(0.28) * (F.size(defects) > 0).cast("int")
        + F.lit(0.18) * (F.size(parameters) > 0).cast("int")
        + F.lit(0.28) * any_role(lexicon.direct_roles)
        + F.lit(0.14) * any_role(lexicon.causal_roles)
        + F.lit(0.08) * (reference < 0.35).cast("int")
        - background * 0.12
    )
    return T.clamped(score)


def enriched_chunks(chunks: DataFrame, lexicon: Lexicon = SCIENTIFIC) -> DataFrame:
    """Scored chunks with defect_terms, process_types, materials, evidence_types, parameter_mentions, process_parameters,
    review_or_experimental and evidence_directness_score, each added or replaced."""
    match = F.col("_match")
    out = chunks.withColumn("_match", T.matchable(F.coalesce("text", F.lit(""))))
    for name, terms in (("defect_terms", lexicon.defects), ("process_types", lexicon.processes), ("materials", lexicon.materials), ("evidence_types", lexicon.roles)):
        out = out.withColumn(name, labels(match, lexicon.patterns(terms)))
    out = out.withColumn("parameter_mentions", mentions(match, lexicon.patterns(lexicon.parameters)))
    out = out.withColumn("process_parameters", F.array_sort(F.map_keys("parameter_mentions")))
    out = out.withColumn("review_or_experimental", source_type(match, F.col("evidence_types"), lexicon))
    direct = directness(F.col("defect_terms"), F.col("process_parameters"), F.col("evidence_types"), F.col("reference_contamination_score"), F.col("generic_background_score"), lexicon)
    return out.withColumn("evidence_directness_score", direct).drop("_match")


def unlabelled(chunks: DataFrame) -> DataFrame:
    """The same columns where enrichment is off."""
    empty = F.array().cast("array<string>")
    out = chunks
    for name in ("defect_terms", "process_types", "materials", "evidence_types", "process_parameters"):
        out = out.withColumn(name, empty)
    return out.withColumn("parameter_mentions", F.create_map().cast("map<string,array<string>>")).withColumn("review_or_experimental", F.lit(None).cast("string")).withColumn("evidence_directness_score", F.lit(0.0))


def document_rollup(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_count, defect_terms, materials, process_types, reference_heavy_chunks): labels over a document's chunks."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), every("defect_terms"), every("materials"), every("process_types"), F.count_if("is_reference_heavy").alias("reference_heavy_chunks"))
