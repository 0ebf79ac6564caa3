"""Queries over chunk quality and labels, with the synthetic lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..lexicon import SCIENTIFIC
from ..lexicon import SYNTHETIC as L
from ..operators import enrichment, quality
from ..sources.tables import conversation_pages, raw_chunks, table
from . import sql as S

#: The corpus has no empty lines; a newline parts its paragraphs.
BREAK = r"\n+"


def scored(spark, d):
    """Documents as scored and labelled chunks, tails kept."""
    return enrichment.enriched_chunks(quality.scored_chunks(raw_chunks(spark, d), Settings(post_chunk_trim_reference_tails=False), L), L)


def _text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _r(c):
    return F.round(c, 6)


def references(spark, d):
    return scored(spark, d).select(F.col("chunk_id").alias("doc_id"), _r("reference_contamination_score").alias("score"), F.col("is_reference_heavy").alias("heavy"))


def tails(spark, d):
    cut = _text(spark, d).withColumn("c", quality.tail_trimmed(F.col("text"), L, BREAK))
    return cut.select("doc_id", F.md5("c.text").alias("text_md5"), F.col("c.trimmed").alias("trimmed"))


def paragraph_scores(spark, d):
    each = conversation_pages(spark, d).select("doc_id", "page_number", F.posexplode(quality.paragraphs(F.coalesce("text", F.lit("")), BREAK)).alias("pos", "p"))
    return each.select("doc_id", "page_number", "pos", _r(quality.paragraph_score(F.col("p"), L)).alias("score"))


def mention_rows(spark, d):
    return scored(spark, d).select(F.col("chunk_id").alias("doc_id"), F.explode("parameter_mentions").alias("parameter", "texts")).select("doc_id", "parameter", F.array_join("texts", "|").alias("texts"))


#: Phrases of the scientific lexicon, put before a document's own text by its number.
PHRASES = tuple(dict.fromkeys(["Gas porosity", "hot cracking", "incomplete fusion", "edge groove", "bead humping", "spatter", "warping", "WAAM", "MIG welding", "TIG", "arc additive manufacturing", "welding current of 120 A", "arc voltage 21.5 V",
    "wire-feed speed", "scan speed", "torch angle", "argon", "energy input", "pulse rate", "inter-layer temperature", "layer height", "stick-out", "deposition rate", "AA2024", "316L", "Ti-6Al-4V", "Inconel", "AZ91", "is defined as", "is due to", "leads to",
    "was reduced", "results show", "we recommend", "a limitation", "future work"]))


def scientific(spark, d):
    """Labels by the scientific lexicon."""
    listed = F.array(*map(F.lit, PHRASES))
    at = lambda k, b: F.element_at(listed, (F.pmod(F.col("doc_id") * k + b, F.lit(len(PHRASES))) + 1).cast("int"))
    text = F.concat_ws(" ", *[at(k, b) for k, b in ((1, 0), (5, 3), (7, 11), (11, 2))], F.coalesce("text", F.lit("")))
    m = T.matchable(text)
    x = table(spark, d, "documents").select("doc_id", m.alias("m"))
    names = {"defects": SCIENTIFIC.patterns(SCIENTIFIC.defects), "processes": SCIENTIFIC.processes, "parameters": SCIENTIFIC.parameters, "materials": SCIENTIFIC.materials, "roles": SCIENTIFIC.roles}
    x = x.select("doc_id", "m", *[enrichment.labels(F.col("m"), terms).alias(n) for n, terms in names.items()])
    return x.select("doc_id", *[F.array_join(n, "|").alias(n) for n in names], enrichment.source_type(F.col("m"), F.col("roles"), SCIENTIFIC).alias("kind"))


QUERIES = {
    "scientific_labels": scientific,
    "reference_score": references,
    "background_score": lambda s, d: scored(s, d).select(F.col("chunk_id").alias("doc_id"), _r("generic_background_score").alias("score")),
    "explanatory_ratio": lambda s, d: _text(s, d).select("doc_id", _r(quality.explanatory_ratio(F.col("text"), L)).alias("ratio")),
    "paragraph_score": paragraph_scores,
    "tail_trim": tails,
    "taxonomy_tags": lambda s, d: scored(s, d).select(F.col("chunk_id").alias("doc_id"), *[F.array_join(c, ",").alias(c) for c in ("defect_terms", "process_types", "materials")]),
    "parameter_mentions": mention_rows,
    "evidence_roles": lambda s, d: scored(s, d).select(F.col("chunk_id").alias("doc_id"), F.array_join("evidence_types", ",").alias("roles")),
    "source_type": lambda s, d: scored(s, d).select(F.col("chunk_id").alias("doc_id"), F.col("review_or_experimental").alias("kind")),
    "directness": lambda s, d: scored(s, d).select(F.col("chunk_id").alias("doc_id"), _r("evidence_directness_score").alias("directness")),
    "doc_rollup": lambda s, d: enrichment.document_rollup(scored(s, d).withColumn("doc_id", F.col("source_file"))).select(F.col("doc_id").alias("source"), "chunk_count", *[F.array_join(c, ",").alias(c) for c in ("defect_terms", "materials", "process_types")], "reference_heavy_chunks"),
}
YEAR = r"\b(?:19|20)\d{2}\b"
_MARKER = rf"\[[0-9,\-{S.BL}]+\]|\([A-Z][A-Za-z]+,[{S.BL}]*(?:19|20)\d{{2}}\)"
_AUTHOR = rf"[A-Z][A-Za-z\-]+(?:[{S.BL}]+et al\.)?,?[{S.BL}]*\(?\d{{4}}\)?"
_RATIO = f"(len(list_filter(s, lambda x: {S.found(S.match('x'), L.explanatory)})) / CAST(len(s) AS DOUBLE))"
#: Documents as chunks with all scores and labels.
CHUNKS = f"""
n AS (SELECT doc_id, source, {S.norm("coalesce(text, '')")} AS text,
        CASE lang WHEN 'en' THEN 'results and discussion' WHEN 'de' THEN 'introduction' WHEN 'fr' THEN 'abstract' ELSE 'methods' END AS section FROM documents),
m AS (SELECT *, {S.match('text')} AS m, {S.match('section')} AS sm, {S.sentences('text')} AS s FROM n),
k AS (SELECT *, {S.count('m', chr(92) + 'bdoi' + chr(92) + 'b')} AS doi, {S.count('m', chr(92) + 'bet al' + chr(92) + 'b')} AS et, {S.count('text', _AUTHOR)} AS au FROM m),
p AS (SELECT *, 0.3 * CAST({S.has_any('sm', L.reference_sections)} AS INT) + 0.18 * {S.share('doi', 2)} + 0.12 * {S.share(S.count('lower(text)', 'https?://'), 2)} + 0.16 * {S.share('et', 3)}
        + 0.1 * {S.share(S.count('text', ';'), 6)} + 0.12 * {S.share(S.count('text', _MARKER), 4)} + 0.16 * {S.share('au', 4)} + 0.08 * {S.share(S.count('text', YEAR), 6)} + 0.08 * (1 - {_RATIO}) AS raw FROM k),
z AS (SELECT *, {S.clamp('CASE WHEN doi > 0 AND (et >= 2 OR au >= 2) THEN greatest(raw, 0.8) ELSE raw END')} AS ref,
        {S.clamp('((' + ' + '.join(f"CAST({S.found('m', b)} AS INT)" for b in L.background) + ') / CAST(len(s) AS DOUBLE)) * 1.5')} AS bg,
        {S.labels('m', L.defects)} AS defects, {S.labels('m', L.processes)} AS processes, {S.labels('m', L.materials)} AS materials, {S.labels('m', L.roles)} AS roles, {S.labels('m', L.parameters)} AS params FROM p),
chunk AS (SELECT *, ref >= 0.72 AS heavy,
        CASE WHEN {S.found('m', L.experimental)} AND {S.found('m', L.review)} THEN 'mixed' WHEN {S.found('m', L.experimental)} OR list_contains(roles, 'result') THEN 'experimental' WHEN {S.found('m', L.review)} THEN 'review' ELSE 'unclear' END AS kind,
        {S.clamp("0.28 * CAST(len(defects) > 0 AS INT) + 0.18 * CAST(len(params) > 0 AS INT) + 0.28 * CAST(list_has_any(roles, ['mitigation', 'result', 'recommendation']) AS INT) + 0.14 * CAST(list_has_any(roles, ['cause', 'mechanism']) AS INT) + 0.08 * CAST(ref < 0.35 AS INT) - bg * 0.12")} AS direct FROM z)
"""
_PARAS = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\n+', chr(10), 'g'), chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')"


def _pscore(x: str) -> str:
    m = S.match(x)
    like = " + ".join(S.count(m, p) for p in L.reference_like)
    ratio = f"(len(list_filter({S.sentences(x)}, lambda y: {S.found(S.match('y'), L.explanatory)})) / CAST(len({S.sentences(x)}) AS DOUBLE))"
    return S.clamp(f"0.4 * {S.share(f'({like})', 4)} + 0.25 * {S.share(S.count(x, YEAR), 4)} + 0.2 * {S.share(S.count(x, ';'), 4)} + 0.15 * (1 - {ratio})")


_MENTIONS = " UNION ALL ".join(
    f"SELECT doc_id, {S.q(name)} AS parameter, array_to_string(list_sort(list_distinct({' || '.join(f'regexp_extract_all(m, {S.q(p)})' for p in patterns)})), '|') AS texts FROM m WHERE {S.found('m', S.either(patterns))}" for name, patterns in L.parameters
)
_W = "WITH " + CHUNKS
_AT = lambda k, b: f"{S.names(PHRASES)}[(doc_id * {k} + {b}) % {len(PHRASES)} + 1]"
_SCI = f"""x AS (SELECT doc_id, {S.match(" || ' ' || ".join([_AT(1, 0), _AT(5, 3), _AT(7, 11), _AT(11, 2), "coalesce(text, '')"]))} AS m FROM documents),
y AS (SELECT *, {S.labels('m', SCIENTIFIC.defects)} AS defects, {S.labels('m', SCIENTIFIC.processes)} AS processes, {S.labels('m', SCIENTIFIC.parameters)} AS parameters, {S.labels('m', SCIENTIFIC.materials)} AS materials, {S.labels('m', SCIENTIFIC.roles)} AS roles FROM x)"""
SQL = {
    "scientific_labels": f"""WITH {_SCI} SELECT doc_id, {', '.join(f"array_to_string({n}, '|') AS {n}" for n in ("defects", "processes", "parameters", "materials", "roles"))},
 CASE WHEN {S.found('m', SCIENTIFIC.experimental)} AND {S.found('m', SCIENTIFIC.review)} THEN 'mixed' WHEN {S.found('m', SCIENTIFIC.experimental)} OR list_contains(roles, 'result') THEN 'experimental' WHEN {S.found('m', SCIENTIFIC.review)} THEN 'review' ELSE 'unclear' END AS kind FROM y""",
    "reference_score": _W + "SELECT doc_id, round(ref, 6) AS score, heavy FROM chunk",
    "background_score": _W + "SELECT doc_id, round(bg, 6) AS score FROM chunk",
    "explanatory_ratio": f"WITH m AS (SELECT doc_id, {S.sentences(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS s FROM documents) SELECT doc_id, round({_RATIO}, 6) AS ratio FROM m",
    "paragraph_score": f"WITH c AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, {_PARAS} AS ps FROM conversations), e AS (SELECT doc_id, page_number, unnest(ps) AS p, CAST(unnest(range(len(ps))) AS INT) AS pos FROM c) SELECT doc_id, page_number, pos, round({_pscore('p')}, 6) AS score FROM e",
    "tail_trim": f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS text, {_PARAS} AS ps FROM documents),
e AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM c),
f AS (SELECT *, {S.has_any(S.match('p'), L.reference_sections)} AS head, {_pscore('p')} >= 0.7 AS refs FROM e),
h AS (SELECT doc_id, min(i) FILTER (WHERE head) AS h FROM f GROUP BY doc_id),
g AS (SELECT c.doc_id, text, ps, coalesce(h.h - 1, len(ps)) AS b, h.h IS NOT NULL AS headed FROM c LEFT JOIN h ON c.doc_id = h.doc_id),
l AS (SELECT g.*, coalesce((SELECT max(i) FROM f WHERE f.doc_id = g.doc_id AND i <= b AND NOT refs), 0) AS k FROM g)
SELECT doc_id, md5(CASE WHEN len(ps) = 0 OR k = 0 THEN {S.norm('text')} ELSE {S.norm("array_to_string(ps[1:k], chr(10) || chr(10))")} END) AS text_md5, k > 0 AND (headed OR k < b) AS trimmed FROM l""",
    "taxonomy_tags": _W + "SELECT doc_id, array_to_string(defects, ',') AS defect_terms, array_to_string(processes, ',') AS process_types, array_to_string(materials, ',') AS materials FROM chunk",
    "parameter_mentions": f"WITH m AS (SELECT doc_id, {S.match(S.norm(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')'))} AS m FROM documents) " + _MENTIONS,
    "evidence_roles": _W + "SELECT doc_id, array_to_string(roles, ',') AS roles FROM chunk",
    "source_type": _W + "SELECT doc_id, kind FROM chunk",
    "directness": _W + "SELECT doc_id, round(direct, 6) AS directness FROM chunk",
    "doc_rollup": _W + "SELECT source, count(*) AS chunk_count, " + ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list({c})))), ',') AS {n}" for c, n in (("defects", "defect_terms"), ("materials", "materials"), ("processes", "process_types"))) + ", count(*) FILTER (WHERE heavy) AS reference_heavy_chunks FROM chunk GROUP BY source",
}
