"""Queries over retrieval: BM25, vectors, fusion, features, ranking, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..lexicon import SYNTHETIC as L
from ..operators import bm25, evidence, fusion, vectors
from ..plans import requests, retrieval
from ..plans.requests import Filters, Request
from ..sources.tables import table
from . import asked
from . import sql as S
from .labelling import CHUNKS, scored

SETTINGS = Settings()
#: A batch of requests over the synthetic corpus.
REQUESTS = (
    Request(1, question="thandon the heating of the reth"),
    Request(2, defect_name="heat", process_parameters={"current_A": 180, "heat_input": 1.2}),
    Request(3, defect_name="Stble", question="with the stble and erin onth", process_parameters={"shielding_gas": "argon", "voltage_V": 21}, filters=Filters(year_min=2005, year_max=2020)),
    Request(4, defect_name="erin", question="que la ciónos de los", filters=Filters(source_files=("src1", "src2", "src3"))),
    Request(5, defect_name="unheard of", query_expansion=False),
)
RERANKED = tuple(Request(r.query_id, r.defect_name, r.question, r.process_parameters, r.filters, enable_rerank=True) for r in REQUESTS)


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))


def _benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("free_text").alias("intent"), F.coalesce("text", F.lit("")).alias("text"))


def _batch(spark, batch=REQUESTS):
    return requests.frames(spark, batch, SETTINGS, L)


def bm25_topk(spark, d):
    return bm25.best(_chunks(spark, d), _benchmark(spark, d), 24).select("query_id", "chunk_id", "score", "rank")


def bm25_multi(spark, d):
    return bm25.best(_chunks(spark, d), _batch(spark)[1], 24).select("query_id", "intent", "chunk_id", "score", "rank")


def hash_topk(spark, d):
    return vectors.hashed_best(_chunks(spark, d), _batch(spark)[1], 24).select("query_id", "intent", "chunk_id", "score", "rank")


def dense_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.dense_top(e, e.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), 24)


def rrf(spark, d):
    chunks, (_, intents) = _chunks(spark, d), _batch(spark)
    fused = fusion.reciprocal_rank(vectors.hashed_best(chunks, intents, 24), bm25.best(chunks, intents, 24))
    return fused


_HELD: list = []


def _labelled(spark, d):
    """Labelled chunks, kept for all uses in a plan until the next query's: an ingest would have stored them."""
    for old in _HELD:
        if old.sparkSession is spark:
            old.unpersist()
    _HELD[:] = [scored(spark, d).persist()]
    return _HELD[0]


def _answers(spark, d, batch=REQUESTS):
    bundles, intents = _batch(spark, batch)
    return retrieval.answered(_labelled(spark, d), bundles, intents, SETTINGS, L)


def final(spark, d):
    a = _answers(spark, d)
    return a.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), F.array_join("debug_reasons", ", ").alias("reasons"), "citation")


def features(spark, d):
    bundles, intents = _batch(spark)
    chunks = _labelled(spark, d)
    full = chunks.select(*retrieval.CHUNK).join(F.broadcast(retrieval.candidates(chunks, bundles, intents, SETTINGS)), "chunk_id").join(F.broadcast(bundles), "query_id")
    return fusion.featured(full, SETTINGS, L).select("query_id", "chunk_id", *[F.round(f, 6).alias(f) for f in fusion.FEATURES])


def filtered(spark, d):
    bundles, _ = _batch(spark)
    return retrieval.passing(scored(spark, d), bundles)


def rows_of_evidence(spark, d):
    e = evidence.extracted(scored(spark, d).withColumn("citation", F.lit("")), L)
    return e.select("chunk_id", F.coalesce("strategy", F.lit("")).alias("strategy"), F.coalesce("mechanism", F.lit("")).alias("mechanism"), F.coalesce("recommendation", F.lit("")).alias("recommendation"), F.coalesce("experimental_outcome", F.lit("")).alias("outcome"))


def effects(spark, d):
    e = evidence.extracted(scored(spark, d), L).select("chunk_id", F.explode("parameter_effects").alias("e"))
    return e.select("chunk_id", "e.parameter", F.md5("e.relationship_text").alias("text_md5"), "e.directionality", F.coalesce("e.effect_on_defect", F.lit("")).alias("defect"), F.coalesce("e.recommended_reasoning_hint", F.lit("")).alias("hint"))


def trust(spark, d):
    e = evidence.extracted(scored(spark, d), L)
    return e.select("chunk_id", F.coalesce("evidence_type", F.lit("")).alias("evidence_type"), "directness", "confidence", F.coalesce("material", F.lit("")).alias("material"), F.coalesce("process", F.lit("")).alias("process"))


def themed(spark, d):
    """Themes over all documents of a source, ranked by chunk."""
    e = evidence.extracted(scored(spark, d), L).withColumn("query_id", F.substring("source_file", 4, 9).cast("bigint")).withColumn("rank", F.col("chunk_id")).withColumn("citation", F.concat(F.lit("c"), F.col("chunk_id")))
    t = evidence.theme_summary(e)
    return t.select("query_id", "theme", "first_rank", F.md5(F.array_join(F.col("chunk_ids").cast("array<string>"), ",")).alias("chunks_md5"), F.size("citations").cast("bigint").alias("n"))


def packs(spark, d):
    return evidence.context_pack(_answers(spark, d)).select("query_id", F.length("context_text").alias("n_chars"), F.md5("context_text").alias("context_md5"))


def hints(spark, d):
    e = evidence.extracted(_answers(spark, d), L)
    return evidence.reasoning_hints(e).select("query_id", F.array_join("hints", "|").alias("hints"))


def modes(spark, d):
    return _batch(spark)[0].select("query_id", "mode", "summary", F.coalesce("defect_name", F.lit("")).alias("defect_name"), F.array_join("expanded_terms", "|").alias("expanded_terms"), F.array_join("parameter_categories", "|").alias("parameters"))


#: Length of the stored vectors.
WIDTH = 64


def _embed():
    """A model of a kind: numbers from the text's MD5."""
    import hashlib

    return lambda texts: [[ord(h[j % 32]) - 76.0 + j % 7 for j in range(WIDTH)] for h in (hashlib.md5(t.encode()).hexdigest() for t in texts)]


def stored_topk(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.stored_best(chunks, _benchmark(spark, d), 24, _embed).select("query_id", "intent", "chunk_id", "score", "rank")


def facets(spark, d):
    b = _batch(spark)[0]
    return b.select("query_id", *[F.array_join(c, "|").alias(n) for c, n in (("q_process_types", "processes"), ("q_materials", "materials"), ("f_defects", "defects"))], "lexical_query")


def batch_of_questions(spark, d):
    """The benchmark's items as a table of questions, never listed on the driver."""
    items = table(spark, d, "benchmark")
    rows = items.select(*[(F.col("item_id") if c == "query_id" else F.col("text") if c == "question" else F.array() if k.startswith("array<string") else F.lit(None)).cast(k).alias(c) for c, k in (f.split(" ") for f in requests.ASKED.replace("\n", " ").split(", "))])
    b = requests.understood(rows, SETTINGS, L)
    return b.select("query_id", "mode", "summary", F.array_join("q_process_types", "|").alias("processes"), F.array_join("q_materials", "|").alias("materials"), F.explode("intents").alias("i")).select("query_id", "mode", "summary", "processes", "materials", "i.intent", "i.text")


QUERIES = {
    "bm25_topk": bm25_topk, "bm25_multi_intent": bm25_multi, "hash_embed_topk": hash_topk, "dense_topk": dense_topk, "rrf_fuse": rrf, "filter_year_source_facet": filtered, "answerability_features": features,
    "hybrid_final_rank": final, "heuristic_rerank": lambda s, d: _answers(s, d, RERANKED).select("query_id", "rank", "chunk_id", F.round("rerank_score", 6).alias("rerank_score")),
    "best_sentence": rows_of_evidence, "directionality": effects, "confidence": trust, "themes": themed, "context_pack": packs, "reasoning_hints": hints, "query_mode": modes,
    "query_intents": lambda s, d: _batch(s)[1], "query_facets": facets, "stored_vectors_topk": stored_topk, "query_batch": batch_of_questions,
    "retrieval_diagnostics": lambda s, d: retrieval.diagnostics(scored(s, d), _batch(s)[0], SETTINGS),
}

# --- SQL: bundles are values; all else is computed from the tables


#: What the batch means, worked out from the requests themselves: r and i.
_ASKED = asked.meaning(REQUESTS, SETTINGS, L)
_DOCS = "d AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text FROM documents)"


def _bm25(kept: str = "") -> str:
    return f"""tok AS (SELECT chunk_id, {S.tokens('text')} AS ts FROM d),
st AS (SELECT count(*) AS n, sum(len(ts)) / CAST(count(*) AS DOUBLE) AS avgdl FROM tok),
tf AS (SELECT chunk_id, w, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS w FROM tok) GROUP BY chunk_id, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
qt AS (SELECT query_id, intent, w, count(*) AS qtf FROM (SELECT query_id, intent, unnest({S.tokens('text')}) AS w FROM i) GROUP BY ALL),
sc AS (SELECT query_id, intent, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
       FROM qt JOIN tf USING (w) JOIN df USING (w), st GROUP BY query_id, intent, chunk_id),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id, intent ORDER BY score DESC, chunk_id) AS rank FROM sc {kept or 'WHERE score > 0'} QUALIFY rank <= 24)"""


_HTERMS = "list_concat(ws, list_transform(range(1, len(ws)), lambda j: ws[j] || ' ' || ws[j + 1]))"


def _hashed(name: str, keys: str, source: str) -> str:
    words = r"regexp_extract_all(lower(text), '[\pL\pN\pM_\x{200C}\x{200D}]{2,}')"
    return f"""{name}0 AS (SELECT {keys}, {words} AS ws FROM {source}),
{name}1 AS (SELECT {keys}, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 1024 AS INT) AS bucket FROM (SELECT {keys}, unnest({_HTERMS}) AS t FROM {name}0)),
{name}2 AS (SELECT {keys}, bucket, CAST(count(*) AS DOUBLE) AS c FROM {name}1 GROUP BY ALL),
{name} AS (SELECT {keys}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS w FROM {name}2)"""


def _dense(kept: str = "") -> str:
    return f"""{_hashed('hc', 'chunk_id', 'd')}, {_hashed('hq', 'query_id, intent', 'i')},
ds AS (SELECT query_id, intent, chunk_id, round(sum(hc.w * hq.w), 9) AS score FROM hc JOIN hq USING (bucket) GROUP BY query_id, intent, chunk_id),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id, intent ORDER BY score DESC, chunk_id) AS rank FROM ds {kept} QUALIFY rank <= 24)"""


_RRF = """rr AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS rrf, greatest(max(dense), 0.0) AS dense_score, greatest(max(sparse), 0.0) AS sparse_score
 FROM (SELECT query_id, chunk_id, rank, score AS dense, 0.0 AS sparse FROM de UNION ALL SELECT query_id, chunk_id, rank, 0.0, score FROM sp) GROUP BY query_id, chunk_id)"""


_PASS = """pass AS (SELECT query_id, c.doc_id AS chunk_id, heavy FROM chunk c, r WHERE (ymin IS NULL OR 2000 + c.doc_id % 25 >= ymin) AND (ymax IS NULL OR 2000 + c.doc_id % 25 <= ymax)
 AND (len(fp) = 0 OR list_has_any(fp, processes)) AND (len(fm) = 0 OR list_has_any(fm, materials)) AND (len(fs) = 0 OR list_contains(fs, source)) AND (len(fd) = 0 OR list_has_any(fd, defects)))"""
_KEPT = "WHERE score > 0 AND (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM pass WHERE NOT heavy)"


def _signal(cues, bonus="0"):
    words, roles = cues
    return S.clamp(f"least({S.n_hits('m', words)} / {float(len(words))}, 0.6) + least(len(list_intersect(roles, {S.names(roles)})) * 0.3, 0.6) + {bonus}")


_RATIO = "(CASE WHEN len(cats) > 0 THEN len(list_intersect(cats, params)) / CAST(len(list_distinct(cats)) AS DOUBLE) ELSE 0.0 END)"
_ALIAS = " + ".join(f"CASE WHEN list_contains(cats, {S.q(n)}) AND {S.has_any('m', a)} THEN 1 ELSE 0 END" for n, a in L.aliases)
_FEATS = f"""fe AS (SELECT rr.*, r.*, c.*, 2000 + c.doc_id % 25 AS year,
 (dense_score - min(dense_score) OVER w) / greatest(max(dense_score) OVER w - min(dense_score) OVER w, 1e-6) AS dense,
 (sparse_score - min(sparse_score) OVER w) / greatest(max(sparse_score) OVER w - min(sparse_score) OVER w, 1e-6) AS sparse,
 (CASE WHEN coalesce(defect, '') <> '' AND list_contains(defects, defect) THEN 1.0 WHEN len(list_filter(terms, lambda t: t <> '' AND contains(m, t))) > 0 THEN 0.6 ELSE 0.0 END)::DOUBLE AS direct_defect_match,
 {_signal(L.mitigation)} AS mitigation_signal,
 {S.clamp(f"{_RATIO} * 0.5 + (CASE WHEN len(cats) > 0 THEN ({_ALIAS}) / CAST(len(cats) AS DOUBLE) ELSE 0.0 END) * 0.3 + least({S.n_hits('m', L.relations)} / {float(len(L.relations))}, 0.5) * 0.2")} AS parameter_relation,
 {_signal(L.experiment, "CASE WHEN kind = 'experimental' THEN 0.3 ELSE 0 END")} AS experimental_evidence, {_signal(L.mechanism)} AS mechanism_signal,
 (CASE WHEN list_has_any(qp, processes) THEN 0.6 ELSE 0 END + CASE WHEN list_has_any(qm, materials) THEN 0.4 ELSE 0 END)::DOUBLE AS material_process_match,
 direct AS evidence_directness, ref AS reference_penalty, least(bg + CASE WHEN section IN ('introduction', 'abstract') THEN 0.2 ELSE 0 END, 1.0) AS generic_background_penalty,
 (CASE section WHEN 'results and discussion' THEN 0.08 WHEN 'introduction' THEN -0.02 WHEN 'abstract' THEN -0.03 ELSE 0.0 END)::DOUBLE AS section_boost
 FROM rr JOIN r ON rr.query_id = r.query_id JOIN chunk c ON c.doc_id = rr.chunk_id WINDOW w AS (PARTITION BY rr.query_id)),
fi AS (SELECT *, round(0.24 * dense + 0.16 * sparse + 0.2 * direct_defect_match + 0.16 * mitigation_signal + 0.14 * parameter_relation + 0.12 * experimental_evidence + 0.1 * mechanism_signal
 + 0.1 * material_process_match + 0.12 * evidence_directness + section_boost - 0.45 * reference_penalty - 0.08 * generic_background_penalty, 9) AS score FROM fe),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, chunk_id) AS rank FROM fi)"""
_HYBRID = f"WITH {CHUNKS}, {_ASKED}, {_PASS}, d AS (SELECT doc_id AS chunk_id, text FROM chunk), {_bm25(_KEPT)}, {_dense(_KEPT)}, {_RRF}, {_FEATS}"
_REASONS = ", ".join(f"CASE WHEN round({c}, 4) >= {v} THEN {S.q(t)} END" for c, v, t in fusion.REASONS)
_AUTHORS = "(CASE chunk_id % 3 WHEN 0 THEN 'Smith et al.' WHEN 1 THEN 'Wu' ELSE 'Paper ' || chunk_id END)"
_PGS = "(CASE WHEN chunk_id % 3 = 0 THEN 'p. ' || (chunk_id % 9 + 1) ELSE 'pp. ' || (chunk_id % 9 + 1) || '-' || (chunk_id % 9 + 1 + chunk_id % 3) END)"
_CITE = f"'[' || {_AUTHORS} || ', ' || year || ', ' || {_PGS} || ']'"


def _best(cues, least=1, parts="s"):
    return f"list_reduce(list_prepend(struct_pack(n := {least} - 1, t := CAST(NULL AS VARCHAR)), list_transform({parts}, lambda x: struct_pack(n := {S.n_hits(S.match('x'), cues)}, t := {S.strip('x')}))), lambda a, b: CASE WHEN b.n > a.n THEN b ELSE a END).t"


def _direction(x):
    m = S.match(x)
    h = lambda terms: S.has_any(m, terms)
    e = evidence
    return f"""CASE WHEN contains({m}, 'non monotonic') OR (contains({m}, 'too high') AND contains({m}, 'too low')) THEN 'non_monotonic' WHEN {h(e.WINDOW)} THEN 'optimal_window'
 WHEN {h(e.HIGH)} AND {h(e.LOW)} THEN 'non_monotonic' WHEN {h(e.HIGH)} AND {h(e.RISE)} THEN 'increase_risk_when_high' WHEN {h(e.LOW)} AND {h(e.RISE)} THEN 'increase_risk_when_low'
 WHEN {h(e.LOW)} AND {h(e.FALL)} THEN 'increase_risk_when_high' WHEN {h(e.HIGH)} AND {h(e.FALL)} THEN 'increase_risk_when_low' ELSE 'unclear' END"""


_NAMED = " ".join(f"WHEN {S.q(n)} THEN {S.has_any('sm', a)}" for n, a in L.aliases)
_EFFECTS = f"""ep AS (SELECT doc_id, defects, s, unnest(params) AS parameter FROM chunk),
es AS (SELECT doc_id, defects, parameter, unnest(s) AS x, unnest(range(len(s))) AS j FROM ep),
em AS (SELECT *, {S.match('x')} AS sm FROM es),
ef AS (SELECT *, {S.n_hits('sm', L.effect_cues)} AS n FROM em WHERE CASE parameter {_NAMED} ELSE contains(sm, replace(parameter, '_', ' ')) END),
eb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parameter ORDER BY n DESC, j) AS o FROM ef QUALIFY o = 1),
ee AS (SELECT doc_id, parameter, {S.strip('x')} AS t, {_direction('x')} AS directionality, coalesce(defects[1], '') AS defect, replace(parameter, '_', ' ') AS p FROM eb)"""
_REQUESTED = ", ".join(f"({k}, {S.names(names)}, {S.q(say)})" for k, (names, say) in enumerate(evidence.REQUESTED))
_HINT = """CASE directionality WHEN 'increase_risk_when_high' THEN 'Check whether ' || p || ' is too high relative to the defect mechanism.' WHEN 'increase_risk_when_low' THEN 'Check whether ' || p || ' is too low and creating defect risk.'
 WHEN 'non_monotonic' THEN 'Treat ' || p || ' as potentially non-monotonic and evaluate both high and low extremes.' WHEN 'optimal_window' THEN 'Look for an optimal operating window for ' || p || ' rather than a one-directional trend.' ELSE '' END"""
_SENT = f"sx AS (SELECT *, {_best(L.strategy_cues)} AS strategy, {_best(L.mechanism_cues)} AS mech, {_best(L.recommendation_cues)} AS rec, {_best(L.outcome_cues)} AS outc FROM chunk)"
_LABEL = "CASE WHEN direct >= 0.65 THEN 'high' WHEN direct >= 0.35 THEN 'medium' ELSE 'low' END"
_CONF = f"""round(round({S.clamp(f"0.35 + CASE WHEN strategy IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN mech IS NOT NULL THEN 0.12 ELSE 0 END + CASE WHEN ne > 0 THEN 0.15 ELSE 0 END + CASE WHEN outc IS NOT NULL THEN 0.12 ELSE 0 END + CASE {_LABEL} WHEN 'high' THEN 0.08 WHEN 'medium' THEN 0.04 ELSE 0 END + CASE WHEN kind = 'experimental' THEN 0.06 ELSE 0 END - ref * 0.15", 0.0, 0.98)}, 9), 2)"""
_THEMES = """list_filter([CASE WHEN list_has_any(params, ['current', 'voltage', 'travel_speed']) THEN 'optimize heat input-related parameters' END,
 CASE WHEN list_contains(params, 'shielding_gas') OR contains(lower(coalesce(strategy, '')), 'argon') THEN 'stabilize shielding gas and gas coverage' END,
 CASE WHEN list_has_any(params, ['wire_feed_speed', 'pulse_frequency']) THEN 'stabilize metal transfer and deposition behavior' END,
 CASE WHEN nonmono > 0 THEN 'treat key process parameters as non-monotonic' END], lambda t: t IS NOT NULL)"""
_ALL = f"WITH {CHUNKS}, {_EFFECTS}, {_SENT}, ec AS (SELECT doc_id, count(*) AS ne, count(*) FILTER (WHERE directionality = 'non_monotonic') AS nonmono FROM ee GROUP BY doc_id), sy AS (SELECT sx.*, coalesce(ne, 0) AS ne, coalesce(nonmono, 0) AS nonmono FROM sx LEFT JOIN ec ON sx.doc_id = ec.doc_id)"
_BENCH_ASKED = asked.meaning(None, SETTINGS, L)
_BENCH = "i AS (SELECT item_id AS query_id, 'free_text' AS intent, coalesce(text, '') AS text FROM benchmark)"
SQL = {
    "bm25_topk": f"WITH {_DOCS}, {_BENCH}, {_bm25()} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM sp",
    "bm25_multi_intent": f"WITH {_DOCS}, {_ASKED}, {_bm25()} SELECT query_id, intent, chunk_id, score, CAST(rank AS INT) AS rank FROM sp",
    "hash_embed_topk": f"WITH {_DOCS}, {_ASKED}, {_dense()} SELECT query_id, intent, chunk_id, score, CAST(rank AS INT) AS rank FROM de",
    "dense_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 100 = 0)
SELECT query_id, vec_id AS id, round(list_cosine_similarity(qv, v), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qv, v), 9) DESC, vec_id) AS INT) AS rank FROM e, q QUALIFY rank <= 24""",
    "rrf_fuse": f"WITH {_DOCS}, {_ASKED}, {_bm25()}, {_dense()}, {_RRF} SELECT query_id, chunk_id, rrf, dense_score, sparse_score FROM rr",
    "filter_year_source_facet": f"WITH {CHUNKS}, {_ASKED}, {_PASS} SELECT query_id, chunk_id, heavy AS is_reference_heavy FROM pass",
    "answerability_features": f"{_HYBRID} SELECT query_id, chunk_id, {', '.join(f'round({f}, 6) AS {f}' for f in fusion.FEATURES)} FROM fe",
    "hybrid_final_rank": f"{_HYBRID} SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score, array_to_string(list_filter([{_REASONS}], lambda x: x IS NOT NULL), ', ') AS reasons, {_CITE} AS citation FROM ra WHERE rank <= 8",
    "heuristic_rerank": f"""{_HYBRID}, h AS (SELECT *, round(score * 0.82 + len(list_intersect({S.tokens('lexical')}, {S.tokens('text')})) / CAST(greatest(len(list_distinct({S.tokens('lexical')})), 1) AS DOUBLE) * 0.12 + CASE WHEN round(direct_defect_match, 4) >= 0.8 THEN 0.08 ELSE 0 END, 9) AS rs FROM ra WHERE rank <= 12)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank) AS INT) AS rank, chunk_id, round(rs, 6) AS rerank_score FROM h QUALIFY rank <= 8""".replace("AS rank, chunk_id, round(rs, 6) AS rerank_score FROM h QUALIFY rank <= 8", "AS rank, chunk_id, round(rs, 6) AS rerank_score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, h.rank) <= 8"),
    "best_sentence": f"WITH {CHUNKS}, {_SENT} SELECT doc_id AS chunk_id, coalesce(strategy, '') AS strategy, coalesce(mech, '') AS mechanism, coalesce(rec, '') AS recommendation, coalesce(outc, '') AS outcome FROM sx",
    "directionality": f"WITH {CHUNKS}, {_EFFECTS} SELECT doc_id AS chunk_id, parameter, md5(t) AS text_md5, directionality, defect, {_HINT} AS hint FROM ee",
    "confidence": f"{_ALL} SELECT doc_id AS chunk_id, coalesce(list_filter({S.names(evidence.PRIORITY)}, lambda x: list_contains(roles, x))[1], roles[1], '') AS evidence_type, {_LABEL} AS directness, {_CONF} AS confidence, array_to_string(materials, ', ') AS material, array_to_string(processes, ', ') AS process FROM sy",
    "themes": f"""{_ALL}, th AS (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS query_id, CASE WHEN len({_THEMES}) > 0 THEN {_THEMES} WHEN strategy IS NOT NULL THEN ['apply direct mitigation guidance from literature'] ELSE [] END AS ts FROM sy)
SELECT query_id, theme, min(doc_id) AS first_rank, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS chunks_md5, count(*) AS n FROM (SELECT doc_id, query_id, unnest(ts) AS theme FROM th) GROUP BY query_id, theme""",
    "context_pack": f"{_HYBRID}, cp AS (SELECT query_id, string_agg(rank || '. ' || {_CITE} || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS t FROM ra WHERE rank <= 8 GROUP BY query_id) SELECT query_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS context_md5 FROM cp",
    "reasoning_hints": f"""{_HYBRID}, hp AS (SELECT query_id, rank, doc_id, s, unnest(ps) AS parameter, unnest(range(len(ps))) AS pj FROM (SELECT *, {asked.distinct('list_concat(params, cats)')} AS ps FROM ra WHERE rank <= 8)),
hs AS (SELECT query_id, rank, doc_id, parameter, pj, unnest(s) AS x, unnest(range(len(s))) AS j FROM hp), hm AS (SELECT *, {S.match('x')} AS sm FROM hs),
hf AS (SELECT *, {S.n_hits('sm', L.effect_cues)} AS n FROM hm WHERE CASE parameter {_NAMED} ELSE contains(sm, replace(parameter, '_', ' ')) END),
hb AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, parameter ORDER BY n DESC, j) AS o FROM hf QUALIFY o = 1),
hd AS (SELECT query_id, rank, pj, replace(parameter, '_', ' ') AS p, {_direction(S.strip('x'))} AS directionality FROM hb),
hh AS (SELECT query_id, rank, pj, {_HINT} AS hint FROM hd UNION ALL SELECT query_id, 1000, k, hint FROM (SELECT DISTINCT query_id, cats FROM ra WHERE rank <= 8), (VALUES {_REQUESTED}) AS v(k, names, hint) WHERE list_has_any(cats, names)),
hu AS (SELECT query_id, hint, min(rank * 1000 + pj) AS o FROM hh WHERE hint <> '' GROUP BY query_id, hint)
SELECT q.query_id, coalesce(string_agg(hint, '|' ORDER BY o), '') AS hints FROM (SELECT DISTINCT query_id FROM ra) q LEFT JOIN hu ON q.query_id = hu.query_id GROUP BY q.query_id""",
    "stored_vectors_topk": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT item_id AS query_id, list_transform(range({WIDTH}), lambda j: CAST(ascii(substr(md5(coalesce(text, '')), CAST(j % 32 + 1 AS BIGINT), 1)) - 76 + j % 7 AS DOUBLE)) AS qv FROM benchmark),
s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(qv, v), 9) AS score FROM e, q)
SELECT query_id, 'free_text' AS intent, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 24""",
    "query_mode": f"WITH {_ASKED} SELECT query_id, mode, summary, coalesce(defect, '') AS defect_name, array_to_string(terms, '|') AS expanded_terms, array_to_string(cats, '|') AS parameters FROM r",
    "query_intents": f"WITH {_ASKED} SELECT query_id, intent, text FROM i",
    "query_facets": f"WITH {_ASKED} SELECT query_id, array_to_string(qp, '|') AS processes, array_to_string(qm, '|') AS materials, array_to_string(fd, '|') AS defects, lexical AS lexical_query FROM r",
    "query_batch": f"WITH {_BENCH_ASKED} SELECT query_id, mode, summary, array_to_string(qp, '|') AS processes, array_to_string(qm, '|') AS materials, intent, text FROM r JOIN i USING (query_id)",
    "retrieval_diagnostics": f"WITH {CHUNKS}, {_ASKED}, {_PASS} SELECT r.query_id, count(chunk_id) AS candidate_chunks_considered, count(*) FILTER (WHERE heavy) AS reference_heavy_chunks_removed FROM r LEFT JOIN pass ON r.query_id = pass.query_id GROUP BY r.query_id",
}
