"""SQL that works out what requests mean from the requests as they were made. Written apart from the plan."""

from __future__ import annotations

from ..config import Settings
from ..lexicon import Lexicon
from ..plans import requests as R
from . import sql as S


def _strings(xs) -> str:
    return f"{S.names(xs)}::VARCHAR[]"


def _or_null(x) -> str:
    return "NULL" if x is None else S.q(str(x))


def distinct(xs: str) -> str:
    """The list without repeats, in order."""
    return f"list_filter({xs}, lambda e, k: list_position({xs}, e) = k)"


def _row(r: R.Request) -> str:
    given = "NULL::STRUCT(n VARCHAR, v VARCHAR)[]"
    if r.process_parameters is not None:
        given = "[" + ", ".join(f"{{'n': {S.q(k)}, 'v': {_or_null(v)}}}" for k, v in r.process_parameters.items()) + "]::STRUCT(n VARCHAR, v VARCHAR)[]"
    f = r.filters or R.Filters()
    year = lambda y: "NULL::INT" if y is None else str(y)
    expand = "NULL::BOOLEAN" if r.query_expansion is None else str(r.query_expansion)
    return f"(CAST({r.query_id} AS BIGINT), {_or_null(r.defect_name)}::VARCHAR, {_or_null(r.question)}::VARCHAR, {given}, {year(f.year_min)}, {year(f.year_max)}, {_strings(f.process_types)}, {_strings(f.materials)}, {_strings(f.source_files)}, {_strings(f.defect_terms)}, {expand})"


def meaning(batch, settings: Settings, lexicon: Lexicon) -> str:
    """CTEs up to r, a row for each request, and i, a row for each of its intents. Without a batch the benchmark's items are
    questions. Parameters nested in `extra` aren't covered."""
    none = _row(R.Request(0)).split(", ", 3)[3][:-1]
    source = f"SELECT item_id, NULL::VARCHAR, text, {none} FROM benchmark" if batch is None else "VALUES " + ", ".join(map(_row, batch))
    defects = ", ".join(f"({k}, {S.q(n)}, {_strings(v)})" for k, (n, v) in enumerate(lexicon.defects))
    drivers = ", ".join(f"({S.q(n)}, {_strings(v)})" for n, v in lexicon.mechanisms)
    suffixed = ", ".join(f"({S.q(k)}, {S.q(v)})" for k, v in R.SUFFIXED.items())
    known = ", ".join(f"({k}, {S.q(n)})" for k, n in enumerate(R.PARAMETERS))
    detect = lambda m, terms: "list_filter([" + ", ".join(f"CASE WHEN {S.found(m, S.either(p))} THEN {S.q(n)} END" for n, p in terms) + "], lambda x: x IS NOT NULL)"
    phrases = lambda *xs: S.strip(f"array_to_string({distinct('list_concat(' + ', '.join(xs) + ')')}, ' ')")
    some = lambda *xs: "array_to_string(list_filter(list_concat(" + ", ".join(xs) + "), lambda x: x <> ''), ' ')"
    return f"""q0(query_id, dn, qu, given, ymin, ymax, fp, fm, fs, fd0, expand) AS ({source}),
lx(pos, canonical, variants) AS (VALUES {defects}), mx(canonical, drivers) AS (VALUES {drivers}), ux(spelt, plain) AS (VALUES {suffixed}), kx(pos, plain) AS (VALUES {known}),
pe AS (SELECT query_id, e.n AS n, e.v AS v, pos FROM (SELECT query_id, unnest(given) AS e, unnest(range(len(given))) AS pos FROM q0)),
pk AS (SELECT pe.query_id, coalesce(ux.plain, pe.n) AS n, v, kx.pos AS pos FROM pe LEFT JOIN ux ON pe.n = ux.spelt JOIN kx ON coalesce(ux.plain, pe.n) = kx.plain
       WHERE v IS NOT NULL AND (ux.plain IS NULL OR NOT EXISTS (SELECT 1 FROM pe p2 WHERE p2.query_id = pe.query_id AND p2.n = ux.plain))),
po AS (SELECT query_id, n, v, 1000 + pos AS pos FROM pe WHERE n NOT IN (SELECT plain FROM kx) AND n NOT IN (SELECT spelt FROM ux)),
pa AS (SELECT query_id, list(n ORDER BY pos) AS cats, coalesce(list(v ORDER BY pos) FILTER (WHERE n = 'shielding_gas' AND v <> ''), []) AS gas FROM (SELECT * FROM pk UNION ALL SELECT * FROM po) GROUP BY query_id),
q1 AS (SELECT q0.*, coalesce(cats, []) AS cats, coalesce(gas, []::VARCHAR[]) AS gas, {S.match("coalesce(dn, '')")} AS dm, {S.strip("coalesce(qu, '')")} AS q FROM q0 LEFT JOIN pa ON q0.query_id = pa.query_id),
q2 AS (SELECT q1.*, list_transform(cats, lambda c: replace(c, '_', ' ')) AS names, CASE WHEN dn <> '' THEN coalesce((SELECT min_by(canonical, pos) FROM lx WHERE dm = canonical OR list_contains(list_transform(variants, lambda v: {S.match('v')}), dm)), lower({S.strip('dn')})) END AS defect FROM q1),
q3 AS (SELECT q2.*, CASE WHEN defect IS NULL THEN []::VARCHAR[] ELSE {distinct("list_concat([defect], CASE WHEN coalesce(expand, " + str(settings.query_expansion_enabled) + ") THEN coalesce(lx.variants, []) ELSE [] END)")} END AS terms FROM q2 LEFT JOIN lx ON lx.canonical = defect),
q4 AS (SELECT *, {S.match(some("[q]", "CASE WHEN defect IS NULL THEN [] ELSE [defect] END", "names", "gas"))} AS pt, {S.match(some("[q]", "names", "gas"))} AS mt FROM q3),
q5 AS (SELECT *, {detect('pt', lexicon.processes)}::VARCHAR[] AS qp, {distinct("list_concat(" + detect('mt', lexicon.materials) + "::VARCHAR[], fm)")} AS qm,
  CASE WHEN len(fd0) = 0 AND dn <> '' THEN terms[1:1] ELSE fd0 END AS fd, CASE WHEN dn <> '' AND given IS NOT NULL THEN CASE WHEN qu <> '' THEN 'combined' ELSE 'defect_with_process' END WHEN qu <> '' AND coalesce(dn, '') = '' THEN 'free_text' ELSE 'defect_only' END AS mode,
  CASE WHEN qu <> '' THEN CASE WHEN defect IS NULL THEN {S.q(R.SUMMARY_FREE)} WHEN given IS NOT NULL THEN format({S.q(R.SUMMARY_COMBINED.replace('%s', '{}'))}, defect) ELSE format({S.q(R.SUMMARY_FOCUSED.replace('%s', '{}'))}, defect) END
    WHEN given IS NOT NULL AND defect IS NOT NULL THEN format({S.q(R.SUMMARY_AUGMENTED.replace('%s', '{}'))}, defect) ELSE format({S.q(R.SUMMARY_DEFECT.replace('%s', '{}'))}, coalesce(defect, {S.q(R.SUMMARY_UNSPECIFIED)})) END AS summary FROM q4),
q6 AS (SELECT q5.*, CASE WHEN len(qp) > 0 THEN qp ELSE {_strings(R.DEFAULT_PROCESSES)} END AS places, coalesce(mx.drivers, []) AS drivers FROM q5 LEFT JOIN mx ON mx.canonical = defect),
q7 AS (SELECT *, list_filter(CASE WHEN defect IS NULL AND q <> '' THEN [{{'k': 'free_text', 't': q}}] ELSE [
  {{'k': 'defect_mitigation', 't': {phrases('terms', 'places', 'qm', 'gas', _strings(R.MITIGATION))}}}, {{'k': 'defect_parameter_relationship', 't': {phrases('terms', 'places', 'names', 'gas', _strings(R.RELATIONSHIP))}}},
  {{'k': 'defect_mechanism', 't': {phrases('terms', 'places', 'qm', 'drivers', _strings(R.MECHANISM))}}}, {{'k': 'defect_material_process', 't': {phrases('terms', 'places', 'qm', 'gas', _strings(R.MATERIAL_PROCESS))}}}, {{'k': 'user_question', 't': q}}] END, lambda x: x.t <> '') AS its FROM q6),
q8 AS (SELECT *, list_filter(list_concat(list_transform(its, lambda x: x.t), [q], {_strings(settings.default_process_terms)}), lambda x: x <> '') AS every FROM q7),
r AS (SELECT query_id, defect, terms, cats, qp, qm, array_to_string({distinct('every')}, ' ') AS lexical, ymin, ymax, fp, fm, fs, fd, mode, summary, its FROM q8),
i AS (SELECT query_id, x.k AS intent, x.t AS text FROM (SELECT query_id, unnest(its) AS x FROM q8))"""
