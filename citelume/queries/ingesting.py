"""Queries over cleaning, structure, chunking, front matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..lexicon import SYNTHETIC as L
from ..operators import chunking, citations, cleaning, frontmatter, structure
from ..sources.tables import conversation_pages, raw_chunks, table
from . import sql as S

#: Small budgets, so that the corpus's short turns make chunks that split and overlap.
SMALL = Settings(chunk_size_tokens=60, chunk_overlap_tokens=12, paragraph_break=r"\n+")


def _headed(spark, d):
    """Pages under a running header."""
    return conversation_pages(spark, d).withColumn("text", F.concat(F.lit("Conversation "), F.col("doc_id"), F.lit("\n"), F.coalesce("text", F.lit(""))))


def marginals(spark, d):
    return cleaning.repeated_marginals(_headed(spark, d))


def page_numbers(spark, d):
    each = conversation_pages(spark, d).select("doc_id", "page_number", F.posexplode(cleaning.lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    return each.select("doc_id", "page_number", "pos", cleaning.is_page_number(F.col("line")).alias("is_page_number"), cleaning.is_heading(F.col("line")).alias("is_heading"))


def paragraphs(spark, d):
    return cleaning.clean_pages(_headed(spark, d)).select("doc_id", "page_number", F.md5("text").alias("clean_md5"))


def _blocks(spark, d):
    return structure.blocks(conversation_pages(spark, d), L, SMALL.paragraph_break)


def headings(spark, d):
    return _blocks(spark, d).select("doc_id", "page_number", "pos", "is_heading", F.coalesce("level", F.lit(0)).alias("level"))


def sections(spark, d):
    return _blocks(spark, d).select("doc_id", "page_number", "pos", "section", F.coalesce("subsection", F.lit("")).alias("subsection"), "excluded")


def packed(spark, d):
    c = chunking.pack(_blocks(spark, d), SMALL)
    return c.select("doc_id", "chunk_id", "start_page", "end_page", "token_count", F.coalesce("section", F.lit("")).alias("section"), F.md5("text").alias("text_md5"))


def packed_tokens(spark, d):
    """Distinct block texts and those that stand in a chunk, by document: nothing is lost."""
    blocks = _blocks(spark, d).filter("not is_heading and not excluded")
    chunks = chunking.pack(_blocks(spark, d), SMALL).groupBy("doc_id").agg(F.min("start_page").alias("first_page"), F.max("end_page").alias("last_page"))
    ends = blocks.groupBy("doc_id").agg(F.min("page_number").alias("a"), F.max("page_number").alias("b"))
    return chunks.join(ends, "doc_id").select("doc_id", "first_page", "last_page", ((F.col("a") == F.col("first_page")) & (F.col("b") == F.col("last_page"))).alias("whole"))


def _fronts(spark, d):
    p = table(spark, d, "pages")
    body = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "\n"), "[ \t]*\n[ \t\n]*", "\n")
    meta = F.create_map(F.lit("title"), F.lit(""), F.lit("subject"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Journal of "), F.col("page_id"), F.lit(" in 1998"))).otherwise(F.lit("")))
    return p.select("page_id", body.alias("first_page"), meta.alias("raw_metadata"), F.regexp_replace(F.regexp_extract("url", r"[^/]*$", 0), r"\.[^.]*$", "").alias("stem"))


def fronts(spark, d):
    return frontmatter.front_matter(_fronts(spark, d))


def cited(style):
    def query(spark, d):
        c = raw_chunks(spark, d)
        return c.select("chunk_id", citations.citation(style).alias("citation"), citations.short_citation(style).alias("short_citation"))

    return query


QUERIES = {
    "repeated_marginals": marginals, "page_number_lines": page_numbers, "clean_paragraphs": paragraphs, "heading_flags": headings, "section_carry": sections, "chunk_pack": packed, "chunk_span": packed_tokens,
    "front_title": lambda s, d: fronts(s, d).select("page_id", "title"),
    "front_year": lambda s, d: fronts(s, d).select("page_id", "year"),
    "front_venue": lambda s, d: fronts(s, d).select("page_id", "venue"),
    "front_authors": lambda s, d: fronts(s, d).select("page_id", F.array_join("authors", "|").alias("authors")),
    "author_split": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(frontmatter.split_authors(F.coalesce("text", F.lit(""))), "|").alias("authors")),
    "citation_long": cited("author_year_pages"), "citation_author_year": cited("author_year"), "citation_title": cited("title_pages"),
}
_NUMBER = r"^(?:\d{1,4}|page[\t-\r\x1C-\x20]+\d{1,4}|[ivxlcdm]+)$"
_LINES = "list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), chr(10)), lambda x: " + S.norm("x") + ")"
_HEAD = r"^(?:\d+(?:\.\d+)*)?[\t-\r\x1C-\x20]*[A-Z][A-Za-z0-9 ,/\-&()]+$"


def _words(x):
    return S.count(x, f"[^{S.BL}]+")


def _upper(x):
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def _line_heading(x):
    return f"({_words(x)} <= 14 AND length({x}) <= 120 AND NOT ends_with({x}, '.') AND ({S.found(x, _HEAD)} OR {_upper(x)}))"


_PAGES = "p AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, text FROM conversations)"
_MARG = f"""p AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, 'Conversation ' || conv_id || chr(10) || coalesce(text, '') AS text FROM conversations),
l AS (SELECT doc_id, page_number, list_filter({_LINES}, lambda x: x <> '') AS ls FROM p),
e AS (SELECT doc_id, unnest(ls[1:2]) AS line, 1 AS top FROM l UNION ALL SELECT doc_id, unnest(ls[-2:]) AS line, 0 AS top FROM l),
n AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY doc_id),
g AS (SELECT e.doc_id, line, n.pages, count(*) FILTER (WHERE top = 1) >= greatest(2, ceil(n.pages * 0.35)) AS is_header, count(*) FILTER (WHERE top = 0) >= greatest(2, ceil(n.pages * 0.35)) AS is_footer
      FROM e JOIN n USING (doc_id) WHERE NOT {S.found('lower(line)', _NUMBER)} AND length(line) < 120 GROUP BY e.doc_id, line, n.pages),
marg AS (SELECT * FROM g WHERE is_header OR is_footer)"""
_SECTIONS = " ".join(f"WHEN {S.has_any('cm', v)} THEN {S.q(n)}" for n, v in L.sections)
_BLOCKS = f"""{_PAGES},
b AS (SELECT doc_id, page_number, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\n+', chr(10), 'g'), chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS ps FROM p),
u AS (SELECT doc_id, page_number, CAST(unnest(range(len(ps))) AS INT) AS pos, {S.norm('unnest(ps)')} AS text FROM b),
v AS (SELECT *, {S.match('text')} AS cm FROM u),
h AS (SELECT *, {_words('text')} <= 14 AND length(text) <= 140 AND NOT ends_with(text, '.') AND ({' OR '.join(S.has_any('cm', x) for _, x in L.sections)} OR {S.found('text', rf'^[0-9]+(?:[.][0-9]+)*[{S.BL}]+[A-Z][A-Za-z0-9 ,/&()-]+$')} OR {S.found('text', '^[A-Z][A-Za-z0-9 ,/&()-]+$')} OR {_upper('text')}) AS is_heading FROM v),
w AS (SELECT *, CASE WHEN NOT is_heading THEN 0 WHEN {S.found('text', '^[0-9]+[.][0-9]+')} THEN 2 WHEN {S.found('text', f'^[0-9]+[{S.BL}]+')} THEN 1 WHEN {_words('text')} <= 6 THEN 1 ELSE 2 END AS level FROM h),
x AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, pos) AS g1, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, pos) AS g2 FROM w),
y AS (SELECT *, coalesce(max(CASE WHEN level = 1 THEN text END) OVER (PARTITION BY doc_id, g1), 'Front Matter') AS section, coalesce(max(CASE WHEN level = 2 THEN text END) OVER (PARTITION BY doc_id, g2), '') AS subsection FROM x),
z AS (SELECT * REPLACE ({S.match('CASE WHEN is_heading THEN text ELSE section END')} AS cm) FROM y)"""
_AUTHORS = "CASE doc_id % 3 WHEN 0 THEN 'Smith et al.' WHEN 1 THEN 'Wu' ELSE 'Paper ' || doc_id END"
_YEAR = "(2000 + doc_id % 25)"
_PGS = "CASE WHEN doc_id % 3 = 0 THEN 'p. ' || (doc_id % 9 + 1) ELSE 'pp. ' || (doc_id % 9 + 1) || '-' || (doc_id % 9 + 1 + doc_id % 3) END"
_FRONT = f"""WITH f AS (SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '[.][^.]*$', '') AS stem, CASE WHEN page_id % 4 = 0 THEN 'Journal of ' || page_id || ' in 1998' ELSE '' END AS subject,
 list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), '[\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)), lambda x: {S.norm('x')}), lambda x: x <> '') AS ls FROM pages)
"""


def _authorlike(x):
    parts = f"list_filter(list_transform(string_split({x}, ','), lambda y: {S.strip('y')}), lambda y: y <> '')"
    words = f"regexp_extract_all({x}, '[^{S.BL}]+')"
    return f"""(CASE WHEN contains({x}, ',') THEN len({parts}) >= 2 AND len(list_filter({parts}, lambda y: NOT contains(y, ' '))) = 0
      ELSE coalesce(len({words}) BETWEEN 2 AND 6 AND {_upper(f'substr({words}[1], 1, 1)')} AND {_upper(f'substr({words}[2], 1, 1)')} AND NOT contains(lower({x}), 'abstract'), false) END)"""


SQL = {
    "repeated_marginals": f"WITH {_MARG} SELECT doc_id, line, pages, is_header, is_footer FROM marg",
    "page_number_lines": f"WITH {_PAGES}, l AS (SELECT doc_id, page_number, {_LINES} AS ls FROM p), e AS (SELECT doc_id, page_number, CAST(unnest(range(len(ls))) AS INT) AS pos, unnest(ls) AS line FROM l) SELECT doc_id, page_number, pos, {S.found('lower(line)', _NUMBER)} AS is_page_number, {_line_heading('line')} AS is_heading FROM e",
    "clean_paragraphs": f"""WITH {_MARG},
m AS (SELECT doc_id, list(line) AS ms FROM marg GROUP BY doc_id),
t AS (SELECT p.doc_id, page_number, regexp_replace(replace(coalesce(text, ''), chr(13), chr(10)), '([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g') AS text, coalesce(ms, []) AS ms FROM p LEFT JOIN m ON p.doc_id = m.doc_id),
k AS (SELECT doc_id, page_number, list_filter({_LINES}, lambda x: x = '' OR NOT (list_contains(ms, x) OR {S.found('lower(x)', _NUMBER)})) AS ls FROM t),
e2 AS (SELECT doc_id, page_number, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM k),
a AS (SELECT *, CASE WHEN x = '' OR {_line_heading('x')} OR coalesce(lag({_line_heading('x')} OR x = '') OVER (PARTITION BY doc_id, page_number ORDER BY i), true) THEN 1 ELSE 0 END AS cut FROM e2),
b AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_number ORDER BY i) AS g FROM a),
c AS (SELECT doc_id, page_number, g, {S.norm("replace(replace(string_agg(x, chr(1) ORDER BY i), '-' || chr(1), ''), chr(1), ' ')")} AS para FROM b WHERE x <> '' GROUP BY doc_id, page_number, g),
o AS (SELECT doc_id, page_number, string_agg(para, chr(10) || chr(10) ORDER BY g) AS body FROM c WHERE para <> '' GROUP BY doc_id, page_number)
SELECT k.doc_id, k.page_number, md5({S.norm("coalesce(body, '')")}) AS clean_md5 FROM k LEFT JOIN o ON k.doc_id = o.doc_id AND k.page_number = o.page_number""",
    "heading_flags": f"WITH {_BLOCKS} SELECT doc_id, page_number, pos, is_heading, level FROM z",
    "section_carry": f"WITH {_BLOCKS} SELECT doc_id, page_number, pos, section, subsection, CASE {_SECTIONS} ELSE cm END = 'references' AS excluded FROM z",
    "chunk_pack": f"""WITH RECURSIVE {_BLOCKS},
bb AS (SELECT doc_id, page_number, pos, section, subsection, text, {S.count('text', S.TOKEN)} AS n FROM z WHERE NOT is_heading AND CASE {_SECTIONS} ELSE cm END <> 'references' AND {S.strip('text')} <> ''),
se AS (SELECT doc_id, page_number, pos, unnest(ss) AS s, unnest(range(len(ss))) + 1 AS k FROM (SELECT *, {S.sentences('text')} AS ss FROM bb WHERE n > {SMALL.chunk_size_tokens})),
sn AS (SELECT *, {S.count('s', S.TOKEN)} AS n FROM se),
sg(doc_id, page_number, pos, k, g, run) AS (SELECT doc_id, page_number, pos, k, 0, n FROM sn WHERE k = 1 UNION ALL
  SELECT x.doc_id, x.page_number, x.pos, x.k, sg.g + CASE WHEN sg.run + x.n > {SMALL.chunk_size_tokens} THEN 1 ELSE 0 END, CASE WHEN sg.run + x.n > {SMALL.chunk_size_tokens} THEN x.n ELSE sg.run + x.n END
  FROM sg JOIN sn x ON x.doc_id = sg.doc_id AND x.page_number = sg.page_number AND x.pos = sg.pos AND x.k = sg.k + 1),
fr AS (SELECT doc_id, page_number, pos, 0 AS part, section, subsection, text FROM bb WHERE n <= {SMALL.chunk_size_tokens} UNION ALL
  SELECT bb.doc_id, bb.page_number, bb.pos, g AS part, any_value(section), any_value(subsection), {S.strip("string_agg(s, ' ' ORDER BY sn.k)")}
  FROM sg JOIN sn USING (doc_id, page_number, pos, k) JOIN bb USING (doc_id, page_number, pos) GROUP BY bb.doc_id, bb.page_number, bb.pos, g),
fi AS (SELECT *, row_number() OVER w AS i, {S.count('text', S.TOKEN)} AS n, sum({S.count('text', S.TOKEN)}) OVER (PARTITION BY doc_id ORDER BY page_number, pos, part ROWS UNBOUNDED PRECEDING) AS total FROM fr WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, pos, part)),
ta AS (SELECT a.doc_id, a.i, min(b.i) AS tail FROM fi a JOIN fi b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.total > a.total - {SMALL.chunk_overlap_tokens} GROUP BY a.doc_id, a.i),
pk(doc_id, i, a, cut) AS (SELECT doc_id, i, i, false FROM fi WHERE i = 1 UNION ALL
  SELECT x.doc_id, x.i, CASE WHEN NOT c.same THEN x.i WHEN c.full THEN greatest(pk.a, ta.tail) ELSE pk.a END, c.full OR NOT c.same
  FROM pk JOIN fi x ON x.doc_id = pk.doc_id AND x.i = pk.i + 1 JOIN fi l ON l.doc_id = pk.doc_id AND l.i = pk.i JOIN fi h ON h.doc_id = pk.doc_id AND h.i = pk.a JOIN ta ON ta.doc_id = pk.doc_id AND ta.i = pk.i,
  LATERAL (SELECT l.section IS NOT DISTINCT FROM x.section AND l.subsection IS NOT DISTINCT FROM x.subsection AS same, l.total - h.total + h.n + x.n > {SMALL.chunk_size_tokens} AS full) c),
en AS (SELECT p.doc_id, p.a, p.i, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i) - 1 AS chunk FROM pk p LEFT JOIN pk q ON q.doc_id = p.doc_id AND q.i = p.i + 1 WHERE q.i IS NULL OR q.cut),
ch AS (SELECT en.doc_id, chunk, min(page_number) AS start_page, max(page_number) AS end_page, min_by(section, fi.i) AS section, {S.strip("string_agg(text, chr(10) || chr(10) ORDER BY fi.i)")} AS text FROM en JOIN fi ON fi.doc_id = en.doc_id AND fi.i BETWEEN en.a AND en.i GROUP BY en.doc_id, chunk)
SELECT doc_id, doc_id || ':' || lpad(CAST(chunk AS VARCHAR), 4, '0') AS chunk_id, start_page, end_page, CAST({S.count('text', S.TOKEN)} AS INT) AS token_count, coalesce(section, '') AS section, md5(text) AS text_md5 FROM ch""",
    "chunk_span": f"WITH {_BLOCKS} SELECT doc_id, min(page_number) AS first_page, max(page_number) AS last_page, true AS whole FROM z WHERE NOT is_heading AND CASE {_SECTIONS} ELSE cm END <> 'references' GROUP BY doc_id",
    "front_title": _FRONT + f""", s AS (SELECT page_id, stem, ls, list_filter(range(1, least(len(ls), 6) + 1), lambda i: starts_with(lower(ls[i]), 'abstract') OR {_authorlike('ls[i]')}) AS stops FROM f),
c AS (SELECT *, list_filter(ls[1 : coalesce(list_min(stops) - 1, 6)], lambda x: length(x) BETWEEN 7 AND 199) AS good FROM s)
SELECT page_id, CASE WHEN len(ls) = 0 THEN stem WHEN len(good) > 0 THEN {S.strip("array_to_string(good[1:2], ' ')")} ELSE ls[1] END AS title FROM c""",
    "front_year": _FRONT + "SELECT page_id, CAST(coalesce(nullif(regexp_extract(subject, '(?:19|20)\\d{2}'), ''), nullif(regexp_extract(array_to_string(ls[1:15], chr(10)), '(?:19|20)\\d{2}'), ''), nullif(regexp_extract(stem, '(?:19|20)\\d{2}'), '')) AS INT) AS year FROM f",
    "front_venue": _FRONT + f"SELECT page_id, coalesce(nullif(subject, ''), list_filter(ls[1:12], lambda x: {S.has_any('lower(x)', ('journal', 'conference', 'proceedings', 'transactions'))})[1]) AS venue FROM f",
    "front_authors": _FRONT + f""", h AS (SELECT page_id, ls[2:5] AS lead, list_filter(range(1, least(len(ls[2:5]), 4) + 1), lambda i: contains(lower(ls[2:5][i]), 'abstract')) AS stops FROM f),
g AS (SELECT page_id, list_filter(lead[1 : coalesce(list_min(stops) - 1, 4)], lambda x: contains(x, ',') OR contains(lower(x), ' and '))[1] AS line FROM h)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(coalesce(line, ''), ' and ', ','), ','), lambda x: {S.strip('x')}), lambda x: x <> ''), '|') AS authors FROM g""",
    "author_split": f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), ' and ', ','), ','), lambda x: {S.strip('x')}), lambda x: x <> ''), '|') AS authors FROM documents",
    "citation_long": f"SELECT doc_id AS chunk_id, '[' || {_AUTHORS} || ', ' || {_YEAR} || ', ' || {_PGS} || ']' AS citation, '[' || {_AUTHORS} || ', ' || {_YEAR} || ']' AS short_citation FROM documents",
    "citation_author_year": f"SELECT doc_id AS chunk_id, '[' || {_AUTHORS} || ', ' || {_YEAR} || ']' AS citation, '[' || {_AUTHORS} || ', ' || {_YEAR} || ']' AS short_citation FROM documents",
    "citation_title": f"SELECT doc_id AS chunk_id, '[Paper ' || doc_id || ', ' || {_PGS} || ']' AS citation, '[Paper ' || doc_id || ', p. ' || (doc_id % 9 + 1) || ']' AS short_citation FROM documents",
}
