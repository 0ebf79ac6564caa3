"""Operators against literal cases and small plain-Python models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from citelume.functions import text as T
from citelume.lexicon import SCIENTIFIC
from citelume.config import Settings
from citelume.operators import bm25, chunking, citations, cleaning, enrichment, evidence, frontmatter, fusion, quality, structure, vectors
from citelume.plans import catalog, requests, retrieval
from citelume.plans.requests import Filters, Request


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("x")).first().x


def test_text_primitives(spark):
    assert one(spark, " a\t b \n\n\n\nc​ ", T.normalized) == "a b \n\nc"
    assert one(spark, "Ti-6Al-4V (WAAM): 5.2", T.matchable) == "ti-6al-4v waam 5 2"
    assert one(spark, "Porosity. in WAAM 3.5/4", T.lexical_tokens) == ["porosity.", "in", "waam", "3.5/4"]
    assert one(spark, "One two. Three! 4 five? six", T.sentences) == ["One two.", "Three!", "4 five? six"]
    assert one(spark, "  ", T.sentences) == [""]
    assert one(spark, "x" * 300, T.truncated) == "x" * 237 + "..."


def test_cleaning(spark):
    pages = spark.createDataFrame([("d", 1, "Journal of Tests\n1\nStable gas fre-\nquently helps in the\nprocess of parts."), ("d", 2, "Journal of Tests\nPage 2\nmore text here follows, and\nit goes on.")], "doc_id string, page_number int, text string")
    marks = cleaning.repeated_marginals(pages).collect()
    assert [(m.line, m.is_header, m.is_footer) for m in marks] == [("Journal of Tests", True, False)]
    texts = [r.text for r in cleaning.clean_pages(pages).orderBy("page_number").collect()]
    # a wrapped first line passes for a heading
    assert texts == ["Stable gas frequently helps in the\n\nprocess of parts.", "more text here follows, and it goes on."]


def test_page_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ("12", "page 3", "iv", "mix", "abc", "12345")], "x string").select("x", cleaning.is_page_number(F.col("x")).alias("y")).collect()
    assert {r.x for r in rows if r.y} == {"12", "page 3", "iv", "mix"}


def test_merge_matches_a_fold(spark):
    rng = random.Random(3)
    cases = ["\n".join(rng.choice(["ab", "cd-", "-", "x y z.", ""]) for _ in range(rng.randrange(8))) for _ in range(200)]

    def fold(text):
        text, out, run = re.sub(r"(\w)-\n(\w)", r"\1\2", text), [], ""
        for line in [*text.split("\n"), ""]:
            if not line:
                out, run = out + [run] * bool(run), ""
            else:
                run = line if not run else run[:-1] + line if run.endswith("-") else f"{run} {line}"
        return [p for p in out if p.strip()]

    frame = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    got = {r.i: r.p for r in frame.select("i", cleaning.page_paragraphs(F.col("text"), F.array().cast("array<string>")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [fold(c) for c in cases]


def test_sections(spark):
    pages = spark.createDataFrame([("d", 1, "intro text here.\n\n1 Introduction\n\nbody one here.\n\n1.1 Scope\n\nbody two here."), ("d", 2, "body three here.\n\n2 Results\n\nbody four here.\n\nReferences\n\nbody five here.")], "doc_id string, page_number int, text string")
    got = [(r.text, r.section, r.subsection, r.excluded) for r in structure.blocks(pages).filter("not is_heading").orderBy("page_number", "pos").collect()]
    assert got == [("intro text here.", "Front Matter", None, False), ("body one here.", "1 Introduction", None, False), ("body two here.", "1 Introduction", "1.1 Scope", False), ("body three here.", "1 Introduction", "1.1 Scope", False), ("body four here.", "2 Results", None, False), ("body five here.", "References", None, True)]


def _model_chunks(blocks, budget, overlap):
    """A plain fold over (section, text) in order."""
    out, run, n, key = [], [], 0, None
    for section, text in blocks:
        t = len(re.findall(r"[A-Za-z0-9][A-Za-z0-9\-+./]*", text))
        if run and (section != key or n + t > budget):
            out.append(run)
            if section == key:
                kept, total = [], 0
                for item in reversed(run):
                    kept.insert(0, item)
                    total += item[1]
                    if total >= overlap:
                        break
                run = kept
            else:
                run = []
            n = sum(x[1] for x in run)
        run = [*run, (text, t)]
        n, key = n + t, section
    return ["\n\n".join(x[0] for x in r) for r in ([*out, run] if run else out)]


def test_chunks_match_a_fold(spark):
    rng = random.Random(5)
    docs = {d: [(rng.choice("ab"), " ".join(rng.choice(["x", "yy", "z1"]) for _ in range(rng.randrange(1, 9)))) for _ in range(rng.randrange(1, 12))] for d in range(40)}
    rows = [(d, 1, i, s, None, t, False, False) for d, bs in docs.items() for i, (s, t) in enumerate(bs)]
    frame = spark.createDataFrame(rows, "doc_id int, page_number int, pos int, section string, subsection string, text string, is_heading boolean, excluded boolean")
    got = {}
    for r in chunking.pack(frame, Settings(chunk_size_tokens=12, chunk_overlap_tokens=4)).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {d: _model_chunks(bs, 12, 4) for d, bs in docs.items()}


def test_long_block_splits_by_sentence(spark):
    assert one(spark, "A b c. D e f. G h i. J k.", lambda c: chunking.fragments(c, 6)) == ["A b c. D e f.", "G h i. J k."]


def test_reference_quality(spark):
    heavy = "Smith et al. 2019; Jones et al. 2020; doi 10.1/x; https://doi.org/10.1/x Brown et al., 2018; doi 10.2/y"
    prose = "The experiments results show that porosity can be reduced because the gas is stable."
    rows = spark.createDataFrame([(1, heavy, None, None), (2, prose, None, None), (3, prose + "\n\nReferences\n\n[1] Smith 2019; doi", None, None), (4, None, None, None)], "chunk_id int, text string, section string, subsection string")
    got = {r.chunk_id: r for r in quality.scored_chunks(rows).collect()}
    assert got[1].is_reference_heavy and got[1].reference_contamination_score >= 0.72
    assert got[2].reference_contamination_score < 0.4 and not got[2].is_reference_heavy
    assert got[3].reference_tail_trimmed and got[3].text == prose
    assert got[4].text == ""


def test_enrichment(spark):
    text = "WAAM of aluminum: shielding gas and heat input avoid porosity. Mitigation guidance reduces pores."
    row = enrichment.enriched_chunks(quality.scored_chunks(spark.createDataFrame([(1, text, None, None)], "chunk_id int, text string, section string, subsection string"))).first()
    assert row.defect_terms == ["porosity"] and row.materials == ["aluminum"] and "waam" in row.process_types
    assert set(row.process_parameters) == {"shielding_gas", "heat_input"} and "mitigation" in row.evidence_types
    assert "gtaw" in row.process_types  # "tig" stands in "mitigation"
    strict = enrichment.labels(T.matchable(F.lit(text)), SCIENTIFIC.with_mode("word_boundary").patterns(SCIENTIFIC.with_mode("word_boundary").processes))
    assert spark.range(1).select(strict.alias("x")).first().x == ["waam"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Higher current increases porosity risk.", "increase_risk_when_high"), ("Too low shielding flow may cause pores.", "increase_risk_when_low"), ("Speed both too high and too low is harmful.", "non_monotonic"), ("An optimal window exists for voltage.", "optimal_window"), ("Nothing is said.", "unclear")],
)
def test_directionality(spark, text, expected):
    assert one(spark, text, evidence.directionality) == expected


def test_citations(spark):
    row = spark.createDataFrame([("A title", "/x/y.pdf", ["Ann Smith", "Bo Li"], 2022, [5, 4], 4), (None, "/x/y.pdf", [], None, [], 4), ("T", "/x/y.pdf", [""], 0, [3], 3)], "title string, source_file string, authors array<string>, year int, page_numbers array<int>, start_page int")
    got = [tuple(r) for r in row.select(citations.citation(), citations.short_citation(), citations.citation("title_pages")).collect()]
    assert got == [("[Smith et al., 2022, pp. 4-5]", "[Smith et al., 2022]", "[A title, pp. 4-5]"), ("[/x/y.pdf, p. ?]", "[Untitled paper]", "[y.pdf, p. ?]"), ("[T, p. 3]", "[T]", "[T, p. 3]")]


def test_front_matter(spark):
    rows = spark.createDataFrame([("A Great Study\nAlice Smith, Bob Jones\nAbstract\nx", {}, "file_2019"), ("", {"title": "Given"}, "s"), ("a long lower title\nAbstract", {"creationdate": "D:2015", "producer": "Writer"}, "s")], "first_page string, raw_metadata map<string,string>, stem string")
    got = [(r.title, r.authors, r.year, r.venue) for r in frontmatter.front_matter(rows).collect()]
    assert got == [("A Great Study", ["Alice Smith", "Bob Jones"], 2019, None), ("Given", [], None, None), ("a long lower title", [], 2015, "Writer")]


def test_requests(spark):
    legacy = {"current_A": 5, "voltage": 3, "odd": 1}
    batch = [
        Request(1, process_parameters=legacy), Request(2, process_parameters={"voltage_V": 9, "odd": 1, "voltage": 3, "current": 5, "travel_speed": None}), Request(3, "Gas Porosity", "why?", {}),
        Request(4, question=" q "), Request(5, "new thing", filters=Filters(materials=("zinc",))), Request(6, "Pores", "in TIG steel?", {"shielding_gas": "argon", "extra": {"layers": 4}}, query_expansion=False, top_k=3),
        Request(7), Request(8, "", "", None), Request(9, defect_name="crack", filters=Filters(defect_terms=("pores",)), enable_rerank=True),
    ]
    got = {r.query_id: r for r in requests.frames(spark, batch)[0].collect()}
    assert got[1].parameter_values == got[2].parameter_values == {"current_A": "5", "voltage_V": "3", "odd": "1"} and got[1].parameter_categories == ["current", "voltage", "odd"] == got[2].parameter_categories
    assert got[3].mode == "combined" and got[3].defect_name == "porosity" and got[3].f_defects == ["porosity"] and len(got[3].intents) == 5 and got[3].expanded_terms[0] == "porosity" and len(got[3].expanded_terms) == 5
    assert [tuple(i) for i in got[4].intents] == [("free_text", "q")] and got[4].summary == "Free-text literature retrieval query."
    assert got[5].q_materials == ["zinc"] and got[5].defect_name == "new thing" and got[5].summary == "Defect-only retrieval for new thing."
    six = got[6]
    assert six.expanded_terms == ["porosity"] and six.parameter_categories == ["shielding_gas", "layers"] and six.fragments == ["shielding gas", "layers", "argon"] and six.q_process_types == ["gtaw"] and six.q_materials == ["steel"] and six.q_top_k == 3
    assert dict(map(tuple, six.intents))["defect_mechanism"] == "porosity gtaw steel pore formation gas entrapment heat input shielding gas mechanism cause"
    assert got[7].mode == got[8].mode == "defect_only" and got[7].summary == "Defect-only retrieval for unspecified defect." and got[7].defect_name is None and len(got[7].intents) == 4
    assert got[9].f_defects == ["pores"] and got[9].rerank and got[9].q_top_k == 8 and got[9].lexical_query.endswith("quality control")


def test_bm25_counts_all_chunks(spark):
    chunks = spark.createDataFrame([(1, "pores in steel"), (2, "cracks in steel plates"), (3, None)], "chunk_id int, text string")
    q = spark.createDataFrame([(1, "a", "steel pores pores")], "query_id int, intent string, text string")
    got = bm25.top(bm25.scores(chunks, q), 5).collect()
    assert [r.chunk_id for r in got] == [1, 2] and got[0].score > got[1].score
    only = bm25.scores(chunks, q, chunks.filter("chunk_id = 2")).collect()
    assert [r.score for r in only] == [got[1].score]


def test_best_is_the_top_of_all_scores(spark, monkeypatch):
    rng = random.Random(4)
    words = "pores gas arc weld steel crack heat wire feed speed".split()
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.choices(words, k=rng.randrange(0, 12))) or None, [q for q in (1, 2, 7) if rng.random() < 0.6]) for i in range(200)], "chunk_id string, text string, passes array<bigint>")
    queries = spark.createDataFrame([(1, "a", "gas pores pores"), (1, "b", "steel arc weld"), (2, "a", "none known"), (2, "c", ""), (7, "a", "heat wire feed")], "query_id bigint, intent string, text string")
    allowed = chunks.select(F.explode("passes").alias("query_id"), "chunk_id")
    for best, scores in ((lambda c, k: bm25.best(chunks, queries, k, c), lambda c: bm25.scores(chunks, queries, c)), (lambda c, k: vectors.hashed_best(chunks.drop("passes") if c is None else c, queries, k), lambda c: vectors.hashed_scores(chunks, queries, c))):
        for among, some in ((None, None), (chunks, allowed)):
            want = sorted(map(tuple, bm25.top(scores(some), 7).select("query_id", "intent", "chunk_id", "score", "rank").collect()))
            assert sorted(map(tuple, best(among, 7).select("query_id", "intent", "chunk_id", "score", "rank").collect())) == want and len(want) > 20
    monkeypatch.setattr(bm25, "SMALL", 1)
    monkeypatch.setattr(bm25.few, "__defaults__", (1,))
    monkeypatch.setattr(bm25.small, "__defaults__", (1,))
    assert len(bm25.best(chunks, queries, 3, chunks).collect()) == len(bm25.top(bm25.scores(chunks, queries, allowed), 3).collect())
    assert bm25.best(chunks.limit(0), queries, 3).count() == 0


def test_filters_are_judged_in_the_row(spark):
    chunks = spark.createDataFrame([("a", 2001, "s1", ["waam"], ["steel"], ["pores"], False, "x"), ("b", None, "s2", [], None, [], True, "y"), ("c", 2010, None, ["tig"], ["steel"], [], False, "z")], "chunk_id string, year int, source_file string, process_types array<string>, materials array<string>, defect_terms array<string>, is_reference_heavy boolean, text string")
    batch = [Request(1), Request(2, question="q", filters=Filters(year_min=2001, year_max=2005)), Request(3, filters=Filters(source_files=("s2", "s1"))), Request(4, filters=Filters(materials=("steel",), process_types=("tig", "mig"))), Request(5, filters=Filters(defect_terms=("cracks",)))]
    bundles = requests.frames(spark, batch)[0]
    got = {(r.query_id, r.chunk_id) for r in retrieval.passing(chunks, bundles).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "a"), (3, "b"), (4, "c")}


def test_rrf_and_min_max(spark):
    ranks = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 2, 0.2)], "query_id int, chunk_id int, rank int, score double")
    got = {r.chunk_id: r for r in fusion.reciprocal_rank(ranks, ranks.filter("chunk_id = 11").withColumn("rank", F.lit(1)).withColumn("score", F.lit(7.0))).collect()}
    assert abs(got[11].rrf - (1 / 62 + 1 / 61)) < 1e-9 and got[10].sparse_score == 0.0
    scaled = [r.x for r in ranks.select(fusion.min_max("score").alias("x")).collect()]
    assert sorted(scaled) == [0.0, 1.0]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None)], "id int, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 1.0]), (8, [0.0, 1.0])], "query_id int, vector array<float>")
    for block in (8, 1 << 20):
        got = [(r.query_id, r.id, r.score) for r in vectors.dense_top(rows, q, 2, block).orderBy("query_id", "rank").collect()]
        assert got == [(8, 2, 1.0), (8, 1, 0.0), (9, 1, 0.707106781), (9, 2, 0.707106781)]
    h = vectors.hashed(spark.createDataFrame([(1, "one two one"), (2, ""), (3, None)], "chunk_id int, text string"), ["chunk_id"]).collect()
    assert {r.chunk_id for r in h} == {1} and abs(sum(r.w**2 for r in h) - 1) < 1e-9


def test_catalog(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source_file string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "source_file string, n int")
    assert sorted(map(tuple, catalog.upserted(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    store = catalog.Catalog(spark, str(tmp_path / "s"))
    assert store.counts() == (0, 0)


def test_rerankers(spark):
    rows = spark.createDataFrame([(1, 1, "gas flow", 0.5, 1.0, "gas flow", 3.0), (1, 2, "else", 0.6, 0.0, "gas flow", 1.0)], "query_id int, chunk_id int, text string, score double, direct_defect_match double, lexical_query string, model double")
    heuristic = {r.chunk_id: r.score for r in fusion.heuristic_rerank(rows).collect()}
    assert heuristic == {1: round(0.5 * 0.82 + 0.12 + 0.08, 9), 2: round(0.6 * 0.82, 9)}
    model = {r.chunk_id: r.score for r in fusion.model_rerank(rows, "model").collect()}
    assert model == {1: round(0.5 * 0.35 + 0.65, 9), 2: round(0.6 * 0.35, 9)}


def test_parser_fallback(spark, tmp_path):
    from citelume.sources.pages import files, page_rows, parsed, text_pages

    def broken(path, content):
        raise ValueError("bad file")

    def empty(path, content):
        return [], {}

    (tmp_path / "a.txt").write_text("one\ftwo")
    found = files(spark, str(tmp_path), "*.txt")
    row = parsed(found, (broken, empty, text_pages))
    assert [(r.page_number, r.text) for r in page_rows(row).orderBy("page_number").collect()] == [(1, "one"), (2, "two")]
    assert parsed(found, (broken, empty)).first().error == "broken: bad file; empty: no pages"
