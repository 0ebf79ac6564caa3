"""The engine end to end over plain-text papers, and its incremental ingest."""

import json

import pytest
from pyspark.sql import functions as F

from citelume.api import Engine
from citelume.config import Settings, env_value, load_settings
from citelume.plans.requests import Request
from citelume.sources.pages import text_pages

PAPER = (
    "Porosity Control in Arc Deposits\nAnna Smith, Paul Jones\nAbstract\nThis paper presents porosity mitigation in WAAM of aluminum parts.\n\n1 Introduction\nPorosity is caused by gas entrapment in aluminum.\f"
    "2 Results and Discussion\nResults show that stable shielding gas and lower heat input reduced porosity in WAAM aluminum.\n\n2.1 Mitigation Guidance\nWe recommend argon shielding gas to reduce porosity when travel speed is too high."
)


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "paper_2021.txt").write_text(PAPER)
    settings = Settings(chunk_size_tokens=50, chunk_overlap_tokens=10, top_k=5, dense_top_k=8, sparse_top_k=8, retrieve_candidates=8, storage_dir=str(tmp_path / "store"))
    return Engine(spark, settings, parsers=(text_pages,)), str(tmp_path / "in")


def test_ingest_query_context(engine, tmp_path):
    e, folder = engine
    assert [(r.status, r.chunks > 0) for r in e.ingest(folder, pattern="*.txt").collect()] == [("ingested", True)]
    assert [r.status for r in e.ingest(folder, pattern="*.txt").collect()] == ["skipped"]
    (tmp_path / "in" / "paper_2021.txt").write_text(PAPER + "\nMore text follows here.")
    assert [r.status for r in e.ingest(folder, pattern="*.txt").collect()] == ["updated"]
    health = e.health()
    assert health["documents"] == 1 and health["chunks"] >= 1
    doc = e.list_documents().first()
    assert doc.year == 2021 and doc.authors == ["Anna Smith", "Paul Jones"]
    assert e.get_document(doc.doc_id)[1].count() == health["chunks"]
    with pytest.raises(KeyError):
        e.get_document("none")
    answer, pack = e.retrieve_context([Request(1, defect_name="pores", process_parameters={"current_A": 100, "shielding_gas": "argon"}), Request(2, question="how is porosity reduced"), Request(3, defect_name="unheard of"), Request(4, defect_name="porosity", enable_rerank=True)])
    rows = answer.results.orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {1, 2, 4}
    first = rows[0]
    assert "porosity" in first.defect_terms and first.citation.startswith("[Smith et al., 2021, p")
    assert answer.evidence.filter("query_id = 1 and strategy is not null").count() >= 1
    assert answer.themes.count() >= 1 and answer.hints.filter("query_id = 1").first().hints
    assert pack.filter("query_id = 1").first().context_text.startswith("1. [Smith")
    assert {r.query_id: r.candidate_chunks_considered for r in answer.diagnostics.collect()}[3] == 0
    assert answer.summaries[2] == "Free-text literature retrieval query."
    assert e.reindex()["documents"] == 1
    sent = []
    e.forward = sent.extend
    e.query(Request(1, question="porosity"))
    assert json.loads(sent[0])["rank"] == 1


def test_failures(engine, spark, tmp_path):
    e, folder = engine
    (tmp_path / "in" / "bad.pdf").write_bytes(b"not a pdf")
    bad = Engine(spark, e.settings, parsers=(lambda path, content: 1 / 0,))
    row = bad.ingest(folder).first()
    assert row.status == "failed" and "division" in row.error
    with pytest.raises(ValueError):
        e.ingest(folder, pattern="*.none")
    with pytest.raises(ValueError):
        e.ingest(str(tmp_path / "nowhere"))


def test_model_vectors(engine):
    e, folder = engine
    e.embed = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    e.ingest(folder, pattern="*.txt")
    assert all(len(r.embedding) == 2 for r in e.catalog.read("chunks").select("embedding").collect())
    assert e.reindex()["chunks"] >= 1


def test_stored_vectors_are_searched(engine, spark, tmp_path):
    e, folder = engine
    (tmp_path / "in" / "other_2020.txt").write_text("Another Long Title\nAnna Smith, Paul Jones\nAbstract\nSpatter is due to the arc. Nothing else is told of it here.")
    e.embed = lambda: lambda texts: [[float("spatter" in t.lower()), float("porosity" in t.lower()), 0.01] for t in texts]
    e.ingest(folder, pattern="*.txt")
    rows = e.query([Request(1, question="spatter"), Request(2, question="porosity")]).results.orderBy("query_id", "rank").collect()
    first = {r.query_id: r for r in reversed(rows)}
    assert "Spatter" in first[1].text and "orosity" in first[2].text
    e.embed = lambda: lambda texts: [[1.0] for _ in texts]
    with pytest.raises(Exception, match="length"):
        e.query(Request(1, question="spatter")).results.collect()


def test_model_reranks_and_stages_are_timed(engine, spark):
    e, folder = engine
    e.ingest(folder, pattern="*.txt")
    asked = Request(1, question="how is porosity reduced", enable_rerank=True)
    plain = [r.chunk_id for r in e.query(asked).results.orderBy("rank").collect()]
    e.reranker = lambda: lambda pairs: [-float(len(t)) for _, t in pairs]
    answer = e.query(asked, timed=True)
    rows = answer.results.orderBy("rank").collect()
    assert sorted(r.chunk_id for r in rows) == sorted(plain) and all(r.rerank_score is not None for r in rows)
    assert set(answer.timings_ms) == {"dense_search_ms", "sparse_search_ms", "fusion_ms", "rerank_ms", "total_ms"}
    with pytest.warns(UserWarning, match="doesn't load"):
        assert Engine(spark, e.settings, embed=lambda: 1 / 0, reranker=lambda: 1 / 0).embed is None


def test_upload_and_logs(engine):
    import io

    from citelume import logs

    e, _ = engine
    stream = io.StringIO()
    logs.configure(stream=stream)
    for _ in range(2):
        assert [r.status for r in e.upload([("paper_2022.txt", PAPER.encode())]).collect()] == ["ingested"]
    assert e.health()["documents"] == 2
    for bad in ([], [("../x.txt", b"x")], [("", b"x")]):
        with pytest.raises(ValueError):
            e.upload(bad)
    lines = [json.loads(line) for line in stream.getvalue().splitlines()]
    assert [x["message"] for x in lines] == ["ingest", "ingest"] and lines[0]["ingested_files"] == 1 and lines[0]["level"] == "INFO"


def test_http(engine):
    import threading
    import urllib.error
    import urllib.request

    from citelume.serving import server

    e, folder = engine
    served = server(e, port=0, suffix=".txt")
    threading.Thread(target=served.serve_forever, daemon=True).start()

    def call(path, body=None, kind="application/json"):
        data = body if body is None or isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{served.server_port}{path}", data, {"Content-Type": kind})) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as err:
            return err.code, json.load(err)

    try:
        assert call("/ingest", {})[0] == call("/ingest", {"folder_path": folder + "/none"})[0] == call("/query", b"{")[0] == call("/query", {"what": 1})[0] == 400
        assert call("/documents/none")[0] == call("/nowhere")[0] == 404
        status, said = call("/ingest", {"folder_path": folder})
        assert status == 200 and said["ingested_files"] == 1 and said["files"][0]["status"] == "ingested"
        form = b"--x\r\nContent-Disposition: form-data; name=\"files\"; filename=\"more_2020.%s\"\r\n\r\n" + PAPER.encode() + b"\r\n--x\r\nContent-Disposition: form-data; name=\"force\"\r\n\r\ntrue\r\n--x--\r\n"
        assert call("/ingest", form % b"pdf", "multipart/form-data; boundary=x")[0] == 400
        assert call("/ingest", form % b"txt", "multipart/form-data; boundary=x")[1]["ingested_files"] == 1
        documents = call("/documents")[1]
        assert len(documents) == 2 == call("/health")[1]["documents"] and call("/documents/" + documents[0]["doc_id"])[1]["chunks"]
        status, said = call("/retrieve-context", {"question": "how is porosity reduced", "top_k": 2, "filters": {"year_min": 2021}})
        assert status == 200 and said["results"][0]["year"] == 2021 and said["context_text"].startswith("1. [Smith") and "total_ms" in said["timings_ms"] and said["evidence"]
        assert call("/reindex", {})[1]["documents"] == 2
    finally:
        served.shutdown()


def test_upsert_touches_only_its_partitions(engine, spark):
    e, _ = engine
    e.upload([(f"paper_{i}.txt", PAPER.encode()) for i in range(6)])
    before = e.catalog._current()
    one = e.catalog.read("documents").orderBy("source_file").first()
    pages = spark.createDataFrame([(one.source_file, "new", 1, "A Title of Some Length\nAbstract\nNew words on porosity.")], "source_file string, checksum string, page_number int, text string")
    assert [r.status for r in e.ingest_pages(pages).collect()] == ["updated"]
    after = e.catalog._current()
    assert sum(before["documents"][k] != v for k, v in after["documents"].items()) == 1 == sum(before["chunks"][k] != v for k, v in after["chunks"].items())
    assert e.health()["documents"] == 6 and e.catalog.read("documents").filter("checksum = 'new'").count() == 1
    assert e.catalog.read("chunks").filter(F.col("source_file") == one.source_file).count() == 1


def test_settings(tmp_path):
    assert [env_value(x) for x in ("true", "null", "a, b", "[1, 2]", "3", "0.5", "x")] == [True, None, ["a", "b"], [1, 2], 3, 0.5, "x"]
    (tmp_path / "s.json").write_text('{"top_k": 3, "section_boosts": {"results": 0.5}}')
    s = load_settings(str(tmp_path / "s.json"), {"CITELUME_TOP_K": "4", "OTHER": "1"})
    assert s.top_k == 4 and s.section_boosts == (("results", 0.5),)
    (tmp_path / "s.json").write_text('{"nothing": 3}')
    with pytest.raises(ValueError):
        load_settings(str(tmp_path / "s.json"), {})


def test_streaming(engine, spark, tmp_path):
    from citelume.streaming.ingest import arrivals, ingest_stream, into, page_stream

    e, _ = engine
    schema = "source_file string, checksum string, page_number int, text string, arrived timestamp"
    for k, name in enumerate(("a.txt", "b.txt")):
        spark.createDataFrame([(name, "x", i + 1, t, None) for i, t in enumerate(PAPER.split("\f"))], schema).write.mode("append").parquet(str(tmp_path / "pages"))
        ingest_stream(page_stream(spark, str(tmp_path / "pages")), str(tmp_path / "cp"), into(e)).awaitTermination()
        assert e.health()["documents"] == k + 1
    state = e.catalog._current()
    ingest_stream(page_stream(spark, str(tmp_path / "pages")), str(tmp_path / "other"), into(e)).awaitTermination()  # all of it again
    assert e.catalog._current()["documents"] == state["documents"] and e.health()["documents"] == 2
    rows = [(f"{n}.txt", "x", 1, "t", f"2024-01-01 00:{m:02d}:00") for n, m in (("a", 1), ("a", 2), ("b", 3), ("c", 7), ("d", 50))]
    frame = spark.createDataFrame(rows, "source_file string, checksum string, page_number int, text string, arrived string")
    frame.selectExpr("source_file", "checksum", "page_number", "text", "cast(arrived as timestamp) arrived").write.parquet(str(tmp_path / "timed"))
    out = arrivals(page_stream(spark, str(tmp_path / "timed"))).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start()
    out.awaitTermination()
    assert {(r.window.start.minute, r.pages, r.files) for r in spark.table("arrived").collect()} == {(0, 3, 2), (5, 1, 1), (50, 1, 1)}
