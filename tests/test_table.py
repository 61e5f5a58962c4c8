"""Anchors, validation, the evidence table, files and backends."""

import base64
import json
import os
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

from evigrain import cli
from evigrain.operators import table
from evigrain.operators.packed import NameGuard, split_array, split_packed
from evigrain.operators.provenance import page_of, source_link, with_pdf
from evigrain.operators.retrieve import contexts, gate, per_file, score, top
from evigrain.operators.segment import segment
from evigrain.operators.validate import with_support
from evigrain.plans.atlas import ask, build
from evigrain.schemas import EVIDENCE_COLUMNS, MISSING, PAGE
from evigrain.sources import backends, pages, tables

TEXT = "Among 120 patients enrolled at ICU admission, lactate predicted 28-day mortality by logistic regression (AUC 0.85; OR 1.42 (1.1-1.8), p < 0.05). Nothing else was seen."
QUESTION = "Does lactate predict mortality?"


def evidence(spark, **changes):
    row = dict.fromkeys(EVIDENCE_COLUMNS[:-1], MISSING) | {"study_name": "s", "source_file": "s.pdf", "source_anchor": "Lactate 4.2 and mortality at day 28."} | changes
    return spark.createDataFrame([(*row.values(), 1.0)], ", ".join(f"{c} string" for c in row) + ", query_relevance_score double")


def page_rows(spark, *texts):
    return spark.createDataFrame([(f"f{i}.pdf", f"/a/f{i}.pdf", 1, "1", 1, None, 0, "pdf_text", "off", None, t) for i, t in enumerate(texts)], PAGE)


@pytest.mark.parametrize(
    ("changes", "status"),
    [
        ({"source_anchor": ""}, "unsupported"),
        ({}, "needs review"),
        ({"predictor": "lactate", "outcome": "mortality day 28"}, "supported"),
        ({"predictor": "lactate", "method": "random forest"}, "partial"),
        ({"method": "random forest"}, "needs review"),
        ({"method": "random forest", "field_sources_json": '{"method": "a random forest was grown"}'}, "supported"),
        ({"method": "random forest", "field_sources_json": "{broken"}, "needs review"),
        ({"method": "random forest", "field_sources_json": "[1]"}, "needs review"),
    ],
)
def test_support(spark, changes, status):
    assert with_support(evidence(spark, **changes)).first().support_status == status


def test_pages_and_links(spark):
    df = spark.createDataFrame([(x,) for x in ("3.7", "0", "nan", "Not reported", "inf", None)], "p string")
    assert [r[0] for r in df.select(page_of(F.col("p"))).collect()] == [3, 0, None, None, None, None]
    links = df.select(source_link(F.lit("file:/x/a b*~+é.pdf"), F.col("p")), source_link(F.lit(""), F.col("p")), source_link(F.lit("s3://x/a.pdf"), F.lit("2")), source_link(F.lit("a.pdf"), F.lit(None).cast("string"))).collect()
    assert links[0][0] == "file:///x/a%20b%2A~%2B%C3%A9.pdf#page=3" and links[1][0] == "file:///x/a%20b%2A~%2B%C3%A9.pdf"
    assert links[0][1] == MISSING and links[0][2] == "s3://x/a.pdf#page=2" and links[0][3] == f"file://{os.getcwd()}/a.pdf"


def test_the_file_of_a_row(spark):
    files = spark.createDataFrame([("/k/articles/a.pdf",), ("file:/k/articles/b c+.pdf",), ("/k/articles/s.pdf",), ("/z/q.pdf",), ("/k/articles/a.pdf",)], "path string")
    rows = [
        (1, "file:///k/articles/b%20c+.pdf#page=3", "a.pdf", "s"), (2, "file:///gone.pdf", "a.pdf", "s"), (3, MISSING, "/z/q.pdf", None), (4, "", MISSING, "s"), (5, None, None, "s.pdf"),
        (6, "https://x.org/a.pdf", "gone.pdf", "t"), (7, None, None, None), (2, "file:///gone.pdf", "a.pdf", "s"), (8, "file:///bad%zz", "", MISSING),
    ]
    df = spark.createDataFrame(rows, "row_id int, source_link string, source_file string, study_name string")
    got = sorted(((r.row_id, r.pdf_path) for r in with_pdf(df, files, "/k/articles").collect()), key=lambda x: x[0])
    a, s = "/k/articles/a.pdf", "/k/articles/s.pdf"
    assert got == [(1, "/k/articles/b c+.pdf"), (2, a), (2, a), (3, "/z/q.pdf"), (4, s), (5, s), (6, None), (7, None), (8, None)]
    assert with_pdf(df.limit(0), files).count() == 0 and with_pdf(df, files.limit(0)).where("pdf_path is null").count() == 9


def test_repair_keeps_what_is_there(spark):
    old = evidence(spark, source_file=MISSING, source_page="4", source_passage_id=MISSING, source_link="https://x.org/a", study_name="s").unionByName(evidence(spark, source_file=MISSING, source_page=MISSING, source_passage_id="p", source_link="file:///gone.pdf", study_name="t"))
    files = spark.createDataFrame([("/k/t.pdf",)], "path string")
    s, t = table.repair(old, files, "/k").orderBy("study_name").collect()
    assert (s.source_file, s.source_page, s.source_passage_id, s.source_link) == ("s", "4", MISSING, "https://x.org/a")
    assert (t.source_file, t.source_page, t.source_passage_id) == ("t", MISSING, "p") and t.source_link.startswith("/app/static/source_pdfs/t-") and "#" not in t.source_link
    assert table.repair(old.where("study_name = 't'")).first().source_link == MISSING


def test_retrieval_is_capped_and_gated(spark):
    p = segment(page_rows(spark, TEXT, TEXT, "Nothing.", None, ""))
    scored = score(p, ["lactate", "mortality"])
    assert top(scored, 0).count() == 0 and top(scored, 5, 1).count() == 2 and top(scored, 5, 0).count() == 0
    ranked = per_file(scored, 8)
    assert gate(ranked, 3.0).count() == 2 and gate(ranked, 99.0).count() == 0
    assert contexts(ranked).count() == 2


def test_build_and_ask(spark):
    built = build(page_rows(spark, TEXT, TEXT.replace("120", "77"), "Weather."), QUESTION)
    rows = built.evidence.collect()
    assert [r.study_name for r in rows] == ["f0", "f1"]
    r = rows[0]
    assert (r.predictor, r.timing, r.performance) == ("Lactate", "at ICU admission", "AUC 0.85")
    assert r.effect_size == "OR 1.42 (1.1-1.8), p < 0.05" and r.support_status == "supported" and r.source_passage_id == "f0:p1:c1"
    assert json.loads(r.field_sources_json)["method"].startswith("Among 120")
    answer = ask(built.evidence, QUESTION, support_status=["supported"])
    assert answer.metrics.first().n_rows == 2 and answer.review.count() == 2
    assert ask(built.evidence, "").ranked.count() == 2
    assert build(page_rows(spark), QUESTION).evidence.count() == 0


def test_legacy_table_is_repaired(spark):
    old = spark.createDataFrame([("a.pdf", "lactate", "lactate rose")], "study_name string, predictor string, source_anchor string")
    r = table.repair(old).first()
    assert (r.source_file, r.source_page, r.source_passage_id, r.support_status) == ("a.pdf", "Not indexed", "Legacy CSV", "supported")
    assert table.repair(old.limit(0)).count() == 0


def test_unsupported_counts_as_supported(spark):
    assert table.sidebar_metrics(evidence(spark, support_status="unsupported")).first().n_supported == 1


def test_review_and_names(spark):
    ranked = table.rank(evidence(spark).unionByName(evidence(spark, predictor="x")), None)
    assert table.source_review(ranked).count() == 1
    name = spark.createDataFrame([("/a/b c é.PDF",)], "p string").select(table.static_name(F.col("p"))).first()[0]
    assert name.startswith("b_c_é-") and name.endswith(".PDF")
    groups = table.source_groups(evidence(spark, field_sources_json='{"outcome": "q", "method": "r", "timing": "q"}'), "study_name").orderBy("place").collect()
    assert [(g.source, g.fields) for g in groups] == [("q", "outcome, timing"), ("r", "method")]


def test_csv_and_audit_round_trip(spark, tmp_path):
    odd = evidence(spark, notes='{"a": "q \\"z\\" \n"}', outcome='x, "y"\nz', method="NA")
    tables.write_evidence(odd, str(tmp_path / "e"))
    r = tables.read_evidence(spark, str(tmp_path / "e")).first()
    assert r.notes == '{"a": "q \\"z\\" \n"}' and r.outcome == 'x, "y"\nz' and r.method is None and r.query_relevance_score == 1.0
    built = build(page_rows(spark, TEXT), QUESTION)
    tables.write_audit(built.ranked, str(tmp_path / "a"))
    assert tables.read_audit(spark, str(tmp_path / "a")).first().source_link == "file:///a/f0.pdf#page=1"


def test_backends(spark):
    studies = contexts(per_file(score(segment(page_rows(spark, TEXT, TEXT)), ["lactate"]), 8))
    answer = json.dumps({"rows": [{"predictor": "Lactate", "notes": None}, "junk"]})
    model = backends.Recorded({"f0": answer, "f1": '{"rows": 3}'})
    rows = {r.study_name: r for r in backends.extract_rows(studies, QUESTION, "llm", model).collect()}
    assert rows["f1"].notes.startswith("Regex") and rows[MISSING].notes == MISSING and rows[MISSING].source_file == "f0.pdf"
    with pytest.raises(ValueError):
        backends.extract_rows(studies, QUESTION, "other")
    assert backends.service({"OPENROUTER_API_KEY": " Your_OpenRouter_API_key", "OPENAI_API_KEY": "k"}).key == "k"
    assert backends.service({}) is None


class Answers(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, {k.lower(): v for k, v in self.headers.items()}, body))
        code, said = (402, "Insufficient credits") if body["model"] == "poor" else (200, json.dumps({"choices": [{"message": {"content": '{"rows": [{"predictor": "Lactate"}]}'}}]}))
        self.send_response(code)
        self.end_headers()
        self.wfile.write(said.encode())

    def log_message(self, *_):
        pass


def test_service_answers(spark, tmp_path, monkeypatch):
    server = HTTPServer(("127.0.0.1", 0), Answers)
    Thread(target=server.serve_forever, daemon=True).start()
    router = backends.service({"OPENROUTER_API_KEY": "k", "OPENROUTER_BASE_URL": f"http://127.0.0.1:{server.server_port}/v1/", "OPENROUTER_HTTP_REFERER": "r", "OPENAI_API_KEY": "o"})
    studies = contexts(per_file(score(segment(page_rows(spark, TEXT)), ["lactate"]), 8))
    assert backends.extract_rows(studies, QUESTION, "llm", backends.Chat("m", router)).first().predictor == "Lactate"
    path, headers, body = Answers.asked[0]
    assert path == "/v1/chat/completions" and headers["authorization"] == "Bearer k" and headers["http-referer"] == "r" and body["temperature"] == 0 and body["response_format"] == {"type": "json_object"}
    reader = pages.VisionReader("m", router, 72, lambda path, page, dpi: f"{path} {page} {dpi}".encode())
    assert reader("/a/f.pdf", 2).startswith("{") and base64.b64decode(Answers.asked[-1][2]["messages"][0]["content"][1]["image_url"]["url"].split(",")[1]) == b"/a/f.pdf 2 72"
    with pytest.raises(RuntimeError, match="402.*Insufficient") as failed:
        backends.Chat("poor", router)("p")
    assert pages.out_of_credits(str(failed.value))
    assert backends.service({"OPENAI_API_KEY": "o", "OPENAI_BASE_URL": "http://b"}).base_url == "http://b"
    server.shutdown()
    # Without a key: an error for llm, patterns for auto, tags on the pages that need vision.
    for name in ("OPENROUTER_API_KEY", "OPENAI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f0.pdf").write_bytes(TEXT.encode())
    args = ["--articles", str(tmp_path / "in"), "--output", str(tmp_path / "e"), "--evidence-jsonl", str(tmp_path / "a"), "--query", QUESTION]
    decode = lambda content: iter([pages.RawPage(1, "", content.decode(), 1, 1, "")])
    with pytest.raises(RuntimeError, match="usable"):
        cli.main(args, decode=decode)
    assert cli.main([*args, "--backend", "auto"], decode=decode) == 0
    assert tables.read_evidence(spark, str(tmp_path / "e")).first().notes.startswith("Regex")
    tagged = pages.read_pages(spark, str(tmp_path / "in"), decode, vision="auto", reader=pages.VisionReader("m", None))
    assert tagged.first().source_types == "pdf_text, vision_error"


def test_pages_with_vision(spark, tmp_path):
    (tmp_path / "B.pdf").write_bytes(b"one")
    (tmp_path / "a.pdf").write_bytes(b"two")
    (tmp_path / "c.txt").write_bytes(b"no")

    def decode(content):
        yield pages.RawPage(1, "i", content.decode() + " text", 0, 2, "")
        yield pages.RawPage(2, "ii", "", 1, 2, "")

    def reader(path, page):
        if path.endswith("B.pdf"):
            raise RuntimeError("Error 402: Insufficient credits")
        return "seen" if page == 2 else MISSING

    got = {(r.file_name, r.page_number): (r.text, r.source_types) for r in pages.read_pages(spark, str(tmp_path), decode, vision="all", reader=reader).collect()}
    assert got["a.pdf", 2] == (pages.VISION_HEADER + "\nseen", "openrouter_vision") and got["a.pdf", 1] == ("two text", "pdf_text")
    assert got["B.pdf", 1] == ("one text", "pdf_text, vision_error") and ("B.pdf", 2) not in got
    models = {(r.file_name, r.page_number): (r.page_label, r.vision_model) for r in pages.read_pages(spark, str(tmp_path), decode, vision="all", reader=reader, model="m").collect()}
    assert models == {("a.pdf", 1): ("1", ""), ("a.pdf", 2): ("2", "m"), ("B.pdf", 1): ("1", "")}
    assert pages.read_pages(spark, str(tmp_path / "none"), decode).count() == 0
    assert pages.read_pages(spark, str(tmp_path), decode, max_pages=1).count() == 2
    with pytest.raises(ValueError):
        pages.wants_vision("some", F.lit(""), F.lit(0))


CASES = [
    (None, []), ("", []), ("  ", []), ("Albumin", ["Albumin"]), ("; a;; b ;", ["a", "b"]), ("A, B and C & D", ["A", "B", "C", "D"]),
    ('"a, ""b""", c', ['a, "b"', "c"]), ('["a", "b; c"]', ["a", "b; c"]), ("• a • b, c", ["a", "b, c"]), ("1) a 2) b", ["a", "b"]), ("(1) a; (2) b", ["a", "b"]),
    ("- a\n- b-c", ["a", "b-c"]), ("Bilirubin, total; x", ["Bilirubin, total", "x"]), ("HR 1,17 (1,02–1,72), p = 0.02; OR 2 [1; 3]", ["HR 1,17 (1,02–1,72), p = 0.02", "OR 2 [1; 3]"]),
    ("'a; b' | c", ["a; b", "c"]), ("a；b、c », d » e", ["a", "b", "c »", "d", "e"]), ('a " b; c', ['a " b', "c"]), ("a; a", ["a", "a"]), ("x" * 5000 + ";y", ["x" * 5000, "y"]),
]


@pytest.mark.parametrize(("value", "out"), CASES[:15] + CASES[16:])
def test_packed_values(value, out):
    import pyarrow as pa

    assert split_array(pa.array(["k; l", value, None], pa.string()), True, NameGuard(["Bilirubin, total"])).to_pylist() == [["k", "l"], out, []]


def test_packed_rows(spark):
    df = spark.createDataFrame([(1, "a;b", None, 7), (1, "a;b", None, 8), (2, None, "x", 9)], "row_id long, predictor string, method string, item_no int")
    got = sorted(map(tuple, split_packed(df, "row_id", ["predictor", "method"]).collect()))
    assert got == [(1, "predictor", 1, 2, "a"), (1, "predictor", 2, 2, "b"), (2, "method", 1, 1, "x")]
    assert split_packed(df.limit(0), "row_id", ["predictor", "method"]).count() == 0
