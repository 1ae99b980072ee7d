import datetime
import json
import os

import pytest
from pyspark.sql import functions as F
from test_forms_streaming_queries import sheet_rows

from tessella import cli, config
from tessella.functions.prompts import EXTRACT, Prompt
from tessella.operators import chunking, forms
from tessella.operators.provider import ProviderError, map_fitting, rule_provider
from tessella.plans import extraction, routing
from tessella.sources.reader import oversized_files, parse_files


def make_rule():
    def rule(message):
        chunk = message.split("\nPart: ", 1)[1].split("\n", 1)[0]
        text = message.split("\n---\n", 1)[1]
        if "refuse" in text:
            return {"chunk_id": "other", "variables": []}
        questions = [line for line in text.split("\n") if line.endswith("?")]
        base = {"data_type": "text", "extraction_confidence": 0.9, "needs_review": False, "source_block_ids": ["block-000001"]}
        return {"chunk_id": chunk, "variables": [base | {"raw_name": f"v{n}", "question_text": q, "extraction_confidence": 0.5 if "low" in q else 0.9} for n, q in enumerate(questions)]}

    return rule


def test_documents_to_surveys(spark):
    files = spark.createDataFrame([("d1", "a.txt", bytearray(b"SECTION X\n\nWho owns it?\n\nHow low is it?")), ("d2", "b.txt", bytearray(b"please refuse")), ("d3", "c.pdf", bytearray(b"%PDF-")), ("d4", "d.csv", bytearray(b"a,b\na,b\n"))], "doc_id string, source_name string, content binary")
    out = extraction.convert_blocks(parse_files(files), rule_provider(make_rule()))
    assert {r.doc_id: r.status for r in out["results"].collect()} == {"d1": "success", "d2": "partial", "d3": "failed", "d4": "success"}
    rows = out["variables"].orderBy("source_order").collect()
    assert [(r.raw_name, r.question_text, r.needs_review, r.reasons, r.module) for r in rows] == [("v0", "Who owns it?", False, "", "SECTION X"), ("v1", "How low is it?", True, "low_confidence", "SECTION X")]
    assert {r.doc_id: (r.ok, r.reason) for r in out["calls"].collect()} == {"d1": (True, None), "d2": (False, "invalid_response"), "d4": (True, None)}


def test_form_graph(spark):
    tables = forms.form_tables(sheet_rows(spark), F.lit("2021-05-01").cast("date"))
    g = routing.form_graph(tables)
    assert g["edges"].count() == 8 and g["candidates"].count() == 0
    assert {(r.node, r.is_conflict) for r in g["activations"].collect()} == {("plot", False), ("m", False)}
    assert routing.analyse(g["nodes"], g["edges"], ["form_id"]).collect() == []


def test_analysis(spark):
    nodes = spark.createDataFrame([("f", "E", None, "entry", 0, False), ("f", "a", None, "question", 1, False), ("f", "b", "g", "question", 2, False), ("f", "c", None, "question", 3, False), ("f", "T", None, "terminal", 4, True), ("h", "a", None, "question", 0, False)], "form_id string, node string, parent string, kind string, ord int, is_terminal boolean")
    edges = spark.createDataFrame([("E", "a", "sequential"), ("a", "b", "default"), ("b", "a", "sequential"), ("a", "zz", "default")], "source string, target string, kind string").withColumn("form_id", F.lit("f")).withColumn("condition_key", F.lit("null")).withColumn("edge_id", F.concat_ws(">", "source", "target"))
    found = {(r.form_id, r.code, r.node) for r in routing.analyse(nodes, edges, ["form_id"]).collect()}
    assert found == {
        ("f", "dangling_edge", "a>zz"), ("f", "missing_parent", "b"), ("f", "container_without_entry", "g"), ("f", "several_defaults", "a"), ("f", "loop_without_exit", "a"), ("f", "unreachable", "c"), ("f", "unreachable", "T"), ("h", "unreachable", "a"),
        ("f", "dead_end", "c"), ("h", "dead_end", "a"), ("f", "no_terminal_path", "E"), ("f", "no_terminal_path", "a"), ("f", "no_terminal_path", "b"), ("f", "no_terminal_path", "c"), ("h", "no_terminal_path", "a"),
    }


def test_text_inventory(spark):
    blocks = spark.createDataFrame([("d", 0, "Q1. First?\nno line\n2) Second?"), ("d", 1, "ITEM 02\nQuestion: x"), ("e", 0, None)], "doc_id string, ord int, text string")
    rows = routing.inventory_nodes(routing.text_inventory(blocks)).orderBy("doc_id", "source_order").collect()
    assert [r.node_id for r in rows if r.doc_id == "d"] == ["entry:root:entry", "question:root:q1", "question:root:q2:duplicate-1", "question:root:q2:duplicate-2", "terminal:root:end"]
    assert [r.kind for r in rows if r.doc_id == "e"] == ["entry", "terminal"]


def test_prompts(spark):
    p = Prompt("p", "1", "a {{x}} b {{y}} {{x}}")
    assert p.places == ["x", "y"] and p.digest != Prompt("p", "2", p.template).digest
    r = spark.range(1).select(p.render(x=F.lit("{{y}}"), y=F.lit(None).cast("string")).alias("t")).first().t
    assert r == "a {{y}} b  {{y}}"
    with pytest.raises(ValueError):
        EXTRACT.render(text=F.lit(""))


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("version = 1\nconcurrency = 2\nconfidence_threshold = 0.5\n")
    got = config.resolve(str(path), {"TESSELLA_CONCURRENCY": "3"}, confidence_threshold=0.6, output=None)
    assert (got.concurrency, got.confidence_threshold, got.output) == (3, 0.6, "out")
    for text in ("api_key = 'x'", "version = 2", "nope = 1", "concurrency = true", "confidence_threshold = 2"):
        path.write_text(text)
        with pytest.raises(config.ConfigError):
            config.resolve(str(path), {})


def test_batch(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo")
    assert cli.main(["batch", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--name", "Corpus"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["documents"] == {"success": 1}
    assert os.path.exists(tmp_path / "out" / "corpus-batch.json")
    assert cli.main(["schema"]) == 0 and cli.main(["config"]) == 0


def test_files_above_the_limit_are_failed_documents(spark, tmp_path):
    for folder, size in (("a", 5), ("b", 500), ("c", 500)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text("q" * size)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # raises where the content of a larger file is loaded
    try:
        out = extraction.convert_folder(spark, str(tmp_path), rule_provider(cli.nothing), config.Config(most_source_bytes=100))
        assert sorted(r.status for r in out["results"].collect()) == ["failed", "failed", "success"]
        assert out["calls"].count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    faults = oversized_files(spark, str(tmp_path), 100).collect()
    assert [(r.source_name, r.fault, r.text) for r in faults] == [("x.txt", "SOURCE_LIMIT_EXCEEDED", None)] * 2


def test_requests_hold_to_the_limit(spark):
    limit = 700
    sent = spark.sparkContext.accumulator(0)

    def rule(message):
        if len(message.encode()) + 4 > limit:
            raise ProviderError("refused")
        sent.add(1)
        if message.startswith("Name"):
            return {}
        part, text = message.split("\nPart: ", 1)[1].split("\n", 1)[0], message.split("\n---\n", 1)[1]
        return {"chunk_id": part, "variables": [{"raw_name": w, "question_text": w, "data_type": "text", "extraction_confidence": 0.9, "needs_review": False, "source_block_ids": ["block-000001"]} for w in text.split() if w.startswith("q")]}

    text = " ".join(f"q{n:03d}" for n in range(400))
    table = "h,i\n" + "".join(f"é{n % 7},same row\n" for n in range(200))
    files = spark.createDataFrame([("d1", "a.txt", bytearray(text.encode())), ("d2", "t.csv", bytearray(table.encode()))], "doc_id string, source_name string, content binary")
    out = extraction.convert_blocks(parse_files(files), rule_provider(rule), config.Config(request_tokens=limit, overlap_tokens=50))
    assert {r.doc_id: r.status for r in out["results"].collect()} == {"d1": "success", "d2": "success"}
    assert {r.raw_name for r in out["variables"].collect()} == set(text.split())
    assert sent.value > 0 and out["calls"].filter("input_tokens + 4 > 700 or not ok").count() == 0
    narrow = config.Config(request_tokens=60, overlap_tokens=10)
    assert {r.status for r in extraction.convert_blocks(parse_files(files), rule_provider(rule), narrow)["results"].collect()} == {"partial"}
    over = spark.createDataFrame([("s", "x" * 97)], "request_sha string, message string")
    assert [(r.ok, r.reason, r.tries) for r in map_fitting(over, rule_provider(rule), 100).collect()] == [(False, "input_limit", 0)]


def test_halves():
    table = {"block_id": "b", "part_id": "b:part-000001", "kind": "table", "text": "", "size": 99, "n_columns": None, "rows": [["h", "i", "j"], ["1", "2", "3"], ["4", "5"], ["6", "7", "8"]]}
    assert [p["rows"] for p in chunking.halve_part(table)] == [[["h", "i", "j"], ["1", "2", "3"]], [["h", "i", "j"], ["4", "5"], ["6", "7", "8"]]]
    assert [p["rows"] for p in chunking.halve_part(table | {"rows": [["h", "i", "j"], ["4", "5"]]})] == [[["h"], ["4"]], [["i", "j"], ["5", ""]]]
    small = chunking.fitted([table], 14)
    assert [p["text"] for p in small] == ["h\n1", "i | j\n2 | 3", "h\n4", "i | j\n5 | ", "h\n6", "i | j\n7 | 8"] and [p["part_id"] for p in small] == [f"b:part-{n:06d}" for n in range(1, 7)]
    with pytest.raises(chunking.Unsplittable):
        chunking.fitted([table], 2)


def test_metadata(spark):
    def rule(message):
        if not message.startswith("Name"):
            return cli.nothing(message)
        text = message.split("\n---\n", 1)[1]
        survey = {"survey_id": "X_1", "country_code": "XXX", "survey_name": "X", "language": "en"}
        return {} if "none" in text else survey | {"year": 2002 if "later" in text else 99 if "unsound" in text else 2001}

    body = {"one": b"one", "two": b"none " * 40 + b"\n\n" + b"one " * 50, "three": b"one " * 70 + b"\n\nlater " + b"x " * 100, "four": b"unsound"}
    files = spark.createDataFrame([(d, f"lab_force-{d}.txt", bytearray(t)) for d, t in body.items()] + [("bad", "c.pdf", bytearray(b"%PDF-"))], "doc_id string, source_name string, content binary")
    out = extraction.convert_blocks(parse_files(files), rule_provider(rule), config.Config(request_tokens=520, overlap_tokens=0), datetime.date(2020, 5, 1))
    got = {r.doc_id: (r.survey_id, r.country_code, r.year, r.survey_name, r.language, r.is_incomplete, r.is_fallback) for r in out["metadata"].collect()}
    told = ("X_1", "XXX", 2001, "X", "en")
    assert got == {"one": (*told, False, False), "two": (*told, True, False), "three": (*told, True, False), "four": ("UNK_2020_SURVEY", "UNK", 2020, "Lab Force Four", None, True, True)}
    assert out["metadata_calls"].filter("doc_id = 'four' and reason = 'invalid_response'").count() == 1


def test_reconcile(spark):
    inv = spark.createDataFrame([("n1", "q1", "a", 1), ("n2", "q2", "a", 2), ("n3", "q2", "b", 3), ("n4", "q4", "b", 4)], "node_id string, alias string, section string, source_order int").withColumn("kind", F.lit("question")).withColumn("k", F.lit(1))
    rows = [("q1", "q2", "a", None, None, "forward"), ("q1", "q2", "a", "b", '{"op":"opaque","raw":"x"}', "forward"), ("q1", "zz", "a", None, None, "forward"), ("q4", "q1", "b", None, None, "native")]
    ev = spark.createDataFrame([(*r, n, f"e{n}") for n, r in enumerate(rows)], "source_ref string, target_ref string, section string, target_section string, condition string, perspective string, pos int, evidence_id string").withColumn("kind", F.lit("sequential")).withColumn("k", F.lit(1)).withColumn("confidence", F.lit(0.9)).withColumn("priority", F.lit(None).cast("int"))
    out = routing.reconcile(inv, ev, ["k"])
    assert {(r.source, r.target) for r in out["edges"].collect()} == {("n1", "n2"), ("n4", "n1")}
    assert {(r.source, r.target, tuple(r["issues"])) for r in out["candidates"].collect()} == {("n1", "n3", ("opaque_condition",)), ("n1", "ref:zz", ("unresolved_target",))}


def test_review_edges(spark):
    from tessella.operators import review

    accepted = spark.createDataFrame([("a", "b", "sequential")], "source string, target string, kind string")
    candidates = spark.createDataFrame([("c1", "a", "x", "default", "open", ["e1"]), ("c2", "a", "y", "default", "open", ["e2"])], "candidate_id string, source string, target string, kind string, status string, evidence_ids array<string>")
    decisions = spark.createDataFrame([("d1", 1, None, "confirm", ["c1"]), ("d2", 2, "d1", "reject", ["c1"]), ("d3", 3, None, "replace", ["c2"])], "decision_id string, ord int, supersedes string, action string, candidate_ids array<string>")
    replacements = spark.createDataFrame([("d3", "a", "z", "default"), ("d9", "a", "q", "default")], "decision_id string, source string, target string, kind string")
    assert {(r.target, r.origin) for r in review.reviewed_edges(accepted, candidates, decisions, replacements).collect()} == {("b", "accepted"), ("z", "replacement")}
    assert {(r.target, r.origin) for r in review.reviewed_edges(accepted, candidates, decisions.limit(1), replacements).collect()} == {("b", "accepted"), ("x", "confirmed")}
    d = spark.createDataFrame([("s", "x1", 0, ["c1"]), ("s", "x2", 1, ["c1", "c2"])], "survey_id string, discrepancy_id string, ord int, candidate_ids array<string>")
    told = review.candidate_status(candidates, decisions)
    assert all(r.is_resolved for r in review.resolve_discrepancies(d, told).collect())
    placed = review.packets(d)
    evidence = spark.createDataFrame([("e1", "s1"), ("e2", "s2")], "evidence_id string, span_id string")
    closure = {(r.what, r.id) for r in review.packet_closure(placed, d, candidates, evidence).collect()}
    assert closure == {("discrepancy", "x1"), ("discrepancy", "x2"), ("candidate", "c1"), ("candidate", "c2"), ("evidence", "e1"), ("evidence", "e2"), ("span", "s1"), ("span", "s2"), ("node", "a"), ("node", "x"), ("node", "y")}
