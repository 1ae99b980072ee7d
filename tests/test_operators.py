import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks as B
from tessella.operators import chunking as K
from tessella.operators import claims as C
from tessella.operators import evaluate as E
from tessella.operators import graph as G
from tessella.operators import provider as P
from tessella.operators import quality as Q
from tessella.operators import resolve as R
from tessella.operators import review as V
from tessella.operators.components import connected_components
from tessella.runtime import cut_lineage


def test_paragraphs_and_sections(spark):
    docs = spark.createDataFrame([("a", "SECTION X\n\none\r\n \r\ntwo\n\n\n"), ("b", None), ("c", "")], "doc_id string, text string")
    blocks = B.paragraphs(docs)
    assert [(r.doc_id, r.ord, r.block_id, r.text) for r in blocks.orderBy("ord").collect()] == [("a", 0, "block-000001", "SECTION X"), ("a", 1, "block-000002", "one"), ("a", 2, "block-000003", "two")]
    told = B.sections(blocks, "doc_id", "ord", F.col("text").startswith("SECTION"))
    assert {r.section for r in told.collect()} == {"SECTION X"}


def test_heading_paths(spark):
    rows = [("d", 1, 1, "A"), ("d", 2, 2, "B"), ("d", 3, 3, "C"), ("d", 4, 2, "D"), ("d", 5, 1, "E")]
    out = B.heading_paths(spark.createDataFrame(rows, "doc_id string, ord int, level int, text string"), "doc_id", "ord", "level", "text").orderBy("ord").collect()
    assert [r.path for r in out] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"]]


def test_coverage(spark):
    rows = [("ok", "page", 3, [1, 3], [2]), ("lap", "page", 2, [1, 2], [2]), ("gap", "page", 3, [1], []), ("out", "odd", 1, [1, 5], None)]
    df = spark.createDataFrame(rows, "doc_id string, unit_kind string, total_units int, converted_units array<int>, failed_units array<int>")
    found = {}
    for r in B.coverage_faults(df).collect():
        found.setdefault(r.doc_id, set()).add(r.fault)
    assert found == {"lap": {"overlap", "repeated"}, "gap": {"missing"}, "out": {"unit_kind", "outside"}}
    assert [r.message for r in B.failed_units(df).orderBy("doc_id").collect()] == ["page 2 could not be converted", "page 2 could not be converted"]


def test_split_text():
    assert K.split_text("aa bb cc", 6) == ["aa bb ", "cc"]
    assert "".join(K.split_text("x" * 25, 10)) == "x" * 25
    assert all(K.size_of(p) <= 7 for p in K.split_text("éé éé éé", 7))
    with pytest.raises(K.Unsplittable):
        K.split_text("🌾", 3)


def test_split_table():
    rows = [["h1", "h2"]] + [[f"a{i}", f"b{i}"] for i in range(9)]
    parts = K.split_table(rows, 30, 30)
    assert all(p["rows"][0] == ["h1", "h2"] and K.size_of(K._rendered(p["rows"])) <= 30 for p in parts)
    assert [r for p in parts for r in p["rows"][1:]] == rows[1:] and parts[0]["row_start"] == 2 and parts[-1]["row_end"] == 10
    wide = K.split_table([[f"head{i}" for i in range(10)], ["x" * 10] * 10], 40, 40)
    assert len({tuple(p["columns"]) for p in wide}) > 1 and sorted(c for p in wide for c in p["columns"]) == list(range(10))
    with pytest.raises(K.Unsplittable):
        K.split_table([["h"], ["x" * 100]], 40, 40)


def test_chunks_fit_and_cover(spark):
    rng = random.Random(0)
    rows = []
    for d in ("p", "q"):
        for n in range(40):
            table = rng.random() < 0.2
            rows.append((d, n, f"block-{n:06d}", "table" if table else "text", None if table else "word " * rng.randint(0, 60), [["a", "b"]] + [[str(i), "x"] for i in range(rng.randint(1, 40))] if table else None))
    blocks = spark.createDataFrame(rows, "doc_id string, ord int, block_id string, kind string, text string, table_rows array<array<string>>")
    chunks = K.chunk_blocks(blocks, 200, 40).collect()
    assert all(c.error is None and c.size <= 200 for c in chunks)
    for d in ("p", "q"):
        own = sorted((c for c in chunks if c.doc_id == d), key=lambda c: c.chunk_ord)
        assert [c.chunk_ord for c in own] == list(range(len(own)))
        seen = [b for c in own for b in c.new_block_ids]
        assert set(seen) == {f"block-{n:06d}" for n in range(40)} and seen == sorted(seen)
        assert any(c.overlap_block_ids for c in own)


def test_pack_sizes(spark):
    items = spark.createDataFrame([("d", n, s) for n, s in enumerate([5, 5, 30, 1, 1, 1])], "doc_id string, ord int, size long")
    out = K.pack_sizes(items, "doc_id", "ord", "size", 12).orderBy("chunk_ord").collect()
    assert [(r.n_items, r.total) for r in out] == [(2, 12), (1, 30), (3, 7)]


RECORD = "survey_id string, record_id long, source_order int, block_id string, source_block_ids array<string>, overlap_block_ids array<string>, prov struct<page int, sheet string, section_path array<string>>, raw_name string, label string, question_text string, data_type string, module string, categories array<struct<code string>>, numeric_range struct<min_value double, max_value double>, extraction_confidence double, needs_review boolean"


def record(n, name="q", text="What is it", blocks=("b1",), overlap=(), **more):
    base = dict(survey_id="s", record_id=n, source_order=n, block_id="b", source_block_ids=list(blocks), overlap_block_ids=list(overlap), prov=(1, None, []), raw_name=name, label=None, question_text=text, data_type="text", module="m", categories=None, numeric_range=None, extraction_confidence=0.9, needs_review=False)
    return tuple((base | more).values())


def policy(spark, rows):
    return {r.record_id: (r.status, r.reasons, r.module) for r in Q.apply_policy(spark.createDataFrame(rows, RECORD)).collect()}


def test_policy_flags(spark):
    out = policy(
        spark,
        [
            record(1, "a", extraction_confidence=0.70), record(2, "b", "x y", extraction_confidence=0.69), record(3, "c", "z", data_type="categorical_single"), record(4, "d", "w", data_type="categorical_multi", categories=[("1",)]),
            record(5, "e", "v", numeric_range=(2.0, 1.0)), record(6, "f", "u", numeric_range=(1.0, None), needs_review=True), record(7, "G", "t1"), record(8, "g", "t2"), record(9, "h", "s", prov=(1, "sheet", ["P", "Q"])), record(10, "i", "r", prov=(1, "sheet", [])),
        ],
    )
    assert out[1] == ("kept", "", "m") and out[2][1] == "low_confidence" and out[3][1] == "missing_categories" and out[4][1] == ""
    assert out[5][0] == "excluded" and out[6][1] == "model_flagged" and out[7][1] == out[8][1] == "duplicate_raw_name"
    assert out[9] == ("kept", "", "Q") and out[10] == ("kept", "", "sheet")


def test_overlap_duplicates_are_shielded_by_kept_records_only(spark):
    out = policy(spark, [record(1, blocks=["b1"]), record(2, blocks=["b2"], overlap=["b1"]), record(3, blocks=["b3"], overlap=["b2"]), record(4, "other", blocks=["b9"], overlap=["b1"])])
    assert [out[n][0] for n in (1, 2, 3, 4)] == ["kept", "duplicate", "kept", "kept"]


def test_similar_questions(spark):
    words = "one two three four five six seven eight nine ten".split()
    rows = [record(1, "a", " ".join(words)), record(2, "b", " ".join(words[:9])), record(3, "c", " ".join(reversed(words))), record(4, "d", " ".join(words[:5])), record(5, "e", "пять шесть"), record(6, "f", "", label=" ".join(words[1:]))]
    df = spark.createDataFrame(rows, RECORD)
    assert sorted((r.a, r.b, r.common, r.either) for r in Q.similar_questions(df).collect()) == [(1, 2, 9, 10), (1, 6, 9, 10), (2, 6, 8, 10)]
    assert {r.record_id for r in Q.similar_records(df).collect()} == {1, 2, 3, 6}


def test_prefix_filter_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [record(n, f"n{n}", " ".join(rng.sample("abcdefghijklm", rng.randint(3, 9)))) for n in range(120)]
    df = spark.createDataFrame(rows, RECORD)
    sets = {}
    for r in rows:
        sets.setdefault(frozenset(r[9].split()), r[1])
    want = {(min(x, y), max(x, y)) for s, x in sets.items() for t, y in sets.items() if s != t and len(s & t) >= 0.8 * len(s | t)}
    assert {(r.a, r.b) for r in Q.similar_questions(df).collect()} == want and want


def test_similar_questions_write_few_candidates(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = [record(n, f"n{n}", " ".join(["rare", *rng.sample(words, 20)])) for n in range(1, 201)]
    rows.append(record(201, "n", rows[0][9].replace("rare", "other")))
    written = []
    monkeypatch.setattr(Q, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    assert [(r.a, r.b) for r in Q.similar_questions(spark.createDataFrame(rows, RECORD)).collect()] == [(1, 201)]
    pairs = [df for df in written if df.columns == ["a", "b"]]
    assert len(pairs) == 1 and pairs[0].count() <= 5


def test_similar_questions_send_no_table_to_all_tasks(spark):
    df = spark.createDataFrame([record(n, f"n{n}", f"one two three four five six w{n}") for n in range(9)], RECORD)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for query in (Q.similar_questions, Q.similar_records):
            assert "Broadcast" not in query(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def final_plan(df, spark, threshold="1g"):
    """Rows, and the plan that ran with a threshold that would let Spark send any table to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = df()
        return sorted(map(str, out.collect())), out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def overlapping(spark):
    rows = [record(n, "a", "x y", blocks=[f"b{n}"], overlap=[f"b{n - 1}"], extraction_confidence=0.1) for n in range(1, 9)]
    rows += [record(9, "b", numeric_range=(2.0, 1.0)), record(10, "c", "one two three four five", data_type="categorical_single"), record(11, "C", "one two three four", prov=(1, "sheet", []))]
    return spark.createDataFrame(rows, RECORD)


def test_overlap_groups_are_not_sent_to_all_tasks(spark):
    rows, plan = final_plan(lambda: Q.overlap_duplicates(overlapping(spark)), spark)
    assert len(rows) == 4 and "Broadcast" not in plan


def test_diagnostics_send_only_counted_ids_to_all_tasks(spark, monkeypatch):
    few, plan = final_plan(lambda: Q.policy_diagnostics(overlapping(spark)), spark)
    assert "Broadcast" in plan and sum("overlap_deduped" in r for r in few) == 4 and sum("possible_duplicate" in r for r in few) == 1
    monkeypatch.setattr(Q, "MOST_SENT", 3)
    many, plan = final_plan(lambda: Q.policy_diagnostics(overlapping(spark)), spark)
    assert "Broadcast" not in plan and many == few


def test_policy_sends_only_counted_ids_to_all_tasks(spark, monkeypatch):
    few, plan = final_plan(lambda: Q.apply_policy(overlapping(spark)), spark)
    assert plan.count("BroadcastHashJoin") and sum("duplicate'" in r and "reasons=''" in r for r in few) == 4 and sum("possible_duplicate" in r for r in few) == 2
    monkeypatch.setattr(Q, "MOST_SENT", 3)
    many, plan = final_plan(lambda: Q.apply_policy(overlapping(spark)), spark)
    assert "Broadcast" not in plan and many == few


def test_diagnostics_order(spark):
    rows = [record(1, "a", numeric_range=(2.0, 1.0)), record(2, "b", "x", extraction_confidence=0.1), record(3, "B", "y")]
    out = Q.policy_diagnostics(spark.createDataFrame(rows, RECORD)).orderBy("phase", "position", "seq").collect()
    assert [r.code for r in out] == ["validation_failed", "low_confidence", "duplicate_raw_name"]


def test_resolution(spark):
    inv = spark.createDataFrame([("n1", "q", "q1", "agri", 1), ("n2", "q", "q1", "jobs", 2), ("n3", "q", "q2", "jobs", 3)], "node_id string, kind string, alias string, section string, source_order int").withColumn("k", F.lit(1))
    refs = spark.createDataFrame([(1, "q1", "agri", None), (2, "q1", None, "jobs"), (3, "q1", None, None), (4, "q2", "agri", None), (5, "q2", None, "agri"), (6, "zz", None, None)], "r int, alias string, section string, default_section string").withColumn("kind", F.lit("q")).withColumn("k", F.lit(1))
    out = {x.r: (x.resolution, x.node_id) for x in R.resolve(refs, inv, ["k"]).collect()}
    assert out == {1: ("resolved", "n1"), 2: ("resolved", "n2"), 3: ("ambiguous", None), 4: ("unresolved", None), 5: ("resolved", "n3"), 6: ("unresolved", None)}


def test_quotes(spark):
    blocks = spark.createDataFrame([("d", "b1", 1, [1, 2], "The  Big ﬁeld", None), ("d", "t", 3, None, None, [["a", "b"], ["c", "d"]])], "doc_id string, block_id string, page int, pages array<int>, text string, table_rows array<array<string>>")
    spans = spark.createDataFrame([(1, "b1", 2, None, None, "big field"), (2, "b1", 4, None, None, "big"), (3, "b1", 1, None, None, "small"), (4, "zz", None, None, None, "x"), (5, "t", 3, 2, 2, "c | d"), (6, "t", 3, 1, 1, "c | d"), (7, "t", 3, 2, 3, "c")], "n int, block_id string, page int, row_start int, row_end int, quote string").withColumn("doc_id", F.lit("d"))
    assert {r.n: r.quote_fault for r in R.check_quotes(spans, blocks).collect()} == {1: None, 2: "other_page", 3: "not_found", 4: "missing_block", 5: None, 6: "not_found", 7: "row_range"}


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def brute_reach(starts, pairs):
    seen, todo = set(starts), list(starts)
    while todo:
        u = todo.pop()
        for a, b in pairs:
            if a == u and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_graph_against_brute_force(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)]
    nodes = sorted({x for p in pairs for x in p})
    edges, table = edges_of(spark, pairs), spark.createDataFrame([(n, n % 10 == 0) for n in nodes], "node long, is_terminal boolean")
    starts = spark.createDataFrame([(pairs[0][0],)], "node long")
    assert {r.node for r in G.reachable(starts, edges).collect()} == brute_reach([pairs[0][0]], pairs)
    back = [(b, a) for a, b in pairs]
    assert {r.node for r in G.without_terminal_path(table, edges).collect()} == set(nodes) - brute_reach([n for n in nodes if n % 10 == 0], back)
    reach = {n: brute_reach([n], pairs) for n in nodes}
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    components = G.strong_components(table, edges)
    assert {r.node: r.component for r in components.collect()} == want
    cyclic = {c for c in want.values() if sum(v == c for v in want.values()) > 1} | {want[a] for a, b in pairs if a == b}
    assert {r.component for r in G.cyclic_components(components, edges).collect()} == cyclic
    links = {}
    for n in nodes:
        links[n] = min(brute_reach([n], pairs + back))
    assert {r.node: r.component for r in connected_components(edges, "source", "target").collect()} == links


def test_loops(spark):
    edges = edges_of(spark, [(1, 2), (2, 3), (3, 2), (3, 4)])
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "node long")
    roles = G.loop_edge_roles(G.strong_components(nodes, edges), edges, nodes.withColumn("ord", F.col("node")))
    assert {(r.source, r.target): r.role for r in roles.collect()} == {(1, 2): "entry", (2, 3): "internal", (3, 2): "return", (3, 4): "exit"}
    assert [(r.kind, r.has_exit) for r in G.loops(roles).collect()] == [("correction_return", True)]


def test_containment(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5)], "node long, parent long")
    assert {(r.node, r.fault) for r in G.containment_faults(nodes).collect()} == {(4, "missing_parent"), (5, "cycle"), (6, "cycle")}


def test_scale_graph(spark):
    edges = G.scale_graph(spark, 100, 250)
    assert edges.count() == edges.distinct().count() == 250 and edges.filter("source >= target or target >= 100").count() == 0


def test_claims(spark):
    rows = [
        (1, "a", "sequential", "null", 0, "e0", 0.5, None, "forward"), (1, "a", "sequential", "null", 1, "e1", 0.9, 2, "incoming"),
        (2, "a", "conditional", "x", 2, "e2", 0.5, 1, "forward"), (2, "b", "conditional", "x", 3, "e3", 0.5, None, "incoming"),
        (3, "a", "default", "null", 4, "e4", 0.5, None, "native"), (3, "b", "default", "null", 5, "e5", 0.5, None, "native"),
        (4, "a", "sequential", "null", 6, "e6", 0.5, None, "incoming"),
        (5, "a", "conditional", "p", 7, "e7", 0.5, 1, "forward"), (5, "b", "conditional", "q", 8, "e8", 0.5, 1, "forward"), (5, "c", "conditional", "r", 9, "e9", 0.5, 2, "forward"), (5, "c", "conditional", "r", 10, "e10", 0.5, 3, "forward"),
    ]
    ev = spark.createDataFrame(rows, "source int, target string, kind string, condition_key string, pos int, evidence_id string, confidence double, priority int, perspective string")
    marked = C.mark_issues(C.build_claims(ev, []), [])
    got = {(r.source, r.target): r["issues"] for r in marked.collect()}
    assert got[1, "a"] == [] and got[2, "a"] == got[2, "b"] == ["conflicting_target"] and got[3, "a"] == got[3, "b"] == ["conflicting_default"]
    assert got[4, "a"] == ["incoming_only"] and got[5, "a"] == got[5, "b"] == ["conflicting_priority"] and got[5, "c"] == ["conflicting_priority"]
    kept = C.accepted_edges(marked).collect()
    assert [(r.source, r.confidence, r.priority, r.evidence_ids) for r in kept] == [(1, 0.9, 2, ["e0", "e1"])]
    assert {(r.source, r.issue, r.n_claims, r.needs_human) for r in C.discrepancies(marked, []).collect()} == {(2, "conflicting_target", 2, True), (3, "conflicting_default", 2, False), (4, "incoming_only", 1, False), (5, "conflicting_priority", 3, False)}
    assert {r.status for r in C.candidates(marked).collect()} == {"needs_human_review", "needs_agent_review"}


def test_inference(spark):
    inv = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "s", 3)], "node_id string, section string, source_order int").withColumn("parent", F.lit("p")).withColumn("kind", F.lit("question")).withColumn("k", F.lit(1))
    claims = spark.createDataFrame([("a", "b", True), ("a", "c", True), ("b", "a", True), ("b", "a", False)], "source string, target string, is_inferred boolean").withColumn("kind", F.lit("sequential")).withColumn("k", F.lit(1))
    out = C.inference_issues(claims, C.expected_successors(inv, ["k"]), inv, ["k"]).collect()
    assert {(r.source, r.target, r.is_inferred): r.inference_issue for r in out} == {("a", "b", True): None, ("a", "c", True): "bypassed_successor", ("b", "a", True): "inferred_cycle", ("b", "a", False): None}


def test_branch_coverage(spark):
    domains = spark.createDataFrame([(s, v) for s in (1, 2, 3) for v in "xyz"], "source int, value string")
    branches = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 1, "z"), (2, 0, "x"), (2, 1, "x"), (3, 0, "x"), (3, 1, None)], "source int, branch int, value string")
    out = {r.source: (r.n_covered, r.is_covered, r.has_overlap) for r in C.branch_coverage(branches, domains, []).collect()}
    assert out == {1: (3, True, False), 2: (1, False, True), 3: (1, False, True)}


def test_review(spark):
    d = spark.createDataFrame([("d1", 1, None, "confirm", ["c1"]), ("d2", 2, "d1", "reject", ["c1"]), ("d3", 3, None, "replace", ["c2"])], "decision_id string, ord int, supersedes string, action string, candidate_ids array<string>")
    c = spark.createDataFrame([("c1", "open"), ("c2", "open"), ("c3", "open")], "candidate_id string, status string")
    assert {r.candidate_id: r.status for r in V.candidate_status(c, d).collect()} == {"c1": "rejected", "c2": "replaced", "c3": "open"}
    x = spark.createDataFrame([("s", 1, 0, ["a"]), ("s", 2, 1, ["b"]), ("s", 3, 2, ["a", "c"]), ("s", 4, 3, ["c"]), ("s", 5, 4, ["d"])], "survey_id string, discrepancy_id long, ord int, candidate_ids array<string>")
    packets = {}
    for r in V.packets(x, most=3).collect():
        packets.setdefault(r.packet, set()).add(r.discrepancy_id)
    assert sorted(map(sorted, packets.values())) == [[1, 3, 4], [2, 5]]
    assert [(r.discrepancy_id, r.missing) for r in V.missing_references(x, "discrepancy_id", "candidate_ids", spark.createDataFrame([("a",), ("b",), ("c",)], "candidate_id string"), "candidate_id").collect()] == [(5, "d")]


def test_scores(spark):
    e = spark.createDataFrame([("m", "x"), ("m", "x"), ("m", "y"), ("n", "z")], "metric string, id string")
    a = spark.createDataFrame([("m", "x"), ("m", "w")], "metric string, id string")
    out = {r.metric: (r.n_expected, r.n_actual, r.n_matched, r.precision, r.recall) for r in E.multiset_metrics(e, a, ["metric"], ["id"]).collect()}
    assert out == {"m": (3, 2, 1, 0.5, 1 / 3), "n": (1, 0, 0, None, 0.0)}
    t = spark.createDataFrame([("m", 0.4), ("q", 0.1)], "metric string, threshold double")
    v = spark.createDataFrame([("m", 0.5)], "metric string, value double")
    assert {r.metric: r.verdict for r in E.gate(v, t).collect()} == {"m": "passed", "q": "unavailable"}
    one, two = (E.digest(df, ["metric"], F.col("id")).orderBy("metric").collect() for df in (e, e.orderBy(F.desc("id"))))
    assert one == two


def test_provider_retries():
    make = P.scripted_provider({"m": [P.ProviderError(P.TRANSPORT), {"bad": 1}, {"ok": 1}], "t": [P.Answer({}, finish="length")], "r": [P.ProviderError(P.REFUSED)], "x": []})
    waits = []
    check = lambda p: None if "ok" in p else "no ok"
    assert P.call(make(), "m", check, P.Retry(), waits.append)[:4] == (True, '{"ok": 1}', None, 3) and waits == [0.5, 1.0]
    assert P.call(make(), "t", check, P.Retry(), waits.append)[:4] == (False, None, "truncated", 1)
    assert P.call(make(), "r", check, P.Retry(), waits.append)[2:4] == ("refused", 1)
    assert P.call(make(), "x", check, P.Retry(), lambda s: None)[2:4] == ("transport", 3)


def test_map_reduce(spark):
    def length_or_fail(message):
        if "boom" in message:
            raise P.ProviderError(P.REFUSED)
        return {"n": len(message)}

    chunks = spark.createDataFrame([("d", 0, "c0", "a"), ("d", 1, "c1", "boom"), ("e", 0, "c0", "a"), ("f", 0, "c0", "boom")], "doc_id string, chunk_ord int, chunk_id string, text string")
    out = {r.doc_id: (r.status, r.n_failed, r.result) for r in P.map_reduce(chunks, P.rule_provider(length_or_fail), "n long", lambda a: F.size(a)).collect()}
    assert out == {"d": ("partial", 1, 1), "e": ("success", 0, 1), "f": ("failed", 1, None)}


def test_row_numbers_run_on_through_a_hot_key(spark):
    from tessella.operators.ordered import row_numbers

    rows = spark.createDataFrame([("a" if n % 10 else None, n * 7919 % 5000) for n in range(5000)], "k string, ord int")
    out = row_numbers(rows, ["k"], ["ord"], "place").collect()
    for key in ("a", None):
        mine = sorted((r.ord, r.place) for r in out if r.k == key)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))
    assert len(out) == 5000
