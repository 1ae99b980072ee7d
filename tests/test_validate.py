from pyspark.sql import functions as F

from tessella.operators import validate as V


def faults(df, key):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r.fault)
    return out


def test_evidence(spark):
    schema = "evidence_id string, evidence_type string, kind string, source string, target string, item string, condition string, origin string, native_expression string, confidence double, quote string"
    rows = [
        ("ok", "transition", "default", "a", "b", None, None, "text", None, 0.5, "q"), ("ok2", "activation", None, None, None, "i", "{}", "native", "x", 1.0, "q"), ("a", "transition", "odd", "a", None, "i", None, "text", "x", 2.0, " "),
        ("b", "activation", None, None, "t", None, None, "text", None, float("nan"), "q" * 2001), ("c", None, None, None, None, None, None, "text", None, None, "q"),
    ]
    assert faults(V.evidence_faults(spark.createDataFrame(rows, schema)), "evidence_id") == {"a": {"transition_ends", "transition_item", "native_origin", "confidence", "quote"}, "b": {"activation_item", "activation_target", "confidence", "quote"}, "c": {"type", "confidence"}}


def test_edges_and_nodes(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "conditional", "{}", 0), ("e2", "a", "b", "default", "{}", -1), ("e3", "", "b", "conditional", None, None)], "edge_id string, source string, target string, kind string, condition string, priority int")
    assert faults(V.edge_faults(edges), "edge_id") == {"e2": {"condition", "priority"}, "e3": {"condition", "ends"}}
    nodes = spark.createDataFrame([("n1", "terminal", "completed", 0), ("n2", "terminal", None, 1), ("n3", "odd", "x", None), ("n4", "section", None, 3)], "node string, kind string, terminal_kind string, n_children int")
    assert faults(V.node_faults(nodes), "node") == {"n2": {"terminal_kind", "children"}, "n3": {"kind", "terminal_kind"}}


def test_batches(spark):
    batches = spark.createDataFrame([("c1", "forward", "forward", ["a", "b"], ["a", "b"]), ("c2", "forward", "forward", ["b", "a"], ["a", "b"]), ("c3", "incoming_activation", "forward", ["a"], ["a"])], "chunk_id string, pass_kind string, asked_pass string, examined array<string>, asked array<string>")
    evidence = spark.createDataFrame([("c1", "l1", "transition", '{"op":"equals","item":"a","value":{"t":"int","s":"1"}}', "q"), ("c2", "l1", "activation", None, "q"), ("c2", "l1", "transition", '{"op":"all","children":[]}', "q" * 3000)], "chunk_id string, local_id string, evidence_type string, condition string, quote string")
    found = V.batch_faults(batches, evidence)
    assert faults(found, "chunk_id") == {"c2": {"examined", "local_id", "activation_in_forward", "shape_all", "quote"}, "c3": {"pass"}}
    assert [r.chunk_id for r in V.sound_batches(evidence, found).collect()] == ["c1"]


def test_merging(spark):
    old = spark.createDataFrame([("1", "x")], "diagnostic_id string, code string")
    new = spark.createDataFrame([("1", "y"), ("2", "x"), ("3", "z"), ("3", "z")], "diagnostic_id string, code string")
    assert {(r.diagnostic_id, r.is_carried) for r in V.merge_diagnostics(old, new).collect()} == {("1", True), ("3", False)}
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 0, "c"), ("k", 1, "b"), ("k", 3, None)], "k string, o int, v string")
    assert [(r.v, r.place) for r in V.ordered_unique(rows, "k", "o", "v").orderBy("place").collect()] == [("c", 0), ("b", 1)]
    d = spark.createDataFrame([("s", "a", False, True), ("s", "a", True, True), ("s", "a", False, False)], "s string, issue string, is_resolved boolean, needs_human boolean")
    assert [(r.n, r.needs_human) for r in V.unresolved_rollup(d, "s").collect()] == [(2, True)]
    assert d.select(F.count("*")).first()[0] == 3
