import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import conditions as C
from tessella.functions import identity as I
from tessella.functions import redact as R
from tessella.functions import text as T


def test_text_columns(spark):
    df = spark.createDataFrame([("  a   b\t", [["a|b", None, "c\\d"], ["x\ny", " ", ""]], "AB12")], "t string, rows array<array<string>>, ref string")
    column, row = T.cell_reference(F.col("ref"))
    r = df.select(T.squeeze(F.col("t")).alias("s"), T.render_table(F.col("rows")).alias("r"), T.trim_trailing_cells(F.col("rows")[1]).alias("c"), column.alias("col"), row.alias("row"), T.similarity_text(F.lit("É Which-ONE?  2")).alias("sim")).first()
    assert r.s == "a b" and r.r == "a\\|b |  | c\\\\d\nx\\ny |   | " and r.c == ["x\ny"] and (r.col, r.row) == (28, 12) and r.sim == "which one 2"


def test_headings(spark):
    rows = [("SECTION A", True), ("section two of it", True), ("ALL CAPS HERE", True), ("Not one", False), ("SECTIONAL", True), ("sectional", False), ("A\nB", False), ("123", False), (" ".join(["A"] * 13), False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.filter(~F.equal_null(T.is_heading(F.col("t")), "want")).collect() == []


@pytest.mark.parametrize("text, want", [("Q1", "q1"), ("1", "q1"), ("Question 1", "q1"), ("Column Q1", "q1"), ("Q01", "q1"), ("col. q 7", "q7"), ("Pregunta 12", "pregunta-12"), ("colour", "colour"), ("Straße ①", "strasse-1"), ("ros_04a", "ros-04a")])
def test_aliases(spark, text, want):
    assert I.alias(text) == want
    if text.isascii():
        assert spark.range(1).select(I.alias_ascii(F.lit(text))).first()[0] == want


def test_identity():
    assert I.stable_id("n", {"b": 1, "a": "é"}) == I.stable_id("n", {"a": "é", "b": 1})
    assert I.canonical_json({"b": None, "a": "é"}) == '{"a":"\\u00e9","b":null}'
    assert I.section_path(["Ａgri & Food", "Ⅳ"]) == "agri-food/iv" and I.section_path([]) == "root"
    assert I.quote_text(" ﬁeld  X ") == "field x"


def test_canonical_object_is_canonical(spark):
    r = spark.range(1).select(I.canonical_object(b=F.lit("1"), a=I.json_string(F.lit('x"\\')), c=I.json_string(F.lit(None).cast("string"))).alias("j")).first().j
    assert r == I.canonical_json({"a": 'x"\\', "b": 1, "c": None})


@pytest.mark.parametrize(
    "text, gone",
    [("Authorization: Bearer abc.def", "abc.def"), ("https://me:pw@host/x", "me:pw"), ('{"api_key": "s3cret"}', "s3cret"), ("password=hunter2 next", "hunter2"), ("https://h/x?sig=ab%2Fc&y=1", "ab%2Fc"), ("Ocp-Apim-Subscription-Key: zzz9", "zzz9"), ('\\"client_secret\\": \\"qq7\\"', "qq7")],
)
def test_redaction(text, gone):
    out = R.redact_text(text)
    assert gone not in out and R.MASK in out


def test_redaction_keeps_the_rest():
    assert R.redact_text("the owner of the key farm asks ?x=1&y=2") == "the owner of the key farm asks ?x=1&y=2"
    assert R.redact_text(None) is None
    assert R.redact_text("abc abcd", ("abc", "abcd")) == f"{R.MASK} {R.MASK}"
    assert R.redact_data({"Token": [1], "a": ["password=x"], "n": 1}) == {"Token": R.MASK, "a": [f"password={R.MASK}"], "n": 1}


@pytest.mark.parametrize(
    "text, op",
    [
        ("${a} = 1", "equals"), ("${a} != '1'", "not_equals"), ("${a} >= 2.5", "greater_than_or_equal"), ("${a} = ''", "not_answered"), ("${a} != \"\"", "answered"), ("selected(${a}, 'x')", "selected"),
        ("not(selected(${a}, 'x'))", "not_selected"), ("not(${a} = 1)", "not"), ("${a} = 1 and ${b} = 2", "all"), ("${a} = 1 or ${b} = 2 and ${a} = 3", "any"), ("((${a} = true()))", "equals"),
        ("${a} + 1 = 2", "opaque"), ("count(${a}) > 1", "opaque"), ("${a} = ${b}", "opaque"), ("${z} = 1", "opaque"), ("${a} = 1 and foo()", "opaque"), ("(${a} = 1", "opaque"), ("", "opaque"), ("${a} = 'x or y'", "equals"),
    ],
)
def test_expressions(text, op):
    assert C.parse(text, frozenset("ab"))["op"] == op


def test_condition_binding_and_types():
    c = C.parse("${a} = 1 or ${b} = '1' and ${a} = 2")
    assert [x["op"] for x in c["children"]] == ["equals", "all"]
    assert c["children"][0]["value"] == {"t": "int", "s": "1"} and c["children"][1]["children"][0]["value"]["t"] == "str"
    assert C.faults(c) == [] and C.faults({"op": "between", "item": "a", "values": [1]}) == ["shape_between"] and C.faults({"op": "x"}) == ["unknown_operator"]
    deep = {"op": "equals", "item": "a", "value": {"t": "int", "s": "1"}}
    for _ in range(7):
        deep = {"op": "not", "children": [deep]}
    assert "too_deep" in C.faults(deep)


def test_normal_form_forgets_order():
    a, b = C.parse("${a} = 1 and ${b} = 2"), C.parse("( ${b} = 2 ) and ${a}=1")
    assert I.canonical_json(C.normal_form(a)) == I.canonical_json(C.normal_form(b))


def test_coverage_of_conditions():
    domain = frozenset(("int", str(n)) for n in range(3))
    covered = lambda t: C.covered(C.parse(t), domain)
    assert covered("${a} = 1") == ("a", frozenset([("int", "1")]))
    assert covered("${a} != 1")[1] == domain - {("int", "1")}
    assert covered("${a} = 1 or ${a} = 2")[1] == {("int", "1"), ("int", "2")}
    assert covered("selected(${a}, 1)") is None and covered("${a} = 1 or ${b} = 2") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="${}ab =()'1orndt<>", max_size=40))
def test_expressions_never_crash(text):
    assert C.parse(text)["op"]


def test_condition_columns(spark):
    df = spark.createDataFrame([("${a} = 1 and ${b} = 2",), (None,)], "e string").select(C.parsed(F.col("e")).alias("c"))
    rows = df.select(C.condition_items(F.col("c")).alias("i"), C.condition_key(F.col("c")).alias("k"), C.condition_faults(F.col("c")).alias("f")).collect()
    assert rows[0].i == ["a", "b"] and json.loads(rows[0].k)["op"] == "all" and rows[0].f == [] and rows[1].k == "null"


def test_pointer(spark):
    df = spark.createDataFrame([('{"a/b":[{"c":5}]}',)], "j string")
    assert df.select(T.json_pointer(F.col("j"), "/a~1b/0/c")).first()[0] == "5"


def test_escape_invisible(spark):
    df = spark.createDataFrame([("a​é ",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(T.escape_invisible(F.col("t"))).collect()] == ["a\\u200bé\\u2028", "plain", None]


@pytest.mark.parametrize("text", ["Authorization: Custom abc def", "Proxy-Authorization=Custom abc def", 'Authorization: Digest username="abc", response="def"', "Ocp-Apim-Subscription-Key: abc def", '{"authorization":"abc def"}', "https://abc:def@host/x", "https://h/x?api%5Fkey=abc%20def", "refresh-token = abcdef"])
def test_nothing_of_a_secret_is_left(spark, text):
    out = spark.range(1).select(R.redacted(F.lit(text))).first()[0]
    assert out == R.redact_text(text) and "abc" not in out and "def" not in out


def test_errors_are_told_with_their_causes():
    try:
        try:
            raise ValueError("endpoint?access_token=inner")
        except ValueError as cause:
            raise RuntimeError("failed on my answer") from cause
    except RuntimeError as error:
        told = R.redact_error(error, ("my answer",))
        assert told == f"RuntimeError: failed on {R.MASK} <- ValueError: endpoint?access_token={R.MASK}"
        error.__cause__.__cause__ = error
        assert R.redact_error(error).count("<-") == 1


def test_data_helpers():
    from tessella.functions import data as D

    assert D.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "c": 3}, "d": [None]}) == {"a": {"b": 1, "c": 3}, "d": [None]}
    assert not D.same_data([1, True], [1, 1]) and D.same_data({"a": [None]}, {"a": [None]})
    strict = D.strict_schema({"type": "object", "title": "T", "properties": {"title": {"type": "string", "description": "d"}, "n": {"anyOf": [{"type": "integer"}, {"type": "null"}]}}})
    assert strict == {"type": "object", "properties": {"title": {"type": "string"}, "n": {"anyOf": [{"type": "integer"}, {"type": "null"}]}}, "required": ["title", "n"], "additionalProperties": False}
    for loose in ({"type": "object"}, {}, {"type": "object", "properties": {"a": {}}}, {"type": "object", "properties": {"a": {"type": "string"}}, "additionalProperties": True}):
        with pytest.raises(D.OpenSchema):
            D.strict_schema(loose)


def test_checkpoints_of_a_cluster_need_a_shared_folder():
    from tessella.runtime import checkpoint_folder

    assert checkpoint_folder("/shared", "spark://x:7077") == "/shared" and checkpoint_folder(None, "local[4]")
    with pytest.raises(RuntimeError):
        checkpoint_folder(None, "spark://x:7077")
