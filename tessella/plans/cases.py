"""Queries over written-out inputs, for operators whose rules no SQL engine has: their SQL states what must come out."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import conditions as C
from tessella.functions import data as D
from tessella.functions import identity as I
from tessella.functions import redact as R
from tessella.functions import text as T
from tessella.operators import claims, evaluate, forms, graph, provider, quality, regions, resolve, review, risks, validate
from tessella.operators import chunking as K
from tessella.plans import extraction, routing
from tessella.sources import pages, parsers, reader
from tessella.sources.reader import parse_files

QUERIES: dict = {}
SQL: dict[str, str] = {}
_TYPES = {"string": "varchar", "int": "integer", "long": "bigint", "boolean": "boolean", "double": "double"}


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def stated(schema: str, rows: list[tuple]) -> str:
    """SQL that gives these rows."""
    columns = [c.split(" ") for c in schema.split(", ")]
    picked = ", ".join(f'cast("{name}" as {_TYPES[kind]}) as "{name}"' for name, kind in columns)
    lines = ",\n".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return f"select {picked} from (values {lines}) as t({', '.join(f'"{name}"' for name, _ in columns)})"


def case(schema: str, expected: list[tuple]):
    """Registers a function of the session under its name, with the rows that it must give."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = function(spark)
            return out.select(*(F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in schema.split(", "))))

        QUERIES[function.__name__] = run
        SQL[function.__name__] = stated(schema, expected)
        return function

    return add


def frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _texts(spark, *texts) -> DataFrame:
    return frame(spark, "n int, x string", list(enumerate(texts, 1)))


# --- identity -------------------------------------------------------------------------------------------------------


@case("n int, slug string", [(1, "agri-food"), (2, "iv"), (3, "straße".casefold()), (4, ""), (5, None), (6, "вопрос-7")])
def slugs(spark):
    return _texts(spark, "  Ａgri & Food ", "Ⅳ", "Straße", "--", None, "Вопрос №7".replace("№", " ")).select("n", I.slug_of(F.col("x")).alias("slug"))


@case("n int, alias string", [(1, "q1"), (2, "q1"), (3, "q1"), (4, "q1"), (5, "pregunta-12"), (6, "q12a"), (7, "q7"), (8, "col"), (9, None)])
def aliases(spark):
    return _texts(spark, "1", "Q01", "question 1", "Column Q1", "Pregunta 12", "Q12a", "ｑ ７", "col", None).select("n", I.alias_of(F.col("x")).alias("alias"))


@case("n int, path string", [(1, "agri-food/iv"), (2, "root"), (3, "a-b")])
def section_paths(spark):
    rows = frame(spark, "n int, x array<string>", [(1, ["Ａgri & Food", "Ⅳ"]), (2, []), (3, ["a  B"])])
    return rows.select("n", I.section_of(F.col("x")).alias("path"))


@case("n int, quote string", [(1, "field x"), (2, "who pays?"), (3, None)])
def quotes(spark):
    return _texts(spark, " ﬁeld  X ", "Who  PAYS?\n", None).select("n", I.quote_of(F.col("x")).alias("quote"))


@case("n int, canonical string", [(1, '{"a":"\\u00e9","b":null}'), (2, "[1,2.5,true]"), (3, '{"a":{"b":1,"c":2}}')])
def canonical_texts(spark):
    return _texts(spark, '{"b": null, "a": "é"}', "[1, 2.5, true]", '{"a": {"c": 2, "b": 1}}').select("n", I.canonical_of(F.col("x")).alias("canonical"))


# --- data and secrets -----------------------------------------------------------------------------------------------


@case("n int, merged string", [(1, '{"a":1,"b":{"c":3,"d":2},"e":[2]}'), (2, '{"a":{"x":1}}'), (3, '{"a":5}'), (4, None)])
def merged_settings(spark):
    pairs = [(1, '{"a":1,"b":{"c":1,"d":2},"e":[1]}', '{"b":{"c":3,"d":null},"e":[2]}'), (2, "{}", '{"a":{"x":1,"y":null}}'), (3, '{"a":{"x":1}}', '{"a":5}'), (4, None, "{}")]
    return frame(spark, "n int, a string, b string", pairs).select("n", D.merged_json(F.col("a"), F.col("b")).alias("merged"))


@case("n int, same boolean", [(1, True), (2, False), (3, False), (4, False), (5, True), (6, False), (7, None)])
def exact_values(spark):
    pairs = [(1, '{"a":[1,{"b":null}]}', '{"a":[1,{"b":null}]}'), (2, '{"a":1,"b":2}', '{"b":2,"a":1}'), (3, "1", "1.0"), (4, "1", "true"), (5, "[]", "[]"), (6, "[1]", "[1,1]"), (7, "1", None)]
    return frame(spark, "n int, a string, b string", pairs).select("n", D.same_json(F.col("a"), F.col("b")).alias("same"))


@case("path string, value string", [("/a/0", "1"), ("/a/1/b~1c", '"x"'), ("/d", "[]"), ("/e~0", "null")])
def json_paths(spark):
    return _texts(spark, '{"a":[1,{"b/c":"x"}],"d":[],"e~":null}').select(F.explode(D.json_leaves(F.col("x"))).alias("l")).select("l.path", "l.value")


@case("pointer string, value string", [("/a/1", "2"), ("/x~1y", "3"), ("/m~0n/k", "z"), ("/none", None)])
def json_pointers(spark):
    one = _texts(spark, '{"a":[1,2],"x/y":3,"m~n":{"k":"z"}}')
    return one.select(F.explode(F.array(*(F.struct(F.lit(p).alias("pointer"), T.json_pointer(F.col("x"), p).alias("value")) for p in ("/a/1", "/x~1y", "/m~0n/k", "/none")))).alias("r")).select("r.*")


@case("n int, masked string", [
    (1, '{"authorization":"[REDACTED]","nested":["https://h/x?api_key=[REDACTED]&safe=yes",{"question_text":"[REDACTED]","safe":"kept"}]}'),
    (2, '{"bearer_token":"[REDACTED]","Ocp-Apim-Subscription-Key":"[REDACTED]","n":1}'), (3, "password=[REDACTED] is no JSON"), (4, None),
])
def redacted_objects(spark):
    rows = _texts(spark, '{"authorization":"Bearer v","nested":["https://h/x?api_key=u&safe=yes",{"question_text":"q","safe":"kept"}]}', '{"bearer_token":"b","Ocp-Apim-Subscription-Key":"k","n":1}', "password=hunter2 is no JSON", None)
    return rows.select("n", R.redacted_json(F.col("x")).alias("masked"))


@case("n int, masked string", [
    (1, "Authorization: [REDACTED]"), (2, "Proxy-Authorization: [REDACTED]\nkept"), (3, "bearer_token=[REDACTED]"), (4, '{"client_secret":"[REDACTED]"}'), (5, '{\\"api_key\\":\\"[REDACTED]\\"}'),
    (6, "https://[REDACTED]@host/v1"), (7, "https://host/v1?client_secret=[REDACTED]&page=2"), (8, "ocp-apim-subscription-key: [REDACTED]"), (9, "the secret of a token"), (10, None), (11, "Authorization: [REDACTED]"),
])
def redacted_secrets(spark):
    texts = ("Authorization: Custom abc def", "Proxy-Authorization: Custom s t\nkept", "bearer_token=b", '{"client_secret":"j s"}', '{\\"api_key\\":\\"e\\"}', "https://u:p@host/v1", "https://host/v1?client_secret=q&page=2", "ocp-apim-subscription-key: k l", "the secret of a token", None, 'Authorization: Digest username="u", response="r"')
    return _texts(spark, *texts).select("n", R.redacted(F.col("x")).alias("masked"))


@case("text string", [("b",), ("c",), ("d",)])
def output_strings(spark):
    return _texts(spark, '{"a":"b","x":[1,"c",{"y":"b","z":"d"}],"n":null}').select(F.explode(R.json_strings(F.col("x"))).alias("text"))


# --- conditions -----------------------------------------------------------------------------------------------------

_EXPRESSIONS = (
    "${a} = 'x'", "${a} != 2", "${a} >= 1.50", "not(selected(${a}, 'k'))", "${a} = ''", "${a} = 1 or ${b} = 2 and ${b} > 3", "(${a} = true())", "${c} = 1", "count(${a}) > 1", "not(${a} = 1 and ${b} = 2)", "${a} = 1 and", None,
)


@case("n int, key string", [
    (1, '{"item":"a","op":"equals","value":{"s":"x","t":"str"}}'), (2, '{"item":"a","op":"not_equals","value":{"s":"2","t":"int"}}'), (3, '{"item":"a","op":"greater_than_or_equal","value":{"s":"1.5","t":"float"}}'),
    (4, '{"item":"a","op":"not_selected","value":{"s":"k","t":"str"}}'), (5, '{"item":"a","op":"not_answered"}'),
    (6, '{"children":[{"children":[{"item":"b","op":"equals","value":{"s":"2","t":"int"}},{"item":"b","op":"greater_than","value":{"s":"3","t":"int"}}],"op":"all"},{"item":"a","op":"equals","value":{"s":"1","t":"int"}}],"op":"any"}'),
    (7, '{"item":"a","op":"equals","value":{"s":"true","t":"bool"}}'), (8, '{"op":"opaque","raw":"${c} = 1"}'), (9, '{"op":"opaque","raw":"count(${a}) > 1"}'),
    (10, '{"children":[{"children":[{"item":"a","op":"equals","value":{"s":"1","t":"int"}},{"item":"b","op":"equals","value":{"s":"2","t":"int"}}],"op":"all"}],"op":"not"}'),
    (11, '{"op":"opaque","raw":"${a} = 1 and"}'), (12, "null"),
])
def condition_keys(spark):
    told = _texts(spark, *_EXPRESSIONS).withColumn("condition", C.parsed(F.col("x"), F.array(F.lit("a"), F.lit("b"))))
    return told.select("n", C.condition_key(F.col("condition")).alias("key"))


@case("n int, item string", [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (6, "a"), (6, "b"), (7, "a"), (8, "c"), (10, "a"), (10, "b")])
def condition_leaves(spark):
    told = _texts(spark, *_EXPRESSIONS).withColumn("condition", C.parsed(F.col("x")))
    return told.select("n", F.explode(C.condition_items(F.col("condition"))).alias("item"))


@case("n int, fault string", [(1, "shape_equals"), (2, "shape_between"), (3, "unknown_operator"), (4, "shape_all"), (5, "too_deep"), (6, "shape_opaque"), (7, "shape_not")])
def condition_shapes(spark):
    leaf = {"op": "answered", "item": "a"}
    deep = leaf
    for _ in range(6):
        deep = {"op": "not", "children": [deep]}
    shapes = [{"op": "equals", "item": "a"}, {"op": "between", "item": "a", "values": [{"t": "int", "s": "1"}]}, {"op": "like"}, {"op": "all", "children": [leaf]}, deep, {"op": "opaque", "raw": ""}, {"op": "not", "children": []}, leaf]
    return _texts(spark, *map(json.dumps, shapes)).select("n", F.explode(C.condition_faults(F.col("x"))).alias("fault"))


@case("n int, t string, s string", [(1, "str", "a b"), (2, "int", "7"), (3, "float", "1.5"), (4, "bool", "false"), (5, None, None), (6, "str", ""), (7, None, None)])
def typed_literals(spark):
    told = _texts(spark, "'a b'", "+7", "1.5", "false()", "today()", '""', None).withColumn("v", T.tagged_scalar(F.col("x")))
    return told.select("n", "v.t", "v.s")


@case("n int, col int, row int", [(1, 1, 1), (2, 28, 12), (3, 703, 1048576), (4, None, None), (5, None, None)])
def cell_references(spark):
    column, row = T.cell_reference(F.col("x"))
    return _texts(spark, "A1", "$ab$12", "AAA1048576", "12A", "").select("n", column.alias("col"), row.alias("row"))


# --- forms ----------------------------------------------------------------------------------------------------------

_SHEETS = {
    "survey": [
        ["type", " Name ", "label", "Label :: French", "relevant", "constraint", "choice_filter", "repeat-count"],
        ["select_one yn", "own", "Own a farm?", "Une ferme ?", "", "", "", ""],
        ["begin group", "farm", "Farm", "", "${own} = 'y'", "", "", ""],
        ["integer", "area", "Area", "", "", ". > 0", "", ""],
        ["begin repeat", "crop", "", "", "", "", "", "3"],
        ["select_multiple_from_file lists/crops.csv", "kind", "Kinds", "", "", "", "x = 1", ""],
        ["calculate", "total", "", "", "", "", "", ""],
        ["end repeat", "", "", "", "", "", "", ""],
        ["end group", "", "", "", "", "", "", ""],
        ["note", "thanks", "Thanks", "", "", "", "", ""],
        ["start", "begun", "", "", "", "", "", ""],
        ["rank crops", "order", "Order", "", "pulldata('a') = 1 + 2", "", "", ""],
        ["select_one gone", "lost", "Lost", "", "", "", "", ""],
        ["select_one_from_file ../x.csv", "away", "Away", "", "", "", "", ""],
    ],
    "choices": [["list_name", "name", "label", "label::French"], ["yn", "y", "Yes", "Oui"], ["yn", "n", "No", ""], ["", "", "", ""], ["yn", "n", "No again", ""]],
    "settings": [["form_id", "form_title", "default_language"], ["f1", "Farms", "French"]],
}


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook's bytes, its texts written into the cells."""
    main, rel, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{k}" Type="t" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows, 1))
            archive.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def _form(spark) -> dict[str, DataFrame]:
    """The written form, read from a workbook's bytes, with its file of choices."""
    blocks = parse_files(frame(spark, "doc_id string, source_name string, content binary", [("f", "farm.xlsx", workbook(_SHEETS))]))
    rows = forms.workbook_rows(blocks)
    files = frame(spark, "form_id string, path string, row_no int, cells array<string>", [("f", "lists/crops.csv", 1, ["name", "label"]), ("f", "lists/crops.csv", 2, ["m", "Maize"]), ("f", "lists/crops.csv", 3, ["r", ""])])
    return forms.form_tables(rows, F.lit("2021-05-01").cast("date"), files) | {"rows": rows}


@case("row_no int, raw_name string, label string, data_type string, module string, codes string, notes string, reasons string", [
    (2, "own", "Une ferme ?", "categorical_single", None, "n,n,y", None, ""), (4, "area", "Area", "numeric", "farm", None, "constraint: . > 0", ""), (6, "kind", "Kinds", "categorical_multi", "crop", "m,r", "choice_filter: x = 1", ""),
    (7, "total", None, "other", None, None, None, ""), (11, "begun", None, "date", None, None, None, ""), (12, "order", "Order", "other", None, None, None, "unsupported_type"),
    (13, "lost", "Lost", "categorical_single", None, None, None, "missing_categories"), (14, "away", "Away", "categorical_single", None, None, None, "missing_categories"),
])
def workbook_variables(spark):
    codes = F.array_join(F.sort_array(F.transform("categories", lambda c: c["code"])), ",")
    return _form(spark)["variables"].select("row_no", "raw_name", "label", "data_type", "module", codes.alias("codes"), "notes", F.array_join("review_reasons", ",").alias("reasons"))


@case("ord int, item string, kind string, parent string, repeat_group string, path string, is_entry boolean", [
    (0, "ENTRY", "entry", None, None, "", False), (1, "own", "question", None, None, "", False), (2, "farm", "section", None, None, "", False), (3, "area", "question", "farm", None, "Farm", True), (4, "crop", "repeat_group", "farm", None, "Farm", False),
    (5, "kind", "question", "crop", "crop", "Farm/crop", True), (6, "thanks", "question", None, None, "", False), (7, "begun", "question", None, None, "", False), (8, "order", "question", None, None, "", False), (9, "lost", "question", None, None, "", False),
    (10, "away", "question", None, None, "", False), (11, "END", "terminal", None, None, "", False),
])
def workbook_items(spark):
    return _form(spark)["items"].select("ord", "item", "kind", "parent", "repeat_group", F.array_join("section_path", "/").alias("path"), "is_entry")


@case("source string, target string, kind string", [
    ("ENTRY", "own", "sequential"), ("own", "farm", "sequential"), ("farm", "area", "unconditional"), ("area", "crop", "sequential"), ("crop", "kind", "unconditional"), ("kind", "thanks", "sequential"), ("thanks", "begun", "sequential"),
    ("begun", "order", "sequential"), ("order", "lost", "sequential"), ("lost", "away", "sequential"), ("away", "END", "sequential"),
])
def workbook_transitions(spark):
    return _form(spark)["transitions"].select("source", "target", "kind")


@case("row_no int, item string, expression string, key string", [(3, "farm", "${own} = 'y'", '{"item":"own","op":"equals","value":{"s":"y","t":"str"}}'), (12, "order", "pulldata('a') = 1 + 2", '{"op":"opaque","raw":"pulldata(\'a\') = 1 + 2"}')])
def workbook_activations(spark):
    return _form(spark)["activations"].select("row_no", "item", "expression", C.condition_key(F.col("condition")).alias("key"))


@case("at string, fault string", [("yn", "repeated_code"), ("gone", "missing_list"), ("file:../x.csv", "unsafe_path"), ("12", "unsupported_type"), ("12", "unsupported_function"), ("12", "unsupported_arithmetic")])
def workbook_faults(spark):
    return _form(spark)["faults"].select("at", "fault")


@case("code string, row_no int", [("unsupported_type", 12), ("unsupported_function", 12), ("unsupported_arithmetic", 12)])
def workbook_diagnostics(spark):
    return _form(spark)["diagnostics"].select("code", "row_no")


@case("survey_id string, title string, language string, country_code string, survey_year int, repeated_settings boolean", [("f1", "Farms", "French", "UNK", 2021, False)])
def workbook_header(spark):
    return _form(spark)["header"].select("survey_id", "title", "language", "country_code", "survey_year", "repeated_settings")


@case("sheet string, row_no int, block_id string, quote string", [("settings", 1, "block-000003", "form_id | form_title | default_language"), ("settings", 2, "block-000003", "f1 | Farms | French")])
def workbook_spans(spark):
    return forms.row_spans(_form(spark)["rows"]).filter("sheet = 'settings'").select("sheet", "row_no", "block_id", "quote")


@case("source string, target string, kind string", [("ENTRY", "own", "sequential"), ("own", "farm", "sequential"), ("farm", "area", "unconditional")])
def form_edges(spark):
    edges = routing.form_graph(_form(spark))["edges"]
    return edges.filter(F.col("source").isin("ENTRY", "own", "farm")).select("source", "target", "kind")


@case("n int, header string", [(1, "label::French (fr)"), (2, "repeat_count"), (3, "list_name"), (4, "")])
def form_headers(spark):
    return _texts(spark, " Label :: French (fr) ", "Repeat-Count", "list  name", "  ").select("n", forms.header_name(F.col("x")).alias("header"))


@case("n int, label string", [(1, "Oui"), (2, "Yes"), (3, "Ja"), (4, None)])
def form_labels(spark):
    rows = frame(spark, "n int, record map<string,string>", [(1, {"label": "Yes", "label::French": "Oui"}), (2, {"label": "Yes", "label::German": "Ja"}), (3, {"label::German": "Ja"}), (4, {"name": "y"})])
    return rows.select("n", forms.preferred_label(F.col("record"), F.lit("French")).alias("label"))


@case("sheet string, fault string", [("survey", "missing:name"), ("survey", "repeated_header")])
def form_header_faults(spark):
    rows = frame(spark, "form_id string, sheet string, row_no int, cells array<string>", [("f", "survey", 1, ["type", "Type", ""]), ("f", "choices", 1, ["list_name", "name"])])
    return forms.header_faults(rows, {"survey": ["type", "name"], "choices": ["list_name", "name"]}).select("sheet", "fault")


@case("row_no int, item string, fault string", [(2, None, "end_without_begin"), (3, None, "missing_name"), (5, "a", "repeated_name"), (8, "g", "end_of_other_kind"), (8, "g", "empty_group"), (None, "h", "begin_without_end")])
def form_nesting_faults(spark):
    lines = [("end group", ""), ("text", ""), ("text", "a"), ("text", "a"), ("text", "b"), ("begin group", "g"), ("end repeat", ""), ("begin repeat", "h"), ("text", "c")]
    rows = frame(spark, "form_id string, sheet string, row_no int, cells array<string>", [("f", "survey", 1, ["type", "name"])] + [("f", "survey", n, list(x)) for n, x in enumerate(lines, 2)])
    return forms.form_items(forms.typed_rows(forms.sheet_records(rows))).filter("fault is not null").select("row_no", "item", "fault")


# --- sources --------------------------------------------------------------------------------------------------------


def package(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in files.items():
            archive.writestr(name, content)
    return out.getvalue()


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_DOCX = package({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Farms</w:t></w:r></w:p><w:sdt><w:sdtContent><w:p><w:r><w:t>Who owns</w:t><w:tab/><w:t>it?</w:t></w:r></w:p></w:sdtContent></w:sdt><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
_FILES = {
    "a.txt": b"\xef\xbb\xbfSECTION A\r\n \r\nfirst line\nsecond\n\n\n\nLAND USE\n\nlast",
    "b.csv": b'code,label\n1,"Yes, all"\n2\n',
    "c.md": b"# Top #\nhello\nthere\n\n| a | b |\n|---|:-:|\n| x \\| y | `p|q` |\n\nend",
    "d.html": b"<title>T</title><h2>Farm</h2><p>who<br>owns</p><script>x</script><table><tr><th>a</th><td>b<table><tr><td>c</td></tr></table></td></tr></table>tail",
    "e.docx": _DOCX,
    "f.xlsx": workbook({"One": [["a", ""], ["", "b"]], "Empty": []}),
    "g.csv": b"",
}


def _files(spark, files: dict[str, bytes]) -> DataFrame:
    return parse_files(frame(spark, "doc_id string, source_name string, content binary", [(n, n, c) for n, c in files.items()]))


@case("source_name string, block_id string, kind string, body string, section string", [
    ("a.txt", "block-000001", "text", "SECTION A", "SECTION A"), ("a.txt", "block-000002", "text", "first line\nsecond", "SECTION A"), ("a.txt", "block-000003", "text", "LAND USE", "LAND USE"), ("a.txt", "block-000004", "text", "last", "LAND USE"),
    ("b.csv", "block-000001", "table", "code | label\n1 | Yes, all\n2", ""),
    ("c.md", "block-000001", "text", "Top", "Top"), ("c.md", "block-000002", "text", "hello\nthere", "Top"), ("c.md", "block-000003", "table", "a | b\nx \\| y | `p\\|q`", "Top"), ("c.md", "block-000004", "text", "end", "Top"),
    ("d.html", "block-000001", "text", "T", ""), ("d.html", "block-000002", "text", "Farm", "Farm"), ("d.html", "block-000003", "text", "who", "Farm"), ("d.html", "block-000004", "text", "owns", "Farm"), ("d.html", "block-000005", "table", "c", "Farm"), ("d.html", "block-000006", "text", "tail", "Farm"),
    ("e.docx", "block-000001", "text", "Farms", "Farms"), ("e.docx", "block-000002", "text", "Who owns\tit?", "Farms"), ("e.docx", "block-000003", "table", "a | b", "Farms"),
    ("f.xlsx", "block-000001", "table", "a | \n | b", "One"),
])
def parsed_sources(spark):
    return _files(spark, _FILES).select("source_name", "block_id", "kind", F.coalesce("text", T.render_table(F.col("table_rows"))).alias("body"), F.array_join("section_path", "/").alias("section"))


_BAD = {
    "1.txt": b"a\0b", "2.txt": b"\xff\xfe", "3.exe": b"MZ", "4.pdf": b"no pdf", "5.pdf": b"%PDF-1.4", "6.xlsx": package({"xl/workbook.xml": "<workbook/>"}), "7.xlsx": b"PK\x03\x04 broken", "8.docx": package({"word/document.xml": "<a/>", "xl/workbook.xml": "<b/>"}),
    "9.xlsx": package({"xl/workbook.xml": "<!DOCTYPE x><workbook/>", "xl/_rels/workbook.xml.rels": "<r/>"}), "10.docx": package({"word/document.xml": "<a/>", "../x": "y"}), "11.csv": b'a,"b', "12.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",
    "13.xlsx": package({"xl/workbook.xml": "<w><sheet name='a' id='r9'/></w>", "xl/_rels/workbook.xml.rels": "<r/>"}),
}


@case("source_name string, fault string", [
    ("1.txt", "SOURCE_FORMAT_INVALID"), ("2.txt", "SOURCE_FORMAT_INVALID"), ("3.exe", "SOURCE_FORMAT_UNSUPPORTED"), ("4.pdf", "SOURCE_FORMAT_INVALID"), ("5.pdf", "SOURCE_DEPENDENCY_MISSING"), ("6.xlsx", "SOURCE_FORMAT_INVALID"),
    ("7.xlsx", "SOURCE_FORMAT_INVALID"), ("8.docx", "SOURCE_FORMAT_AMBIGUOUS"), ("9.xlsx", "SOURCE_UNSAFE"), ("10.docx", "SOURCE_UNSAFE"), ("11.csv", "SOURCE_FORMAT_INVALID"), ("12.doc", "SOURCE_DEPENDENCY_MISSING"), ("13.xlsx", "SOURCE_FORMAT_INVALID"),
])
def source_faults(spark):
    return _files(spark, _BAD).select("source_name", "fault")


@case("n int, cells string", [(1, "a/b"), (2, "x|y/z"), (3, "`p|q`/r")])
def markdown_rows(spark):
    one = F.udf(lambda line: "/".join(parsers.markdown_cells(line)), "string")
    return _texts(spark, "| a | b |", "x \\| y | z".replace(" \\| ", "\\|"), "|`p|q`|r|").select("n", one("x").alias("cells"))


@case("ord int, path string", [(1, "A"), (2, "A/B"), (3, "A/C"), (4, "A/C/D"), (5, "E")])
def heading_stack(spark):
    from tessella.operators import blocks

    rows = frame(spark, "doc_id string, ord int, level int, text string", [("d", 1, 1, "A"), ("d", 2, 2, "B"), ("d", 3, 2, "C"), ("d", 4, 3, "D"), ("d", 5, 1, "E")])
    return blocks.heading_paths(rows, "doc_id", "ord", "level", "text").select("ord", F.array_join("path", "/").alias("path"))


@case("ord int, block_id string, text string", [(0, "block-000001", "a"), (1, "block-000002", "b")])
def numbered_blocks(spark):
    from tessella.operators import blocks

    rows = frame(spark, "doc_id string, ord int, text string", [("d", 3, "a"), ("d", 5, " \n"), ("d", 6, None), ("d", 9, "b")])
    return blocks.number_blocks(rows, "doc_id", "ord").select("ord", "block_id", "text")


def pdf(*pages: str) -> bytes:
    """A PDF file of pages with these content streams."""
    kids = " ".join(f"{3 + 2 * n} 0 R" for n in range(len(pages)))
    parts = ["1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", f"2 0 obj << /Type /Pages /Kids [{kids}] /Count {len(pages)} >> endobj"]
    for n, page in enumerate(pages):
        parts += [f"{3 + 2 * n} 0 obj << /Type /Page /Parent 2 0 R /Contents {4 + 2 * n} 0 R >> endobj", f"{4 + 2 * n} 0 obj << /Length {len(page)} >> stream\n{page}\nendstream endobj"]
    return ("%PDF-1.4\n" + "\n".join(parts)).encode("cp1252")


@case("source_name string, block_id string, body string, page int, fault string", [
    ("a.pdf", "block-000001", "Who owns (it)?", 1, None), ("a.pdf", "block-000002", "Yes", 1, None), ("a.pdf", "block-000003", "Né", 2, None), ("b.pdf", None, None, None, "SOURCE_DEPENDENCY_MISSING"), ("c.pdf", None, None, None, "SOURCE_ENCRYPTED"),
])
def parsed_pages(spark):
    one, two = "BT /F1 12 Tf 72 700 Td (Who owns \\(it\\)?) Tj 0 -14 Td [(Y) -20 (es)] TJ ET", "BT 72 700 Td <4EE9> Tj ET"
    files = {"a.pdf": pdf(one, two), "b.pdf": pdf("q Q"), "c.pdf": b"%PDF-1.4 trailer << /Encrypt 5 0 R >>"}
    return _files(spark, files).select("source_name", "block_id", F.col("text").alias("body"), "page", "fault")


@case("n int, kind string, body string, page int, section string", [(1, "text", "One", 1, "One"), (2, "text", "- item", 1, "One"), (3, "text", "Sub", 2, "One/Sub"), (4, "table", "a.x | b\n1 | 2", 2, "One/Sub"), (5, "text", "Two", 3, "Two")])
def page_layout(spark):
    cell = lambda row, column, text, head=False: {"row": row, "column": column, "text": text, "is_header": head}
    items = [
        (1, [{"kind": "heading", "text": "One", "level": 1}, {"kind": "list", "text": "item", "marker": "-"}, {"kind": "furniture", "text": "7"}, {"kind": "text", "text": "  "}]),
        (2, [{"kind": "heading", "text": "Sub", "level": 2}, {"kind": "table", "cells": [cell(0, 0, "a", True), cell(0, 1, "b", True), cell(1, 0, "x", True), cell(2, 0, "1"), cell(2, 1, "2")]}]),
        (3, [{"kind": "heading", "text": "Two", "level": 1}]),
    ]
    rows = [(n, b["kind"], b["text"], b["rows"], b["page"], "/".join(b["section"])) for n, b in enumerate(pages.layout_blocks(items), 1)]
    made = frame(spark, "n int, kind string, text string, table_rows array<array<string>>, page int, section string", rows)
    return made.select("n", "kind", F.coalesce("text", T.render_table(F.col("table_rows"))).alias("body"), "page", "section")


@case("total int, converted string, failed string", [(4, "1,3", "2,4")])
def page_coverage(spark):
    def convert(content, number, options):
        if number == 2:
            raise RuntimeError("no page")
        return [{"kind": "text", "text": str(number)}]

    ticks = iter([0.0, 0.0, 1.0, 2.0, 99.0])
    _, told = pages.convert_pages(b"", 9, convert, pages.PageOptions(first_pages=4, deadline=9.0, partial_on_deadline=True), lambda: next(ticks))
    join = lambda k: ",".join(map(str, told[k]))
    return frame(spark, "total int, converted string, failed string", [(told["total_units"], join("converted_units"), join("failed_units"))])


@case("bundle_id string, digest string", [(b, hashlib.sha256(text.encode()).hexdigest()) for b, text in (("one", "6:a.xlsx:3:aa\n5:b.csv:2:bb\n7:c/d.csv:1:cc"), ("two", "6:a.xlsx:3:aa"))])
def bundle_digests(spark):
    rows = [("one", "c/d.csv", False, 1, "cc"), ("one", "a.xlsx", True, 3, "aa"), ("one", "b.csv", False, 2, "bb"), ("two", "a.xlsx", True, 3, "aa")]
    return reader.bundle_digests(frame(spark, "bundle_id string, path string, is_primary boolean, n_bytes long, sha256 string", rows))


@case("doc_id string, fault string", [("b", "digest"), ("c", "missing_document"), ("d", "media_type"), ("d", "source_name"), ("e", "digest"), ("f", "version"), ("g", "source_format")])
def binding_checks(spark):
    schema = "doc_id string, source_name string, media_type string, snapshot_sha256 string"
    documents = frame(spark, schema, [(x, f"{x}.csv", "text/csv", None if x == "e" else "s") for x in "abdefg"])
    told = [("a", "a.csv", "text/csv", "csv", "s", "1.0"), ("b", "b.csv", "text/csv", "csv", "t", "1.0"), ("c", "c.csv", "text/csv", "csv", "s", "1.0"), ("d", "x.csv", "text/plain", "csv", "s", "1.0"), ("e", "e.csv", "text/csv", "csv", None, "1.0"), ("f", "f.csv", "text/csv", "csv", "s", "0.9"), ("g", "g.csv", "text/csv", "txt", "s", "1.0")]
    bindings = frame(spark, "doc_id string, source_name string, media_type string, source_format string, snapshot_sha256 string, version string", told)
    return validate.binding_faults(bindings, documents)


# --- chunks ---------------------------------------------------------------------------------------------------------


@case("n int, piece string", [(1, "ab "), (2, "cde "), (3, "éé"), (4, "éf")])
def split_texts(spark):
    pieces = F.udf(lambda t: K.split_text(t, 5), "array<string>")
    return _texts(spark, "ab cde ééééf".replace("éééé", "ééé")).select(F.posexplode(pieces("x")).alias("at", "piece")).select((F.col("at") + 1).alias("n"), "piece")


@case("part int, text string, row_start int, row_end int, columns string", [(1, "h | k\na | b", 2, 2, "0,1"), (2, "h | k\nc | d", 3, 3, "0,1")])
def split_table_rows(spark):
    kind = "array<struct<text string, row_start int, row_end int, columns array<int>>>"
    cut = F.udf(lambda rows: [(K._rendered(p["rows"]), p["row_start"], p["row_end"], p["columns"]) for p in K.split_table(rows, 14, 12)], kind)
    rows = frame(spark, "x array<array<string>>", [([["h", "k"], ["a", "b"], ["c", "d"]],)])
    return rows.select(F.posexplode(cut("x")).alias("at", "p")).select((F.col("at") + 1).alias("part"), "p.text", "p.row_start", "p.row_end", F.array_join("p.columns", ",").alias("columns"))


@case("n int, text string", [(1, "h | k\na | b"), (2, "h | k\nc | d"), (3, "h\na"), (4, "k\nb"), (5, "on"), (6, "e x")])
def halved_parts(spark):
    def halves(rows, text):
        part = {"block_id": "b", "kind": "table" if rows else "text", "text": text, "size": 9, "n_columns": None, "rows": rows}
        return [p["text"] for p in K.halve_part(part)]

    rows = frame(spark, "n int, rows array<array<string>>, text string", [(1, [["h", "k"], ["a", "b"], ["c", "d"]], None), (2, [["h", "k"], ["a", "b"]], None), (3, None, "one x")])
    cut = rows.select("n", F.posexplode(F.udf(halves, "array<string>")("rows", "text")).alias("at", "text"))
    return cut.select((2 * (F.col("n") - 1) + F.col("at") + 1).alias("n"), "text")


@case("node_id string, chunk_no int, before string, after string", [("a", 0, None, "c"), ("b", 0, None, "c"), ("c", 1, "b", "f"), ("d", 1, "b", "f"), ("e", 1, "b", "f"), ("f", 2, "e", None), ("g", 2, "e", None)])
def region_parts(spark):
    items = [("a", "s", None), ("b", "s", None), ("c", "t", None), ("d", "t", None), ("e", "t", None), ("f", "t", None), ("g", "t", "r")]
    inventory = frame(spark, "doc string, source_order int, node_id string, section string, repeat_group string", [("d", n, *x) for n, x in enumerate(items)])
    chunks = regions.region_chunks(inventory, ["doc"], 3)
    sides = regions.boundaries(chunks.join(inventory.select("doc", "node_id", "source_order"), ["doc", "node_id"]), ["doc"])
    return chunks.join(sides, ["doc", "chunk_no"]).select("node_id", "chunk_no", "before", "after")


@case("slice_id int, text string", [(1, "x\n\ny"), (2, "y")])
def slice_texts(spark):
    slices = frame(spark, "doc string, slice_id int, block_ids array<string>", [("d", 1, ["b2", "b1"]), ("d", 1, ["b1"]), ("d", 2, ["b2", "gone"])])
    blocks = frame(spark, "doc string, block_id string, ord int, text string", [("d", "b1", 0, "x"), ("d", "b2", 1, "y"), ("d", "b3", 2, "z")])
    return regions.source_texts(slices, blocks, ["doc"]).select("slice_id", "text")


@case("target string, node_id string, why string, place int", [("e", "d", "preceding", 0), ("e", "c", "preceding", 1), ("e", "b", "preceding", 2), ("e", "a", "section_end", 3)])
def relevant_context(spark):
    items = [("a", "s"), ("b", "t"), ("c", "t"), ("d", "u"), ("e", "u")]
    inventory = frame(spark, "doc string, source_order int, node_id string, section string", [("d", n, *x) for n, x in enumerate(items)])
    return regions.relevant_items(inventory, inventory.filter("node_id = 'e'").select("doc", "node_id"), ["doc"]).select("target", "node_id", "why", "place")


# --- references and claims ------------------------------------------------------------------------------------------


@case("span_id string, fault string", [("ok", None), ("row", None), ("gone", "missing_block"), ("page", "other_page"), ("range", "row_range"), ("quote", "not_found")])
def quote_checks(spark):
    blocks = frame(spark, "doc_id string, block_id string, page int, pages array<int>, text string, table_rows array<array<string>>", [("d", "b1", 1, [1, 2], "Who  owns\nthe ﬁeld?", None), ("d", "b2", 3, None, None, [["a", "b"], ["c", "d"]])])
    rows = [("ok", "b1", 2, None, None, "owns the field"), ("row", "b2", 3, 2, 2, "C | d"), ("gone", "b9", None, None, None, "x"), ("page", "b1", 7, None, None, "who"), ("range", "b2", 3, 2, 5, "c"), ("quote", "b2", 3, 1, 1, "c | d")]
    spans = frame(spark, "doc_id string, span_id string, block_id string, page int, row_start int, row_end int, quote string", [("d", *r) for r in rows])
    return resolve.check_quotes(spans, blocks).select("span_id", F.col("quote_fault").alias("fault"))


@case("line_id int, variable_id int", [(1, 10), (3, 12)])
def matched_lines(spark):
    lines = frame(spark, "doc string, line_id int, printed string, text string", [("d", 1, " Q1 ", "other"), ("d", 2, "x", "who pays"), ("d", 3, "", "who owns"), ("d", 4, "", "who eats"), ("d", 5, "", "who eats")])
    variables = frame(spark, "doc string, variable_id int, name string, label string, question string", [("d", 10, "q1", "", ""), ("d", 11, "q2", "who pays", ""), ("d", 12, "q3", "", "who owns"), ("d", 13, "q4", "who pays", ""), ("d", 14, "q5", "who eats", "")])
    return resolve.line_matches(lines, variables, ["doc"]).select("line_id", "variable_id")


@case("n int, text string", [(1, "who pays"), (2, "q. 1")])
def printed_texts(spark):
    return _texts(spark, "Who  PAYS.:", "Q. 1").select("n", resolve.printed_text(F.col("x")).alias("text"))


@case("evidence_id string, fault string", [("e1", "transition_ends"), ("e2", "activation_item"), ("e3", "native_origin"), ("e4", "confidence"), ("e5", "quote"), ("e6", "type"), ("e7", "transition_item")])
def evidence_shapes(spark):
    good = {"evidence_type": "transition", "kind": "sequential", "source": "a", "target": "b", "item": None, "condition": None, "origin": "text", "native_expression": None, "confidence": 0.9, "quote": "go to b"}
    changes = [{"target": " "}, {"evidence_type": "activation", "target": None}, {"origin": "native"}, {"confidence": 1.5}, {"quote": None}, {"evidence_type": "x"}, {"item": "c"}, {}]
    schema = "evidence_id string, evidence_type string, kind string, source string, target string, item string, condition string, origin string, native_expression string, confidence double, quote string"
    return validate.evidence_faults(frame(spark, schema, [(f"e{n}", *(good | c).values()) for n, c in enumerate(changes, 1)]))


@case("edge_id string, fault string", [("a", "condition"), ("b", "condition"), ("c", "priority"), ("d", "kind"), ("e", "ends")])
def edge_shapes(spark):
    rows = [("a", "conditional", "x", "y", None, None), ("b", "default", "x", "y", "{}", None), ("c", "default", "x", "y", None, -1), ("d", "jump", "x", "y", None, None), ("e", "default", "x", "", None, None), ("f", "conditional", "x", "y", "{}", 0)]
    return validate.edge_faults(frame(spark, "edge_id string, kind string, source string, target string, condition string, priority int", rows))


@case("node string, fault string", [("a", "kind"), ("b", "terminal_kind"), ("c", "terminal_kind"), ("d", "children")])
def node_shapes(spark):
    rows = [("a", "page", None, 0), ("b", "terminal", None, 0), ("c", "question", "end", 0), ("d", "question", None, 2), ("e", "section", None, 2), ("f", "terminal", "end", 0)]
    return validate.node_faults(frame(spark, "node string, kind string, terminal_kind string, n_children int", rows))


@case("chunk_id string, fault string", [("b", "pass"), ("c", "examined"), ("d", "local_id"), ("e", "activation_in_forward"), ("f", "shape_equals")])
def answer_faults(spark):
    return _batches(spark)[1]


def _batches(spark):
    asked = [("a", "forward", "forward", ["q1", "q2"], ["q1", "q2"]), ("b", "forward", "incoming_activation", ["q1"], ["q1"]), ("c", "forward", "forward", ["q2", "q1"], ["q1", "q2"])] + [(x, "forward", "forward", ["q1"], ["q1"]) for x in "def"]
    batches = frame(spark, "chunk_id string, pass_kind string, asked_pass string, examined array<string>, asked array<string>", asked)
    said = [("a", "1", "transition", None, "q"), ("d", "1", "transition", None, "q"), ("d", "1", "transition", None, "q"), ("e", "1", "activation", None, "q"), ("f", "1", "transition", '{"op":"equals","item":"a"}', "q")]
    evidence = frame(spark, "chunk_id string, local_id string, evidence_type string, condition string, quote string", said)
    return evidence, validate.batch_faults(batches, evidence)


@case("chunk_id string, local_id string", [("a", "1")])
def sound_answers(spark):
    evidence, faults = _batches(spark)
    return validate.sound_batches(evidence, faults).select("chunk_id", "local_id")


@case("diagnostic_id string, code string, is_carried boolean", [("d1", "x", True), ("d2", "y", True), ("d5", "z", False)])
def merged_diagnostics(spark):
    old = frame(spark, "diagnostic_id string, code string", [("d1", "x"), ("d2", "y")])
    new = frame(spark, "diagnostic_id string, code string", [("d1", "z"), ("d3", "x"), ("d5", "z"), ("d5", "z")])
    return validate.merge_diagnostics(old, new)


@case("source string, local_issues string", [("a", "ambiguous_target,opaque_condition"), ("b", "unresolved_target,fuzzy_target,unresolved_condition"), ("c", "unclear_statement,unsupported_inference"), ("d", "")])
def claim_faults(spark):
    schema = "source string, target string, kind string, condition_key string, target_resolution string, source_resolution string, is_fuzzy boolean, is_opaque boolean, is_condition_resolved boolean, is_clear boolean, is_supported boolean"
    rows = [("a", "ambiguous", "resolved", False, False, True, True, True), ("a", "resolved", "resolved", False, True, True, True, True), ("b", "resolved", "unresolved", True, False, False, True, True), ("c", "resolved", "resolved", False, False, True, False, False), ("d", "resolved", "resolved", None, None, None, None, None)]
    told = claims.local_issues(frame(spark, schema, [(s, "t", "default", "null", *x) for s, *x in rows]), [])
    return told.select("source", F.array_join("local_issues", ",").alias("local_issues"))


@case("node string, t string, s string", [("a", "int", "3"), ("a", "str", "1")])
def undeclared_codes(spark):
    values = frame(spark, "node string, t string, s string", [("a", "int", "1"), ("a", "int", "3"), ("a", "str", "1"), ("b", "int", "9")])
    return claims.unknown_codes(values, frame(spark, "node string, t string, s string", [("a", "int", "1"), ("a", "int", "2")]), [])


@case("node string, codes string", [("n1", '[{"pos":1,"code":"a"},{"pos":2,"code":"b"}]')])
def common_codes(spark):
    rows = [("n1", "v1", 1, "a"), ("n1", "v1", 2, "b"), ("n1", "v2", 2, "b"), ("n1", "v2", 1, "a"), ("n2", "v3", 1, "a"), ("n2", "v4", 1, "b")]
    return claims.agreed_codes(frame(spark, "node string, variable string, pos int, code string", rows), [])


@case("edge_id string, confidence double, evidence string, decision_id string, priority int", [("e1", 0.9, "x,y,z", "d2", 1), ("e2", 0.5, "w", None, None)])
def joined_edges(spark):
    rows = [("e1", "a", "b", "default", 1, 0.4, 2, ["y", "z"], "d1", 1), ("e1", "a", "b", "default", 1, 0.9, 1, ["x", "y"], "d2", 2), ("e2", "a", "c", "default", None, 0.5, 3, ["w"], None, None)]
    edges = frame(spark, "edge_id string, source string, target string, kind string, priority int, confidence double, first_pos int, evidence_ids array<string>, decision_id string, decision_ord int", rows)
    return claims.merge_edges(edges, []).select("edge_id", "confidence", F.array_join("evidence_ids", ",").alias("evidence"), "decision_id", "priority")


@case("target string, inference_issue string", [("b", None), ("c", "bypassed_successor"), ("a", "inferred_cycle"), ("d", None)])
def inferred_steps(spark):
    order = frame(spark, "node_id string, source_order int", [("a", 1), ("b", 2), ("c", 3), ("d", 4)])
    successors = frame(spark, "node_id string, successor string", [("a", "b")])
    found = frame(spark, "source string, target string, kind string, is_inferred boolean", [("a", "b", "sequential", True), ("a", "c", "sequential", True), ("a", "a", "sequential", True), ("a", "d", "sequential", False)])
    return claims.inference_issues(found, successors, order, []).select("target", "inference_issue")


@case("node string, reasons string", [
    ("a", "cross_section,cycle"), ("b", "cross_section,branch_target,unusual_out_degree,cycle"), ("c", "ambiguous_target,cross_section,low_confidence,branch_target,unusual_out_degree"), ("d", "ambiguous_target,cross_section,branch_target,unusual_out_degree"), ("x", "unresolved_target,opaque_condition"), ("y", "unresolved_target"),
])
def risky_items(spark):
    inventory = frame(spark, "doc string, node_id string, section string", [("d", n, s) for n, s in (("a", "s"), ("b", "t"), ("c", "s"), ("d", "s"), ("x", "s"), ("y", "s"), ("z", "s"))])
    rows = [(1, "a", ["b"], False, 0.9), (2, "b", ["a"], False, 0.9), (3, "a", ["c"], False, 0.5), (4, "a", ["d"], False, 0.9), (5, "b", ["c", "d"], False, 0.9), (6, "x", [], True, 0.9), (7, None, [], False, 0.9)]
    moves = frame(spark, "doc string, move_id int, source string, targets array<string>, is_opaque boolean, confidence double", [("d", *r) for r in rows])
    told = risks.select_targets(moves, inventory, ["doc"], frame(spark, "doc string, node string", [("d", "y")]))
    return told.select("node", F.array_join("reasons", ",").alias("reasons"))


# --- review ---------------------------------------------------------------------------------------------------------


def _audit(spark):
    candidates = frame(spark, "candidate_id string, evidence_ids array<string>, source string, target string, status string", [("c1", ["e1", "e9"], "a", "b", "needs_human_review"), ("c2", ["e2"], "a", "c", "needs_agent_review"), ("c3", ["e3"], "c", "d", "needs_agent_review")])
    found = frame(spark, "survey_id string, discrepancy_id string, ord int, candidate_ids array<string>, evidence_ids array<string>, span_ids array<string>", [("s", "x1", 1, ["c1", "c2"], ["e1"], ["p1"]), ("s", "x2", 2, ["c3", "c8"], ["e3"], ["p7"])])
    decisions = frame(spark, "decision_id string, ord int, action string, candidate_ids array<string>, discrepancy_ids array<string>, supersedes string", [("k1", 1, "confirm", ["c1"], ["x1"], None), ("k2", 2, "reject", ["c1"], ["x1"], "k1"), ("k3", 3, "replace", ["c2"], ["x9"], None), ("k4", 4, "reject", ["c3"], [], "k3")])
    evidence = frame(spark, "evidence_id string, span_id string", [("e1", "p1"), ("e2", "p2"), ("e3", "p5")])
    spans = frame(spark, "span_id string", [("p1",), ("p2",)])
    return candidates, found, decisions, evidence, spans


@case("owner string, owner_id string, what string, missing string", [("candidate", "c1", "evidence", "e9"), ("discrepancy", "x2", "candidate", "c8"), ("discrepancy", "x2", "span", "p7"), ("decision", "k3", "discrepancy", "x9"), ("evidence", "e3", "span", "p5")])
def audit_references(spark):
    return review.audit_faults(*_audit(spark))


@case("decision_id string, fault string", [("k4", "other_candidates")])
def supersession_checks(spark):
    return review.supersession_faults(_audit(spark)[2])


@case("candidate_id string, status string", [("c1", "rejected"), ("c2", "needs_agent_review"), ("c3", "rejected")])
def candidate_states(spark):
    candidates, _, decisions, _, _ = _audit(spark)
    return review.candidate_status(candidates, decisions).select("candidate_id", "status")


@case("discrepancy_id string, is_resolved boolean", [("x1", False), ("x2", False), ("x3", True)])
def settled_discrepancies(spark):
    candidates, found, decisions, _, _ = _audit(spark)
    more = found.unionByName(frame(spark, "survey_id string, discrepancy_id string, ord int, candidate_ids array<string>, evidence_ids array<string>, span_ids array<string>", [("s", "x3", 3, ["c1", "c3"], [], [])]))
    return review.resolve_discrepancies(more, review.candidate_status(candidates, decisions)).select("discrepancy_id", "is_resolved")


@case("source string, target string, origin string, decision_id string", [("p", "q", "accepted", None), ("a", "b", "confirmed", "k5"), ("a", "z", "replacement", "k6")])
def edges_after_review(spark):
    candidates, _, _, _, _ = _audit(spark)
    decisions = frame(spark, "decision_id string, ord int, action string, candidate_ids array<string>, supersedes string", [("k5", 1, "confirm", ["c1"], None), ("k6", 2, "replace", ["c2"], None), ("k7", 3, "confirm", ["c3"], None), ("k8", 4, "reject", ["c3"], "k7")])
    put = frame(spark, "decision_id string, source string, target string", [("k6", "a", "z"), ("k9", "no", "no")])
    return review.reviewed_edges(frame(spark, "source string, target string", [("p", "q")]), candidates, decisions, put).select("source", "target", "origin", "decision_id")


@case("discrepancy_id string, packet int", [("x1", 0), ("x2", 0), ("x3", 1)])
def review_packets(spark):
    rows = [("s", "x1", 1, ["c1"]), ("s", "x2", 3, ["c1", "c2"]), ("s", "x3", 2, ["c9"])]
    return review.packets(frame(spark, "survey_id string, discrepancy_id string, ord int, candidate_ids array<string>", rows), most=2).select("discrepancy_id", "packet")


@case("what string, id string", [("discrepancy", "x1"), ("candidate", "c1"), ("candidate", "c2"), ("evidence", "e1"), ("evidence", "e9"), ("evidence", "e2"), ("span", "p1"), ("span", "p2"), ("node", "a"), ("node", "b"), ("node", "c")])
def packet_contents(spark):
    candidates, found, _, evidence, _ = _audit(spark)
    placed = frame(spark, "survey_id string, discrepancy_id string, packet int", [("s", "x1", 0)])
    return review.packet_closure(placed, found, candidates, evidence).select("what", "id")


@case("answer_id string, fault string", [("r2", "candidate"), ("r3", "evidence"), ("r3", "span"), ("r4", "nothing_cited"), ("r5", "action"), ("r5", "packet"), ("r5", "candidate"), ("r5", "discrepancy")])
def review_citations(spark):
    candidates, _, _, evidence, _ = _audit(spark)
    packets = frame(spark, "packet int, discrepancy_ids array<string>, candidate_ids array<string>", [(0, ["x1"], ["c1", "c2"])])
    rows = [("r1", 0, "confirm", ["x1"], ["c1"], ["e1"], ["p1"]), ("r2", 0, "reject", ["x1"], ["c3"], ["e3"], ["p5"]), ("r3", 0, "reject", ["x1"], ["c1"], ["e2"], ["p9"]), ("r4", 0, "reject", ["x1"], ["c1"], [], []), ("r5", 7, "maybe", ["x1"], ["c1"], ["e1"], ["p1"])]
    answers = frame(spark, "answer_id string, packet int, action string, discrepancy_ids array<string>, candidate_ids array<string>, evidence_ids array<string>, span_ids array<string>", rows)
    return review.citation_faults(answers, packets, candidates, evidence)


# --- graphs ---------------------------------------------------------------------------------------------------------

_ARCS = [("e1", "in", "a"), ("e2", "a", "r"), ("e3", "r", "b"), ("e4", "b", "c"), ("e5", "c", "b"), ("e6", "b", "b"), ("e7", "c", "out"), ("e8", "x", "y"), ("e9", "y", "x"), ("e10", "y", "out")]


def _flow(spark):
    rows = [("in", "entry", None, 0, False), ("a", "question", None, 1, False), ("r", "repeat_group", None, 2, False), ("b", "question", "r", 3, True), ("c", "question", "r", 4, False), ("x", "question", None, 5, False), ("y", "question", None, 6, False), ("out", "terminal", None, 7, False)]
    nodes = frame(spark, "node string, kind string, parent string, ord int, is_entry boolean", rows)
    edges = frame(spark, "edge_id string, source string, target string", _ARCS).withColumn("kind", F.when(F.col("edge_id") == "e3", "unconditional").otherwise("sequential"))
    return nodes, edges


@case("component string, n_nodes int", [("b", 2), ("x", 2)])
def cyclic_parts(spark):
    nodes, edges = _flow(spark)
    return graph.cyclic_components(graph.strong_components(nodes, edges), edges)


@case("region string, node string, size int", [("r", "r", 3), ("r", "b", 3), ("r", "c", 3)])
def repeat_regions(spark):
    return graph.declared_regions(_flow(spark)[0])


@case("edge_id string, role string", [("e2", "entry"), ("e3", "internal"), ("e4", "internal"), ("e5", "return"), ("e6", "return"), ("e7", "exit")])
def repeat_edge_roles(spark):
    nodes, edges = _flow(spark)
    return graph.declared_edge_roles(graph.declared_regions(nodes), edges, nodes.select("node", "ord")).select("edge_id", "role")


@case("component string, kind string, has_exit boolean", [("x", "correction_return", True)])
def open_loops(spark):
    nodes, edges = _flow(spark)
    components = graph.strong_components(nodes, edges)
    free = graph.undeclared_components(components, graph.declared_regions(nodes))
    kept = components.join(free, "component", "left_semi")
    return graph.loops(graph.loop_edge_roles(kept, edges, nodes.select("node", "ord")))


@case("node string, n int", [("s", 0)])
def doorless_containers(spark):
    nodes, edges = _flow(spark)
    more = nodes.unionByName(frame(spark, "node string, kind string, parent string, ord int, is_entry boolean", [("s", "section", None, 8, False), ("t", "question", "s", 9, True)]))
    return graph.containers_without_entry(more, edges)


@case("node string, fault string", [("q", "missing_parent"), ("u", "cycle"), ("v", "cycle")])
def containment_checks(spark):
    return graph.containment_faults(frame(spark, "node string, parent string", [("p", None), ("o", "p"), ("q", "gone"), ("u", "v"), ("v", "u")]))


@case("ancestor string, node string, depth int", [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)])
def containment_closure(spark):
    return graph.descendants(frame(spark, "node string, parent string", [("a", None), ("b", "a"), ("c", "b"), ("d", "c")]))


@case("code string, node string", [("unreachable", "x"), ("unreachable", "y"), ("dead_end", "z"), ("unreachable", "z"), ("no_terminal_path", "z"), ("duplicate_edge", "a"), ("several_defaults", "a"), ("dangling_edge", "e4"), ("no_terminal_path", "x"), ("no_terminal_path", "y"), ("loop_without_exit", "x")])
def graph_findings(spark):
    rows = [("in", "entry", None), ("a", "question", None), ("out", "terminal", None), ("x", "question", None), ("y", "question", None), ("z", "question", None)]
    nodes = frame(spark, "doc string, node string, kind string, parent string, ord int, is_terminal boolean", [("d", *r, n, r[1] == "terminal") for n, r in enumerate(rows)])
    arcs = [("e1", "in", "a", "sequential"), ("e2", "a", "out", "default"), ("e3", "a", "out", "default"), ("e4", "a", "gone", "sequential"), ("e5", "x", "y", "sequential"), ("e6", "y", "x", "sequential")]
    edges = frame(spark, "doc string, edge_id string, source string, target string, kind string, condition_key string", [("d", *a, "null") for a in arcs])
    return routing.analyse(nodes, edges, ["doc"]).select("code", "node")


@case("code string, node string, place long", [("duplicate_edge", "a", 1), ("unreachable", "x", 2), ("dead_end", "b", 3), ("dead_end", "c", 4)])
def findings_in_order(spark):
    found = frame(spark, "doc string, code string, node string", [("d", "dead_end", "c"), ("d", "unreachable", "x"), ("d", "dead_end", "b"), ("d", "duplicate_edge", "a")])
    return routing.ordered_findings(found, ["doc"]).select("code", "node", "place")


@case("record_id long, page int, source_page int, sheet string, section string", [(1, 3, 2, None, "A/B"), (2, None, None, "S", "S"), (3, None, None, None, None), (4, None, None, None, None)])
def record_places(spark):
    records = frame(spark, "survey_id string, record_id long, source_block_ids array<string>", [("d", 1, ["b1", "b2"]), ("d", 2, ["b2"]), ("d", 3, []), ("d", 4, ["gone"])])
    blocks = frame(spark, "doc_id string, block_id string, page int, sheet string, section_path array<string>", [("d", "b1", 3, None, ["A", "B"]), ("d", "b2", None, "S", ["S"])])
    told = extraction.with_provenance(records, blocks)
    return told.select("record_id", "prov.page", "source_page", "prov.sheet", F.array_join("prov.section_path", "/").alias("section"))


@case("target string, node_id string, why string", [("e", "d", "preceding"), ("e", "c", "preceding"), ("e", "b", "preceding"), ("e", "a", "section_end"), ("e", "c", "section_end")])
def target_neighbours(spark):
    items = [("a", "s"), ("b", "t"), ("c", "t"), ("d", "u"), ("e", "u")]
    inventory = frame(spark, "doc string, source_order int, node_id string, section string", [("d", n, *x) for n, x in enumerate(items)])
    return review.neighbours_of(inventory.filter("node_id = 'e'"), inventory, ["doc"]).select("target", "node_id", "why")


@case("source int, target int", [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (1, 3)])
def scale_edges(spark):
    return graph.scale_graph(spark, 5, 6)


# --- evaluation and calls -------------------------------------------------------------------------------------------


def _stages(spark):
    node = lambda stage, *names: [(stage, n, k) for n, k in names]
    nodes = frame(spark, "stage string, node string, kind string", node("expected", ("in", "entry"), ("a", "question"), ("out", "terminal")) + node("first", ("in", "entry"), ("a", "question"), ("a", "question"), ("out", "terminal")))
    edges = frame(spark, "stage string, source string, target string, kind string, condition_key string, is_opaque boolean", [
        ("expected", "in", "a", "sequential", "null", False), ("expected", "a", "out", "conditional", "k", False), ("expected", "a", "a", "conditional", "m", False),
        ("first", "in", "a", "sequential", "null", False), ("first", "a", "out", "conditional", "raw", True), ("first", "out", "new", "default", "null", False),
    ])
    loops = frame(spark, "stage string, loop_id string, kind string, members array<string>", [("expected", "l1", "other", ["a"]), ("first", "l2", "other", ["a", "out"])])
    unresolved = frame(spark, "stage string, source string, reference string", [("first", "a", "Q9")])
    return nodes, edges, loops, unresolved


@case("metric string, n_expected long, n_actual long, n_matched long", [("node", 3, 4, 3), ("terminal", 1, 1, 1), ("edge", 3, 4, 1), ("target", 3, 4, 2), ("loop", 1, 1, 0)])
def stage_scores(spark):
    return evaluate.stage_metrics(evaluate.stage_rows(*_stages(spark)), "expected").select("metric", "n_expected", "n_actual", "n_matched")


@case("stage string, n_routes long, unresolved_rate double, opaque_rate double, n_invented long", [("expected", 3, 0.0, 0.0, 0), ("first", 4, 0.25, 1.0, 1)])
def stage_shares(spark):
    nodes, edges, _, unresolved = _stages(spark)
    return evaluate.stage_rates(edges, unresolved, nodes)


@case("stage string, fault string, subject string", [("first", "unknown_end", "new"), ("first", "terminal_leads_on", "out"), ("first", "loop_is_open", "l2")])
def stage_checks(spark):
    nodes, edges, loops, _ = _stages(spark)
    return evaluate.stage_faults(nodes, edges, loops)


@case("metric string, verdict string", [("recall", "passed"), ("precision", "failed"), ("dense", "unavailable")])
def score_gate(spark):
    metrics = frame(spark, "metric string, value double", [("recall", 0.95), ("precision", 0.9)])
    return evaluate.gate(metrics, frame(spark, "metric string, threshold double", [("recall", 0.95), ("precision", 0.95), ("dense", 0.95)])).select("metric", "verdict")


@case("corpus string, recall double, field_accuracy double, dense_recall double", [("c", 0.75, 0.8333, 0.5)])
def recall_scores(spark):
    expected = frame(spark, "corpus string, name string, label string, kind string, dense boolean", [("c", "a", "A", "text", False), ("c", "b", "B", "text", True), ("c", "b", "B", "text", True), ("c", "d", None, "date", False)])
    actual = frame(spark, "corpus string, name string, label string, kind string", [("c", "a", "A", "date"), ("c", "b", "B", "text"), ("c", "d", None, "date"), ("c", "z", "Z", "text")])
    told = evaluate.corpus_recall(expected, actual, ["corpus"], "name", ["label", "kind"], "dense")
    return told.select("corpus", "recall", F.round("field_accuracy", 4).alias("field_accuracy"), "dense_recall")


@case("source_id string, source_path string, output_path string", [("f1", "a.pdf", "a.json")])
def golden_sources(spark):
    rows = [("f1", "source", None, "a.pdf"), ("f2", "output", "f1", "a.json"), ("f3", "source", None, "b.pdf"), ("f4", "output", "f9", "c.json")]
    return evaluate.golden_pairs(frame(spark, "fixture_id string, role string, source_id string, path string", rows))


@case("message string, ok boolean, reason string, tries int", [("good", True, None, 1), ("late", True, None, 2), ("bad", False, "invalid_response", 2), ("cut", False, "truncated", 1), ("no", False, "refused", 1), ("away", False, "transport", 3)])
def scripted_calls(spark):
    E, A = provider.ProviderError, provider.Answer
    script = {"good": [{"n": 1}], "late": [E(provider.TRANSPORT), {"n": 1}], "bad": [{"x": 1}, {"x": 2}], "cut": [A({"n": 1}, finish="length")], "no": [E(provider.REFUSED)], "away": []}
    requests = frame(spark, "message string", [(m,) for m in script]).withColumn("request_sha", provider.request_digest(F.lit("case"), F.col("message")))
    valid = lambda p: None if "n" in p else "no n"
    told = provider.map_requests(requests, provider.scripted_provider(script), valid, provider.Retry(initial=0.0), most_calls=2)
    return told.select("message", "ok", "reason", "tries")


@case("model string, n_calls long, n_tries long, input_tokens long, n_failed long", [("m1", 2, 3, 15, 1), ("m2", 1, 1, 7, 0)])
def call_usage(spark):
    rows = [("m1", True, 1, 5, 2), ("m1", False, 2, 10, 0), ("m2", True, 1, 7, 1)]
    return provider.usage(frame(spark, "model string, ok boolean, tries int, input_tokens long, output_tokens long", rows), ["model"]).select("model", "n_calls", "n_tries", "input_tokens", "n_failed")


@case("code string, subject string, phase int", [("validation_failed", "1", 1), ("low_confidence", "2", 1), ("missing_categories", "3", 1), ("module_reconciled", "4", 1), ("duplicate_raw_name", "q", 2), ("possible_duplicate", "6:7", 3), ("overlap_deduped", "9", 1)])
def policy_findings(spark):
    schema = "survey_id string, record_id long, source_order int, raw_name string, question_text string, label string, data_type string, module string, extraction_confidence double, needs_review boolean, numeric_range struct<min_value double, max_value double, notes string>, categories array<string>, prov struct<page int, sheet string, section_path array<string>>, source_block_ids array<string>, overlap_block_ids array<string>"
    r = lambda n, name, text, kind="text", sure=0.9, span=None, module="M", prov=None, own=(), lap=(): ("s", n, n, name, text, None, kind, module, sure, False, span, None, prov, list(own), list(lap))
    rows = [
        r(1, "a", "one two three", span=(3.0, 1.0, None)), r(2, "b", "four five", sure=0.69), r(3, "c", "six seven", kind="categorical_single"), r(4, "d", "eight nine", prov=(None, None, ["Sec"])), r(5, "q", "ten eleven"),
        r(6, "Q", "who owns the big red farm today"), r(7, "e", "who owns the big red farm today then"), r(8, "f", "twelve words", own=["b1"]), r(9, "f", "twelve words", lap=["b1"]),
    ]
    return quality.policy_diagnostics(frame(spark, schema, rows)).select("code", "subject", "phase")
