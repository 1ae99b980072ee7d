import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.operators import forms
from tessella.plans.registry import QUERIES, SQL
from tessella.streaming.landing import run_plan, stream_table

SHEETS = {
    "survey": [
        ["type", "name", "Label", "label::French (fr)", "relevant", "constraint"], ["select_one yn", "own", "Own land?", "Terre ?", "", ""], ["begin group", "g", "Land", "", "", ""], ["begin_repeat", "plot", "Plots", "", "${own} = 'y'", ""],
        ["integer", "area", "Area", "", "", ". > 0"], ["end repeat", "", "", "", "", ""], ["note", "n1", "Thanks", "", "", ""], ["end group", "", "", "", "", ""], ["", "", "", "", "", ""], ["calculate", "calc", "", "", "", ""], ["select_multiple gone", "m", "", "", "count(${own}) > 1", ""], ["odd", "o", "", "", "", ""],
    ],
    "choices": [["list_name", "name", "label"], ["yn", "y", "Yes"], ["yn", "n", "No"], ["yn", "y", "Again"]],
    "settings": [["form_title", "form_id", "default_language"], ["My form", "f-1", "French (fr)"]],
}


def sheet_rows(spark, sheets=SHEETS):
    rows = [("f", s, n, c) for s, rs in sheets.items() for n, c in enumerate(rs, 1)]
    return spark.createDataFrame(rows, "form_id string, sheet string, row_no int, cells array<string>")


def test_form(spark):
    t = {k: v.collect() for k, v in forms.form_tables(sheet_rows(spark), F.lit("2021-05-01").cast("date")).items()}
    items = sorted(t["items"], key=lambda r: r.ord)
    assert [(r.item, r.kind, r.parent, r.repeat_group, r.is_entry) for r in items] == [
        ("ENTRY", "entry", None, None, False), ("own", "question", None, None, False), ("g", "section", None, None, False), ("plot", "repeat_group", "g", None, True), ("area", "question", "plot", "plot", True),
        ("n1", "question", "g", None, False), ("m", "question", None, None, False), ("o", "question", None, None, False), ("END", "terminal", None, None, False),
    ]
    assert {(r.source, r.target, r.kind) for r in t["transitions"]} == {("ENTRY", "own", "sequential"), ("own", "g", "sequential"), ("g", "plot", "unconditional"), ("plot", "area", "unconditional"), ("area", "n1", "sequential"), ("n1", "m", "sequential"), ("m", "o", "sequential"), ("o", "END", "sequential")}
    variables = {r.raw_name: r for r in t["variables"]}
    assert set(variables) == {"own", "area", "calc", "m", "o"}
    assert variables["own"].label == "Terre ?" and [c.code for c in variables["own"].categories] == ["y", "n", "y"] and variables["area"].module == "plot" and variables["area"].notes == "constraint: . > 0"
    assert variables["m"].review_reasons == ["missing_categories"] and variables["o"].review_reasons == ["unsupported_type"] and variables["calc"].data_type == "other"
    assert {r.fault for r in t["faults"]} == {"missing_list", "repeated_code", "unsupported_type", "unsupported_function"}
    assert {r.item: '"opaque"' in r.condition for r in t["activations"]} == {"plot": False, "m": True}
    header = t["header"][0]
    assert (header.survey_id, header.title, header.survey_year, header.country_code) == ("f-1", "My form", 2021, "UNK")


def test_bad_nesting(spark):
    rows = [["type", "name"], ["begin group", "a"], ["begin repeat", "b"], ["text", "x"], ["end group", ""], ["text", "x"], ["text", ""], ["end repeat", ""], ["end group", ""], ["begin group", "c"]]
    typed = forms.typed_rows(forms.sheet_records(sheet_rows(spark, {"survey": rows})))
    assert [r.fault for r in forms.form_items(typed).filter("fault is not null").orderBy("ord").collect()] == ["end_of_other_kind", "repeated_name", "missing_name", "end_of_other_kind", "end_without_begin", "begin_without_end"]
    faults = forms.header_faults(sheet_rows(spark, {"survey": [["type", "Type", "x"]]}), {"survey": ["type", "name"]})
    assert {r.fault for r in faults.collect()} == {"missing:name", "repeated_header"}


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).withColumn("v", F.col("id") % 3).repartition(3).write.parquet(source)
    stream = stream_table(spark, source, spark.read.parquet(source).schema, 1)
    plan = lambda df: df.groupBy("v").count()
    for _ in range(2):
        query = run_plan(stream, plan, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.agg(F.sum("count")).first()[0] == 10 and out.select("batch").distinct().count() == 3


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in SQL:
        result = sql.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, result.fetchall()))
