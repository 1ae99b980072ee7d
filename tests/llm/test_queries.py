import glob
import os

import duckdb
import pytest

from tessella.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    expected = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, sf).collect()) == expected


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p6_ids", "p7_containers", "p8_found"])
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_module_has_its_queries():
    assert {f"p{n}" for n in range(1, 9)} == {q.split("_")[0] for q in QUERIES}


def test_found_rows_keep_their_shape(spark, sf):
    kinds = {
        "p2_found": lambda r: r.record_id_a < r.record_id_b,
        "p4_found": lambda r: r.line_no >= 1 and r.noise_kind in ("furniture", "hyphen", "ocr"),
        "p8_found": lambda r: r.doc_form in ("list", "table", "junk"),
    }
    for name, holds in kinds.items():
        rows = QUERIES[name](spark, sf).collect()
        assert len(rows) == len(set(rows)) and all(map(holds, rows)), name


def test_containers_hold_every_text_once_and_none_too_much(spark, sf):
    from pyspark.sql import functions as F

    out = QUERIES["p7_containers"](spark, sf)
    limits = {r.profile_name: r.max_size for r in spark.read.parquet(f"{sf}/size_limits.parquet").filter("used_for = 'packing' and size_unit = 'tokens'").collect()}
    filled = out.groupBy("profile_name", "container_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert filled and all(r.n <= limits[r.profile_name] for r in filled)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.profile_name: r.n for r in out.groupBy("profile_name").agg(F.countDistinct("doc_id").alias("n")).collect()} == dict.fromkeys(limits, n)
