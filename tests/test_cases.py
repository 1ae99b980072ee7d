import glob
import os

import duckdb
import pytest

from tessella.plans.cases import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_case(spark, sf, name):
    result = duckdb.connect().execute(SQL[name])
    columns = [c[0] for c in result.description]
    out = QUERIES[name](spark, sf)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in out.collect()) == sorted(map(repr, result.fetchall()))


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert glob.glob(os.path.join(os.path.dirname(entry.__file__), "tessella", "plans", "cases.py"))
