"""Every core query over the smallest tables, against DuckDB where it has SQL. Problems' queries of the llm subpackage are tested beside it."""

import glob
import math
import os

import pytest

from threadloom.plans import catalog

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def compare(spark, con, query, sql):
    df = query(spark, ROOT)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    want = sorted("|".join(text(r[i]) for i in at) for r in got.fetchall())
    assert sorted("|".join(map(text, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query, sql = catalog.queries()[name], catalog.oracle().get(name)
    if sql:
        compare(spark, connect(), query, sql)
    else:
        query(spark, ROOT).collect()


def test_every_sql_has_a_query():
    assert set(catalog.oracle()) <= set(catalog.queries())
