"""Every named query against its DuckDB equivalent."""

import glob
import math
import os

import duckdb
import pytest

from molframe import catalog

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return plain(tuple(v.values())) if isinstance(v, dict) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert got
    if sql := catalog.oracle_sql().get(name):
        rel = con.execute(sql)
        names = [x[0] for x in rel.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
