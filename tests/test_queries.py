"""Every query against its SQL in DuckDB, over the smallest tables: columns, rows and values."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracefolio.bindings import MODULES

SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", SQL)
def test_against_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(str([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in order]) for r in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["normalized_value"] for r in rows] == sorted((r["normalized_value"] for r in rows), reverse=True)


def test_names_do_not_clash():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES) and set(QUERIES) <= set(entry.queries())
