"""Every registered query against its DuckDB oracle on the smallest data
set (the driver's gate runs the same comparison at sf0.01)."""
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from leverkit.plans import bindings

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "part", "events", "supplier"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(_norm(r[i]) for i in order)
                                         for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(bindings.QUERIES) == set(bindings.ORACLE)
    assert set(bindings.QUERIES) <= set(E.queries()) and set(bindings.ORACLE) <= set(E.oracle_sql())


def test_entry_without_the_optional_part(monkeypatch):
    monkeypatch.setattr(E, "llm_queries", None)
    assert E.queries() == bindings.QUERIES and E.oracle_sql() == bindings.ORACLE


@pytest.mark.parametrize("name", sorted(bindings.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = bindings.QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(bindings.ORACLE[name])
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _digest(sdf.columns, srows) == _digest(ocols, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "entropy" in df.columns
