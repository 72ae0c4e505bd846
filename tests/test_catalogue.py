"""Each registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import pytest

from chunkloom.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and ours == theirs


def test_entry_works_without_the_optional_parts(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "find_spec", lambda name: None)
    assert set(e.queries()) == set(catalogue.queries()) and set(e.oracle_sql()) == set(SQL)
