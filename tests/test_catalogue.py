"""Every registered query of the core against its SQL in DuckDB, on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from chunkloom.plans import catalogue

#: Queries without SQL that find nothing in the smallest data.
EMPTY = {"import_edges"}
FAST = sorted(n for n in catalogue.QUERIES if n in catalogue.SQL)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck(data):
    import glob
    import os

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    x = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in x.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in x.fetchall()), key=str)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "layers", "place"]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_others_run(spark, data, name):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    assert bool(rows) != (name in EMPTY)
