"""Every query that has SQL, against DuckDB over the same tables."""

import datetime
import math
import os

import __spark_entry__ as entry
import duckdb
import pytest

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (int, bool)) or type(x).__name__ == "Decimal":
        return str(int(x)) if x == int(x) else f"{float(x):.6g}"
    return str(x) if isinstance(x, datetime.datetime) or x is not None else None


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


QUERIES = entry.queries()
NAMES = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = found.fetchall()
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want)
    assert want


def test_every_query_of_the_catalog_runs(spark):
    for name, f in entry.catalog.QUERIES.items():
        if name not in entry.catalog.SQL:
            assert f(spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
