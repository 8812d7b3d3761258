"""Every registered query with a SQL form gives the rows that DuckDB gives for it."""

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 2**53 else str(x)
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data, "sf0.01").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, data, name):
    df = QUERIES[name](spark, f"{data}/sf0.01")
    got = table(df.columns, df.collect())
    found = duck.execute(SQL[name])
    want = table([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    assert got[1], "the query gives no rows here"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns
