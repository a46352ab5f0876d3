"""Every named query on the smallest data, compared with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from foliant.catalog import ORACLES, QUERIES

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for file in Path(data).glob("*.parquet"):
        con.execute(f"create view {file.stem} as from '{file}'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6f}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def table_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(shown(r[i]) for i in at) for r in rows)


def test_the_entry_has_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, data, con, name):
    df = QUERIES[name](spark, data)
    ours = table_of(df.columns, df.collect())
    assert ours[1]
    if name in ORACLES:
        found = con.execute(ORACLES[name])
        assert ours == table_of([d[0] for d in found.description], found.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank_no", "score"] and df.count() > 0
