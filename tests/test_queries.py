"""Every registered query with SQL against DuckDB, and the smoke query."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(None if x != x else x.item() if hasattr(x, "item") else x for x in row)) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    want = con.sql(contract.oracle_sql()[name]).df()
    got = contract.queries()[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
