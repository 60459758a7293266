"""The SQL of the operators that SQL can express, beside the queries."""

import os

import duckdb
import pytest

from zonalis.llm.queries import ORACLES, QUERIES


def canonical(df):
    return sorted(tuple("NULL" if x is None or x != x else repr(x) for x in r) for r in df.reindex(sorted(df.columns), axis=1).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    got, want = QUERIES[name](spark, sf).toArrow().to_pandas(), con.sql(ORACLES[name]).df()
    assert len(got) and canonical(got) == canonical(want)
