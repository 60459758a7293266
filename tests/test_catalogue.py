"""Every registered query beside its SQL in DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

EVERY = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def canonical(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple("NULL" if pd.isna(x) else repr(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", EVERY)
def test_same_answer_as_sql(spark, sf, db, name):
    got = entry.queries()[name](spark, sf).toArrow().to_pandas()
    want = db.sql(entry.oracle_sql()[name]).arrow()
    want = (want.read_all() if hasattr(want, "read_all") else want).to_pandas()
    assert canonical(got) == canonical(want)


def test_entry_and_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["month", "level", "lat_idx", "lon_idx", "t", "t_std", "u", "u_std"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
