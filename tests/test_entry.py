import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(float(v), 6) if isinstance(v, float) else v


def table(df, cols):
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, tmp_path, name):
    df = entry.queries()[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    if name in SQL:
        got = duckdb.sql(f"select * from '{tmp_path}/out/*.parquet'").df()
        want = db.sql(SQL[name]).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        assert table(got, cols) == table(want, cols)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
