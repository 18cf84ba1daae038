"""Every registered query with oracle SQL equals DuckDB on the sf0.001 tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return repr(tuple(_norm(x) for x in v))
    if v is None or pd.isna(v):
        return "None"
    if isinstance(v, (bool, np.bool_)):
        return repr(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        f = round(float(v), 6)
        return repr(int(f)) if f.is_integer() else repr(f)
    return repr(v)


def _canon(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(tuple(_norm(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _canon(got) == _canon(want)
