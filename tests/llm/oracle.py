"""A registered llm query against its DuckDB text on the small tables."""
import duckdb

from tests.conftest import SF_SMALL
from tessera.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    df = df.astype(object).where(df.notna(), None)
    return sorted((tuple(r[c] for c in cols) for r in df.to_dict("records")), key=repr), cols


def check_oracle(spark, name, sf=SF_SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = rows(con.execute(ORACLES[name]).df())
    got = rows(QUERIES[name](spark, sf).toPandas())
    assert got == want
    assert got[0]
