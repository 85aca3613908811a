"""Every registered query that has SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NA or v != v:
        return "NULL"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)


def rows(df):
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf, name):
    ours, theirs = __spark_entry__.queries()[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
