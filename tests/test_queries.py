"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from weirgate.plans import registry

from .conftest import DATA


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: "null" if pd.isna(x) else str(round(float(x), 5)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(clean(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
