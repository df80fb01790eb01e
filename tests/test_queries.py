"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import quantloom.catalogue as q

DATA = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        kinds = {type(v).__name__ for v in df[c]}
        if kinds & {"date", "Timestamp", "datetime"} or str(df[c].dtype).startswith("datetime"):
            df[c] = pd.to_datetime(df[c]).astype(str)
        elif df[c].dtype.kind in "iufb" or kinds <= {"int", "float", "NoneType", "NAType"}:
            df[c] = df[c].astype(float).round(5)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = plain(q.queries()[name](spark, DATA).toPandas()), plain(con.execute(q.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], atol=2e-5, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
