"""Every query with SQL gives the SQL's rows; the others run and have a schema."""

import duckdb
import pandas as pd
import pytest

from tidemark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind in "fiub":
            df[c] = df[c].astype(float).round(5) + 0.0
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_rows(spark, duck, data, name):
    got = plain(core.QUERIES[name](spark, data).toPandas())
    want = plain(duck.sql(core.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-5)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, data, name):
    assert core.QUERIES[name](spark, data).toPandas().columns.size > 0
