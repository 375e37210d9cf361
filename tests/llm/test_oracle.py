"""The queries of this package that have SQL give the SQL's rows."""

import duckdb
import pandas as pd
import pytest

from tests.test_oracle import plain
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    got, want = plain(queries.QUERIES[name](spark, data).toPandas()), plain(con.sql(queries.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
