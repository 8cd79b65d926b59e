"""Queries with a DuckDB twin give the same rows."""

import duckdb
import pytest

from lexloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got, want = queries.queries()[name](spark, data).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    shown = lambda df: sorted(map(str, df[sorted(df.columns)].round(6).itertuples(index=False, name=None)))
    assert shown(got.astype(want.dtypes.to_dict())) == shown(want)
