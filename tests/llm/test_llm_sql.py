"""The training-data queries that SQL can express, against that SQL on the same tables."""

import duckdb
import pytest

from karst.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    assert rows == sorted(con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall(), key=str)
