"""Every core query against its SQL on the same tables."""

import duckdb
import pytest

from karst.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(duck.sql(f"select {quoted} from ({queries.ORACLES[name]})").fetchall(), key=str)


def test_matching_saturates_when_each_has_a_token(spark):
    from karst.operators.graph import saturating

    rows = [("a", 1, ["x", "y"]), ("a", 2, ["x"]), ("b", 1, ["x"]), ("b", 2, ["x"]), ("c", 1, ["x", "y"]), ("c", 2, ["y", "z"]), ("c", 3, ["x"])]
    got = {r["market"]: r["saturated"] for r in saturating(spark.createDataFrame(rows, "market string, consumer int, tokens array<string>")).collect()}
    assert got == {"a": True, "b": False, "c": True}
