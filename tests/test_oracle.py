"""Every query with SQL, side by side with DuckDB on the same tables."""

import duckdb
import pytest

from lattica.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, rows))
    assert rows
