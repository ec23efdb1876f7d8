"""Every query with SQL gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from servista.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    data = want.fetchall()
    mine = got.collect()
    assert len(mine) == len(data)
    assert rows(got.columns, mine) == rows(names, data)


def test_initial_load_of_more_than_twenty_chunks(spark, tmp_path):
    spark.range(1000).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "CAST(id % 25 AS int) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["landing_initial_load"])
    names = [c[0] for c in want.description]
    got = QUERIES["landing_initial_load"](spark, str(tmp_path))
    data = want.fetchall()
    assert len(data) == 997 and rows(got.columns, got.collect()) == rows(names, data)
