"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from vitrail.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents pages labels benchmark conversations events orders lineitem customer part supplier nation region").split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name, tmp_path):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/r")
    db.execute(f"create or replace table want as {ORACLE_SQL[name]}")
    db.execute(f"create or replace table got as select * from '{tmp_path}/r/*.parquet'")
    names = lambda t: sorted(x[0] for x in db.execute(f"describe {t}").fetchall())
    assert names("want") == names("got")
    cols = ", ".join(f'"{c}"' for c in names("want"))
    for a, b in (("want", "got"), ("got", "want")):
        assert db.execute(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 13 and set(e.oracle_sql()) <= set(e.queries())
