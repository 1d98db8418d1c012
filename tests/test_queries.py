"""Registered queries against their SQL on the smallest supplied data (all of them with PLUMBLINE_ALL=1)."""

import os
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
SOME = ["additivity", "fan_out", "keyed_compare_verdict", "orphan_keys", "cross_component", "residual_scan", "check_references", "restored_captures"]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def con():
    import duckdb
    from checks.verify import TABLES
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_sql_has_a_query():
    from checks import QUERIES, SQL
    assert set(SQL) <= set(QUERIES)


def test_queries_match_sql(spark, con):
    from checks import QUERIES, SQL
    from checks.verify import compare
    names = list(QUERIES) if os.environ.get("PLUMBLINE_ALL") else SOME
    wrong = {}
    for name in names:
        verdict, _, _, note = compare(spark, con, name, QUERIES, SQL, SF)
        if verdict not in ("ok", "no-sql"):
            wrong[name] = note
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as entry
    frame = entry.entry(spark)
    assert frame.count() > 0 and "severity_rank" in frame.columns
