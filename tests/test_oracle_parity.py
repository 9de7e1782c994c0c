"""Every registered query against its DuckDB oracle on the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from railyard.registry import QUERIES
from tools.compare import TABLES, digest

_SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", sorted(_SQL))
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(_SQL[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_an_oracle():
    assert not set(QUERIES) - set(_SQL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["ticket_ref", "ticket_status", "ticket_price"]
    assert df.count() > 0


@pytest.mark.parametrize("key", ["ticket_report_window", "job_duration", "monthly_report_backfill"])
def test_results_do_not_depend_on_caller_time_zone(spark, key):
    base = sorted(tuple(r) for r in E.queries()[key](spark, SF_SMALL).collect())
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        other = sorted(tuple(r) for r in E.queries()[key](spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert base == other
