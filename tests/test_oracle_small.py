"""Every query with an oracle, compared with DuckDB on sf0.001 (the same
check as the driver's gate: row count, column names, order-insensitive
values)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import digest  # noqa: E402
from clauselake.sources.tables import TABLES  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(entry.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(orows) > 0  # agreeing on nothing says nothing
    assert digest(df.columns, srows)[0] == digest(rel.columns, orows)[0]
