"""Every registered query against its DuckDB SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from arbor.plans import registry
from arbor.sources.adapter import _TABLES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in _TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = registry.queries()[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_has_rows(spark, name):
    assert registry.queries()[name](spark, D).count() > 0
