"""Every query that SQL can express, against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from stratadoc.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    order = [df.columns.index(c) for c in cols]
    assert sorted([plain(r[i]) for i in order] for r in got) == sorted([plain(v) for v in r] for r in want.fetchall())


def test_import_needs_no_session_and_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
