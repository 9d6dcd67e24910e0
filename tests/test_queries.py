"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from millrace.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


def plain(x):
    """A value in a form that both engines share."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, datetime.date) else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"timewrap_days"}))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r.asDict(True)[c]) for c in names)) for r in df.collect())
    told = duck.execute(ORACLES[name])
    own = [x[0] for x in told.description]
    assert sorted(own) == names
    want = sorted(repr(tuple(plain(r[own.index(c)]) for c in names)) for r in told.fetchall())
    assert got == want
