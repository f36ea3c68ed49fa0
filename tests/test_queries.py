"""Every registered query against its SQL check on the smallest tables."""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from verify import norm

from tidemark.catalog import REGISTRY
from tidemark.registry import BASE_TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    q = REGISTRY[name]
    df = q(spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got
    if q.sql is None:
        return
    res = con.execute(q.sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(norm(row[names.index(c)]) for c in cols) for row in res.fetchall())
