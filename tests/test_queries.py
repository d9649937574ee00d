"""Every registered query that has SQL equals DuckDB on the smallest tables; the others return rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from lectern.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, float, bool)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    if name not in ORACLE:
        assert got
        return
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert Counter(got) == Counter(tuple(plain(row[i]) for i in order) for row in r.fetchall())
