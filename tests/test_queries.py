"""Every registered query against its SQL twin, at the smallest scale."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

from evisim.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
