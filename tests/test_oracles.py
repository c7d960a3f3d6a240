"""Every registered query with SQL agrees with DuckDB; the others give rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from stratolab.plans import alignment, catalogue, products, streams, verification

REGISTRIES = [m.R for m in (verification, alignment, products, catalogue, streams)]
QUERIES = {n: q for r in REGISTRIES for n, q in r.queries.items()}
ORACLES = {n: q for r in REGISTRIES for n, q in r.oracles().items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    cursor = con.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert columns == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert rows == want
