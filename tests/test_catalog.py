"""Every registered query against its SQL, over the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from tidelane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, found):
    return sorted((tuple(plain(r[i]) for i in names) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    got = rows(range(len(columns)), df.select(*columns).collect())
    want = rows([found.columns.index(c) for c in columns], found.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(abs(a - b) < 2e-5 * max(1, abs(a)) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(g, w)), (g, w)
