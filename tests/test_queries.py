"""Every query that has SQL equals it; every other one gives rows."""

import math

import duckdb
import pytest

from driftloom.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert got[1]
    if name in registry.SQL:
        rel = con.sql(registry.SQL[name])
        want = rows_of(rel.fetchall(), rel.columns)
        assert got[0] == want[0] and len(got[1]) == len(want[1])
        assert all(same(x, y) for p, q in zip(got[1], want[1], strict=True) for x, y in zip(p, q, strict=True))
