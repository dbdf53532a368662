"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(AT):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{AT}/{name}'")
    return c


def plain(rows, names, order):
    key = lambda v: (v is not None, type(v).__name__ == "str", v) if not isinstance(v, bool) else (True, False, int(v))
    return sorted((tuple(r[names.index(n)] for n in order) for r in rows), key=lambda r: tuple(map(key, r)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    found = entry.queries()[name](spark, AT)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = sorted(found.columns)
    a, b = plain([tuple(r) for r in found.collect()], found.columns, order), plain(want.fetchall(), want.columns, order)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and math.isclose(p, q, rel_tol=1e-12) for p, q in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
