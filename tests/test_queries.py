"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from kerbflow.plans import drawings, more, pixels, reached  # noqa: F401
from kerbflow.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return float(v) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    # sorted by what floats cannot change
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=lambda r: repr([round(v, 3) + 0.0 if isinstance(v, float) else v for v in r]))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-6 * max(1, abs(p)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
