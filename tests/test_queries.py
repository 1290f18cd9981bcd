"""Queries against DuckDB on the same tables."""

import decimal
import math

import pytest

from catalens import registry

SMALL = "/root/testdata/sf0.001"
# All of them; the driver compares them at sf0.01, too.
NAMES = sorted(registry.ORACLES)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.6g}")
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in cursor.fetchall()], key=repr)


def test_every_query_has_a_name_of_its_own():
    assert len(registry.QUERIES) > 180
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_flagship(spark):
    assert registry.flagship(spark, SMALL).count() > 0
