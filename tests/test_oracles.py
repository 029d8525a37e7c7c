"""Every registered query of the library itself against its SQL twin in DuckDB."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from fusemill import plans, registry  # noqa: F401

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return int(x) if isinstance(x, bool) else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    wrong = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    assert not wrong, wrong[:3]
