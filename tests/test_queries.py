"""Every registered query against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from fieldtally.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name in registry.oracle_sql():
        result = duck.sql(registry.oracle_sql()[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    else:
        assert rows


def test_flagship(spark):
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() > 0
