"""The driver's contract: every query runs, and equals its oracle on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from sorrel.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert got == sorted(tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
