"""Every query of the catalogue against its SQL on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    assert catalogue.FLAGSHIP in catalogue.QUERIES


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert got == want
