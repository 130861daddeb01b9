"""Every registered query against its SQL: values must be equal as both engines give them, not only when rounded."""

import math
from collections import Counter

import duckdb
import pytest

from conftest import DATA
from gridspark.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return str(v) if not isinstance(v, (int, str, bool, type(None))) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert df.columns
    if name in ORACLES:
        out = duck.sql(ORACLES[name])
        assert sorted(out.columns) == columns
        place = [out.columns.index(c) for c in columns]
        want = Counter(tuple(plain(r[i]) for i in place) for r in out.fetchall())
        assert got == want, list((got - want).items())[:3] + list((want - got).items())[:3]
