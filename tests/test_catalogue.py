"""Every registered transit query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from loomgrid.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)) if isinstance(v, (str, bool)) else "n", v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(ordered(got), ordered(want)):
        assert a == pytest.approx(b, abs=2e-4) if all(isinstance(v, (int, float)) for v in a) else a == b


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
