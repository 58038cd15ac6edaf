"""Every query on the smallest data: it runs, and equals its SQL where there is some."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pointloom import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or type(v).__module__ == "numpy" else str(v)

    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["relation", "key_a", "key_b"]


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, FOLDER).toPandas()
    if name in core.SQL:
        want = duck.sql(core.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
