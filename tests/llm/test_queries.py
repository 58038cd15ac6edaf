"""Every query of this subpackage on the smallest data: it runs, and equals its SQL where there is some."""

import os

import duckdb
import pytest

from pointloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))
        assert plain(got) == plain(want)


def test_found_columns(spark):
    kinds = {"p1_found": ["point_a", "point_b"], "p2_found": ["plane_id", "cluster_id"], "p3_found": ["file_id", "tile_key"], "p6_found": ["file_id", "point_id"], "p7_found": ["doc_id"], "p8_found": ["source"], "p9_found": ["doc_id"]}
    for name, columns in kinds.items():
        assert QUERIES[name](spark, FOLDER).columns == columns


def test_all_files_have_one_split(spark):
    rows = QUERIES["p3_split"](spark, FOLDER).collect()
    ids = [r["file_id"] for r in rows]
    want = {r[0] for r in spark.read.parquet(f"{FOLDER}/lidar_files.parquet").select("file_id").distinct().collect()}
    assert len(ids) == len(set(ids)) and set(ids) == want
    by = {}
    for r in rows:
        by.setdefault(r["tile_key"], set()).add(r["split_name"])
    assert all(len(s) == 1 for k, s in by.items() if k)
