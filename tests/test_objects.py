"""Objects, samples, sources and streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import buildings, grid, regions, scales
from pointloom.sources import tiles
from pointloom.streaming import tiles as streaming


def test_hulls_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(x) + 6e5, float(y) + 6e6) for k in range(4) for x, y in rng.normal(size=(300, 2)) * (k + 1)] + [(9, 0.0, 0.0), (9, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    got = {r["k"]: r for r in buildings.hulls(df, "k").collect()}
    for k in range(4):
        xy = np.array([(x - 6e5, y - 6e6) for g, x, y in rows if g == k])
        h = buildings._hull(xy)
        n = np.roll(h, -1, 0)
        area = abs((h[:, 0] * n[:, 1] - n[:, 0] * h[:, 1]).sum()) / 2
        # All points lie within the hull, and the pre-aggregated one is the same.
        assert all(((n - h)[:, 0] * (p[1] - h[:, 1]) - (n - h)[:, 1] * (p[0] - h[:, 0]) >= -1e-9).all() for p in xy)
        assert abs(got[k]["area"] - area) < 1e-6 and got[k]["n"] == 300
    assert got[9]["area"] == 0.0 and buildings.hulls(df.limit(0), "k").collect() == []


def test_farthest_points(spark):
    rows = [("a", i, float(x), 0.0, 0.0) for i, x in enumerate([0, 10, 1, 9, 5])] + [("b", 7, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, point_id long, x double, y double, z double")
    got = buildings.farthest_points(df, ["g"], 3).orderBy("g", "step").collect()
    assert [(r["g"], r["point_id"]) for r in got] == [("a", 0), ("a", 1), ("a", 4), ("b", 7)]


def test_crossings(spark):
    rows = [(1, 0.0, 0.0, 100.0, 100.0), (2, 0.0, 100.0, 100.0, 0.0), (3, 200.0, 0.0, 300.0, 0.0), (4, 0.0, 1.0, 100.0, 101.0)]
    df = spark.createDataFrame(rows, "line_id long, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in buildings.crossings(df).orderBy("line_b").collect()] == [(1, 2, 50.0, 50.0), (2, 4, 49.5, 50.5)]


def test_shift_finds_the_building(spark):
    p = [(float(x), float(y), 6) for x in np.arange(1, 6, 0.5) for y in np.arange(1, 6, 0.5)] + [(0.2, float(y), 2) for y in np.arange(0, 6, 0.5)]
    df = spark.createDataFrame(p, "x double, y double, classification int")
    box = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 500.0, 0.0, 501.0, 1.0)], "box_id long, x0 double, y0 double, x1 double, y1 double")
    got = {r["box_id"]: (r["dx"], r["dy"], r["score"]) for r in buildings.best_shifts(df, box).collect()}
    assert got == {1: (1.0, 1.0, 100.0), 2: (0.0, 0.0, 0.0)}


def test_scales(spark):
    df = spark.createDataFrame([(1.0, 3.0, 0.0, 2.0), (None, 4.0, None, 1.0), (None, None, None, None)], "a double, b double, va double, vb double")
    a, b, va, vb = (F.col(c) for c in df.columns)
    got = df.select(scales.plain_weighted([a, b], [1.0, 3.0]).alias("p"), scales.variance_weighted([a, b], [va, vb], [1.0, 1.0]).alias("v"), scales.disagree([a, b], 0.5).alias("d")).collect()
    assert [r["p"] for r in got] == [2.5, 4.0, None] and abs(got[0]["v"] - 1.5) < 1e-12 and got[1]["v"] == 4.0 and [r["d"] for r in got] == [True, False, False]


def test_gaps_hold_empty_cells(spark):
    df = spark.createDataFrame([("t", 0.5, 0.5, 2), ("t", 9.5, 9.5, 6), ("none", 50.0, 50.0, 2)], "tile string, x double, y double, classification int")
    got = {(r["gx"], r["gy"]) for r in grid.ground_gaps(df, 5.0, 0.03).collect()}
    assert got == {(0, 1), (1, 0), (1, 1)}


def test_tiles_touch(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 100.0, 100.0), ("b", 104.0, 10.0, 200.0, 90.0), ("c", 300.0, 0.0, 400.0, 100.0), ("d", 0.0, 100.0, 100.0, 200.0)], "tile string, x0 double, y0 double, x1 double, y1 double")
    assert {tuple(r) for r in regions.touching_tiles(df).collect()} == {("a", "b"), ("a", "d")}


def test_read_write_and_pushdown(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), 0.0, f"t{i % 3}") for i in range(30)], "point_id long, x double, y double, tile string")
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        tiles.write_points(df, path, fmt)
        back = tiles.read_points(spark, path, (5, -1, 9, 1), ["point_id"], fmt)
        assert sorted(r[0] for r in back.collect()) == [5, 6, 7, 8, 9]
    tiles.write_points(df, str(tmp_path / "by"), by=["tile"])
    plan = tiles.read_points(spark, str(tmp_path / "by"), (5, -1, 9, 1), ["point_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(x,5" in plan
    with pytest.raises(RuntimeError):
        tiles.read_las(spark, ["a.laz"])


def test_schema_decisions(spark):
    df = spark.createDataFrame([(1, 0.0, 0.1, "s")], "point_id long, x double, planarity double, curvature string")
    assert tiles.mode_columns(df, "planes").columns == ["point_id", "x", "planarity"] and tiles.mode_columns(df, "full").columns == df.columns
    assert tiles.reuse_plan(df, ["planarity", "curvature", "nx"]) == {"reuse": ["planarity"], "compute": ["curvature", "nx"]}


def test_manifest_and_registry(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1)], "tile string, version int")
    done = tiles.pending(t.where("tile = 'a'"), spark.createDataFrame([], "tile string, hash string"), "k=10").select("tile", "hash")
    assert [r["tile"] for r in tiles.pending(t, done, "k=10").collect()] == ["b"] and tiles.pending(t, done, "k=20").count() == 2
    f = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (None, 9, "x")], "file_id long, loaded_at long, file_path string")
    assert [(r["file_id"], r["file_path"]) for r in tiles.registry(f).collect()] == [(1, "new")]


def test_geojson(spark):
    kind = "poly_id long, layer string, ring array<struct<x double,y double>>, holes array<array<struct<x double,y double>>>"
    df = spark.createDataFrame([(1, "a", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], None), (2, "b", None, None)], kind)
    got = {r["poly_id"]: json.loads(r["feature"]) for r in tiles.geojson(df, ["layer"]).collect()}
    assert got[1]["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]] and got[2]["geometry"] is None and got[2]["properties"] == {"layer": "b"}


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for i in range(3):
        pd.DataFrame({"point_id": range(i * 10, i * 10 + 10), "tile": f"t{i}", "z": [float(i)] * 10}).to_parquet((src.mkdir(exist_ok=True) or src) / f"{i}.parquet")
    schema = spark.read.parquet(str(src)).schema
    q = streaming.process_stream(streaming.tile_stream(spark, str(src), schema), lambda df: df.groupBy("tile").agg(F.count(F.lit(1)).alias("n")), str(out), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert {(r["tile"], r["n"]) for r in spark.read.parquet(f"{out}/batch=*").collect()} == {("t0", 10), ("t1", 10), ("t2", 10)}


def test_function_per_block(spark):
    df = spark.createDataFrame([("a", float(x), 0.0, float(x)) for x in range(100)], "tile string, x double, y double, z double")
    out = buildings.per_tile(df, lambda p: pd.DataFrame({"tile": [p["tile"].iloc[0]], "n": [len(p)]}), "tile string, n long", size=25.0).collect()
    assert [r["n"] for r in out] == [25] * 4
