"""Operators of the core against brute force and hand-made cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import shape, signal
from pointloom.functions.confidence import combine, confidence
from pointloom.operators import cluster, frames, grid, heavy, knn, learning, near, patches, quality, quantile, regions, rules
from pointloom.operators.graph import components
from pointloom.operators.rank import ranked

POINT = "point_id long, x double, y double, z double, id string, key_a int"


def pts(spark, xyz, ids=None):
    ids = range(1, len(xyz) + 1) if ids is None else ids
    return spark.createDataFrame([(int(i) if i is not None else None, *[None if v is None else float(v) for v in p], "clash", 0) for i, p in zip(ids, xyz)], POINT)


def brute_pairs(xyz, r):
    return {(i + 1, j + 1) for i in range(len(xyz)) for j in range(i + 1, len(xyz)) if np.sqrt(((xyz[i] - xyz[j]) ** 2).sum()) <= r}


def test_near_pairs_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    xyz = np.round(rng.uniform(-5, 5, (400, 3)), 1)
    want = brute_pairs(xyz, 0.7)
    got = near.near_pairs(pts(spark, [*xyz, *xyz[:50]], [*range(1, 401), *range(1, 51)]), 0.7).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(near, "HEAVY_CELL", 20)  # split cells give the same
    got = near.near_pairs(pts(spark, xyz), 0.7).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_pairs_hard_rows(spark):
    bad = [(None, 0, 0), (float("nan"), 0, 0), (0, float("inf"), 0), (0, 0, 0), (0, 0, 0.1)]
    assert [tuple(r) for r in near.near_pairs(pts(spark, bad, [1, 2, 3, 4, 5]), 0.1).collect()] == [(4, 5)]
    assert near.near_pairs(pts(spark, [(0, 0, 0), (0, 0, 0)], [None, 1]), 1).collect() == []
    assert near.near_pairs(pts(spark, []), 1).collect() == []
    with pytest.raises(ValueError):
        near.near_pairs(pts(spark, []), 0)


RING = "poly_id long, ring array<struct<x double,y double>>, holes array<array<struct<x double,y double>>>, extra int"


def polygons(spark, rows):
    real = lambda r: None if r is None else [(float(x), float(y)) for x, y in r]
    return spark.createDataFrame([(k, real(r), None if h is None else [real(x) for x in h], e) for k, r, h, e in rows], RING)


def within(px, py, ring):
    """Even-odd by every edge of the ring."""
    inside = np.zeros(px.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0)):
        if y1 != y2:
            inside ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return inside


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_inside_random_rings_on_the_grid(spark, monkeypatch, seed, broadcast):
    """Rings that cross themselves, with corners on the borders and corners of cells, and holes that cross the ring; both joins."""
    if not broadcast:
        monkeypatch.setattr(near, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(seed)
    rows, want = [], set()
    xy = np.concatenate([rng.integers(-40, 40, (400, 2)) / 4 + [0.11, 0.0], rng.integers(-40, 40, (300, 2)) / 4 + [0.07, 0.13], rng.uniform(-12, 12, (300, 2))])
    for k in range(1, 15):
        scale = rng.choice([1, 2, 8])
        ring = rng.integers(-8 // scale, 8 // scale + 1, (int(rng.integers(3, 12)), 2)) * scale
        holes = [rng.integers(-4, 5, (int(rng.integers(3, 6)), 2)) for _ in range(int(rng.integers(0, 3)))]
        rows.append((k, ring.tolist(), [h.tolist() for h in holes], 0))
        if len(np.unique(ring, axis=0)) < 3:
            continue
        ok = within(xy[:, 0], xy[:, 1], ring.astype(float))
        for h in holes:
            if len(np.unique(h, axis=0)) >= 3:
                ok &= ~within(xy[:, 0], xy[:, 1], h.astype(float))
        want |= {(int(i) + 1, k) for i in np.flatnonzero(ok)}
    # Points on an edge belong to either side: rings and points are compared without them.
    def on_edge(i, k):
        x, y = xy[i - 1]
        for r in [rows[k - 1][1], *rows[k - 1][2]]:
            for (x1, y1), (x2, y2) in zip(r, np.roll(r, -1, 0)):
                if abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-9 and min(x1, x2) - 1e-9 <= x <= max(x1, x2) + 1e-9 and min(y1, y2) - 1e-9 <= y <= max(y1, y2) + 1e-9:
                    return True
        return False

    got = {tuple(r) for r in near.inside(pts(spark, [(*p, 0) for p in xy]), polygons(spark, rows)).collect()}
    assert not [p for p in got ^ want if not on_edge(*p)] and len(got) > 500


def test_a_coast_of_many_corners_is_cut_up(spark):
    """No row of the coverage holds many edges, inner cells are few and large, and the points are right."""
    rng = np.random.default_rng(17)
    a = np.linspace(0, 2 * math.pi, 20_000, endpoint=False)
    r = 5000 + 400 * np.sin(9 * a) + rng.uniform(-3, 3, len(a))
    ring = np.round(np.stack([r * np.cos(a), r * np.sin(a)], 1), 3)
    poly = polygons(spark, [(1, ring.tolist(), None, 0)])
    cells = near.coverage(poly).selectExpr("size(parts) AS n", "coalesce(get(parts, 0).edges, array()) AS e").selectExpr("n", "size(e) AS e").toPandas()
    assert cells["e"].max() <= near.EDGES and (cells["n"] == 0).sum() > 100 and cells["e"].sum() < 8 * len(a)
    xy = rng.uniform(-6000, 6000, (3000, 2))
    got = {r["key_a"] - 1 for r in near.inside(pts(spark, [(*p, 0) for p in xy]), poly).collect()}
    assert got == set(np.flatnonzero(within(xy[:, 0], xy[:, 1], ring)).tolist())


def test_inside_equals_even_odd(spark):
    rng = np.random.default_rng(2)
    star = [(3 * math.cos(a) * (1 + (i % 2)), 3 * math.sin(a) * (1 + (i % 2))) for i, a in enumerate(np.linspace(0, 2 * math.pi, 14, endpoint=False))]
    box = [(-2, -2), (2, -2), (2, 2), (-2, 2)]
    hole = [(-1, -1), (-1, 1), (1, 1), (1, -1)]
    big = [(-400, -300), (500, -300), (500, 600), (-400, 600)]
    polys = [(1, star, None, 0), (2, [*box, box[0]], [hole], 0), (2, [*box, box[0]], [hole], 0), (3, box[::-1] + [box[0], box[0]], [], 0), (4, [(0, 0), (1, 1), (0, 0)], None, 0), (5, None, None, 0), (6, [], [[]], 0), (7, big, [[(0, 0), (1, 0)]], 0)]
    xy = rng.uniform(-7, 7, (1500, 2)) + 0.00137
    got = near.inside(pts(spark, [(*p, 0) for p in xy]), polygons(spark, polys)).collect()
    want = set()
    for k, ring in ((1, star), (2, box), (3, box), (7, big)):
        r = np.array(ring, float)
        ok = within(xy[:, 0], xy[:, 1], r)
        if k == 2:
            ok &= ~within(xy[:, 0], xy[:, 1], np.array(hole, float))
        want |= {(int(i) + 1, k) for i in np.flatnonzero(ok)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_inside_empty(spark):
    none = polygons(spark, [])
    assert near.inside(pts(spark, [(0, 0, 0)]), none).collect() == []
    assert near.inside(pts(spark, []), polygons(spark, [(1, [(0, 0), (1, 0), (1, 1)], None, 0)])).collect() == []


def test_heavy_keys_and_sums(spark):
    rows = [(1, i, "x") for i in range(3000)] + [(2, i, "x") for i in range(1000)] + [(k, 5, "x") for k in range(10, 2000)] + [(None, 7, "x"), (1, None, "x")]
    facts = spark.createDataFrame(rows, "k long, v long, is_heavy2 string")
    dim = spark.createDataFrame([(k, 0) for k in [1, 2, 3, *range(10, 500)]], "k long, n int")
    assert set(heavy.heavy_keys(facts, "k", 0.1)) >= {1, 2}
    got = {r["k"]: r for r in heavy.per_key(facts, dim, "k", {"c": F.count(F.lit(1)), "s": F.sum("v")}, 0.1).collect()}
    assert len(got) == 493 and (got[1]["c"], got[1]["s"], got[1]["is_heavy"]) == (3001, sum(range(3000)), True)
    assert got[3]["c"] is None and got[20]["s"] == 5 and not got[20]["is_heavy"]
    empty = heavy.per_key(facts.limit(0), dim, "k", {"c": F.count(F.lit(1))}, 0.1).collect()
    assert len(empty) == 493 and all(r["c"] is None for r in empty)
    with pytest.raises(ValueError):
        heavy.per_key(facts, dim, "k", {"n": F.count(F.lit(1))}, 0.1)


def test_components(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(7000, 7000), (None, 3), (3, None)]
    low = {}
    for a, b in e:
        if a is not None and b is not None:
            low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(400):
        for a, b in e:
            if a is not None and b is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == low
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ranks(spark):
    df = spark.createDataFrame([("a" if i < 700 else None, i * 7 % 1000) for i in range(1000)], "g string, v long")
    got = ranked(df, ["g"], [F.col("v")], F.floor(F.col("v") / 100)).collect()
    for g in ("a", None):
        own = sorted((r["v"], r["rank0"]) for r in got if r["g"] == g)
        assert [k for _, k in own] == list(range(len(own)))


def test_exact_neighbours_at_any_density(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(size=(500, 3)) * 0.5, rng.uniform(-300, 300, (60, 3)), [[1e5, 1e5, 0.0]]])
    monkeypatch.setattr(knn, "FULL", 100)
    got = {r["point_id"]: r for r in knn.neighbourhoods(pts(spark, xyz), 6, knn.density_measures, "point_density double, mean_distance double, std_distance double, max_distance double, n_2m int, extent double, height_ratio double, vertical_std double").collect()}
    assert len(got) == len(xyz)
    for i in range(len(xyz)):
        d = np.sort(np.sqrt(((xyz - xyz[i]) ** 2).sum(1)))[1:7]
        assert abs(got[i + 1]["mean_distance"] - d.mean()) < 1e-9 and abs(got[i + 1]["max_distance"] - d[-1]) < 1e-9
    few = knn.neighbourhoods(pts(spark, xyz[:3]), 6, knn.covariance_measures, "l1 double, l2 double, l3 double, nx double, ny double, nz double").collect()
    assert len(few) == 3


def test_radius_and_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = rng.uniform(0, 6, (300, 3))
    got = {(r["point_id"], r["nid"]) for r in knn.within_radius(pts(spark, xyz), 1.1).collect()}
    want = brute_pairs(xyz, 1.1)
    assert got == want | {(b, a) for a, b in want}
    for r in knn.nearest_within(pts(spark, xyz), 3, 1.1).collect():
        d = np.sqrt(((xyz - xyz[r["point_id"] - 1]) ** 2).sum(1))
        assert np.argsort(d, kind="stable")[r["rank"]] + 1 == r["nid"]


def test_closed_form_eigenvalues(spark):
    rng = np.random.default_rng(6)
    m = [np.cov(rng.normal(size=(6, 3)).T * rng.uniform(0, 3, (3, 1))) for _ in range(200)] + [np.zeros((3, 3)), np.eye(3)]
    df = spark.createDataFrame([(i, *map(float, (a[0, 0], a[1, 1], a[2, 2], a[0, 1], a[0, 2], a[1, 2]))) for i, a in enumerate(m)], "i int, a double, b double, c double, d double, e double, f double")
    for r in df.select("i", *[c.alias(f"l{k}") for k, c in enumerate(shape.eigenvalues_3x3(*[F.col(x) for x in "abcdef"]))]).collect():
        assert np.allclose([r["l0"], r["l1"], r["l2"]], np.linalg.eigvalsh(m[r["i"]])[::-1], atol=1e-9)


def test_heavy_facts_meet_attributes_of_their_rows(spark):
    rows = [(1, i) for i in range(3000)] + [(i % 50 + 2, i) for i in range(600)] + [(None, 5), (999, 5)]
    facts = spark.createDataFrame(rows, "k long, v long")
    dim = spark.createDataFrame([(i, i * 10, "a") for i in range(1, 60)] + [(1, 7, "b"), (None, 1, "c")], "k long, w long, note string")
    got = {(r["k"], r["note"]): r for r in heavy.per_key(facts, dim, "k", {"c": F.count(F.lit(1)), "above": F.count_if(F.col("v") > F.col("w"))}, 0.1).collect()}
    assert (got[1, "a"]["c"], got[1, "a"]["above"], got[1, "a"]["is_heavy"]) == (3000, 2989, True) and got[1, "b"]["above"] == 2992
    assert got[2, "a"]["c"] == 12 and got[55, "a"]["c"] is None and got[None, "c"]["c"] is None and len(got) == 61
    plan = heavy.with_rows(facts, dim, "k", 0.1)
    assert plan.count() == 3000 * 2 + 600 and "BroadcastHashJoin" in plan._jdf.queryExecution().toString()
    assert {r["k"]: r["n"] for r in heavy.distinct_per_key(facts.withColumn("v", F.col("v") % 7), "k", "v").collect()}[1] == 7
    with pytest.raises(ValueError):
        heavy.with_rows(facts, dim.withColumnRenamed("w", "v"), "k", 0.1)


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(4)
    groups = {"hot": np.round(rng.normal(size=4000) * 40, 2), "one": np.array([3.5]), "same": np.full(500, -1.25), None: rng.uniform(-1, 1, 99)}
    rows = [(k, float(v), 1) for k, g in groups.items() for v in g] + [("hot", None, 1), ("hot", float("nan"), 1), ("hot", float("inf"), 1), ("bad", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    probs = {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.913, "hi": 1.0}
    got = {r["k"]: r for r in quantile.group_quantiles(df, ["k"], "v", probs, 0.5).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        assert got[k]["n"] == len(g) and np.allclose([got[k][p] for p in probs], np.quantile(g, list(probs.values())))
    assert quantile.group_quantiles(df.limit(0), ["k"], "v", probs, 0.5).collect() == []


def test_eigen_measures(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.1), (1.0, 0.95, 0.01), (1e-15, 1e-16, 1e-17), (None, 0.1, 0.1)], "a double, b double, c double")
    rows = df.select(*[v.alias(k) for k, v in shape.eigen_features(F.col("a"), F.col("b"), F.col("c")).items()]).collect()
    assert abs(rows[0]["linearity"] - 0.5) < 1e-12 and abs(rows[0]["planarity"] - 0.4) < 1e-12 and abs(rows[1]["planarity"] - 0.94) < 1e-12
    assert 0 <= rows[2]["linearity"] <= 1 and rows[3]["omnivariance"] is None


def test_heights(spark):
    # Ground at 0 and a building at 5 and 10 over it.
    rows = [(1, "a", 2, 0.0), (2, "a", 2, 0.0), (3, "a", 2, 0.0), (4, "a", 6, 5.0), (5, "a", 6, 10.0), (6, None, 6, 3.0)]
    df = spark.createDataFrame(rows, "point_id long, tile string, classification int, z double")
    out = frames.with_group(df, ["tile"], {"g": F.coalesce(F.min(F.when(F.col("classification") == 2, F.col("z"))), F.min("z"))})
    assert [r["h"] for r in out.select("point_id", (F.col("z") - F.col("g")).alias("h")).orderBy("point_id").collect()] == [0, 0, 0, 5, 10, 0]


def test_feature_repair(spark):
    v = [0.5, 0.7, float("nan"), 0.3, float("inf"), 0.6, float("-inf"), 0.4, None]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = [r[0] for r in df.select(signal.validated(F.col("v"), 0, 1, F.lit(0.5), F.lit(0.2))).collect()]
    assert got == [0.5, 0.7, 0.0, 0.3, 1.0, 0.6, 0.0, 0.4, None]


def test_confidences(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.5, 0.7, 0.9)], "s double")
    get = lambda m, **p: [round(r[0], 6) for r in df.select(confidence(F.col("s"), m, **p)).collect()]
    assert get("binary") == [0, 0, 1, 1, 1] and get("linear", low=0.1, high=0.9) == [0, 0.25, 0.5, 0.75, 1] and get("threshold") == [0, 0, 0.5, 1, 1]
    assert get("sigmoid")[2] == 0.5 and get("gaussian")[2] == 1 and get("linear", low=1.0, high=1.0) == [1] * 5
    a, b = F.col("s"), 1 - F.col("s")
    one = df.select(*[combine({"a": a, "b": b}, m).alias(m) for m in ("weighted", "max", "min", "product", "geometric", "harmonic")]).first()
    assert np.allclose([one["weighted"], one["max"], one["min"], one["product"], one["geometric"], one["harmonic"]], [0.5, 0.9, 0.1, 0.09, 0.3, 0.18])
    for bad in (lambda: confidence(a, "composite"), lambda: combine({}, "max"), lambda: combine({"a": a}, "odd")):
        with pytest.raises(ValueError):
            bad()


def test_rules(spark):
    df = spark.createDataFrame([(1, 0.9, 5), (2, 0.1, 5), (3, None, 5)], "point_id long, v double, c int")
    v = F.col("v")
    r = [rules.Rule("a", v > 0.5, 6, v, 1), rules.Rule("b", v > 0.2, 2, F.lit(0.95), 2), rules.Rule("c", v < 0.2, 3, F.lit(0.3), 0)]
    of = lambda s: [x["label"] for x in rules.apply_levels(df, [(r, s)], "c").orderBy("point_id").collect()]
    assert of("first") == [6, 3, 5] and of("priority") == [2, 3, 5] and of("best") == [2, 3, 5] and of("weighted") == [2, 3, 5]
    long = spark.createDataFrame([(1, 0, 6, 0.4, 9), (1, 1, 2, 0.9, 1), (1, 2, 6, 0.6, 0), (2, 0, 0, 1.0, 1), (2, 1, None, 1.0, 1), (3, 5, 4, 0.2, 1)], "point_id long, source int, label int, confidence double, priority int")
    m = lambda s: {x["point_id"]: x["label"] for x in rules.merge_results(long, s).collect()}
    assert m("highest_confidence") == {1: 2, 3: 4} and m("first")[1] == 6 and m("last")[1] == 6 and m("highest_priority")[1] == 6 and m("weighted_vote")[1] == 6


def test_label_quality(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (3, 1), (None, 1)], "t int, p int")
    c = quality.confusion(df, "t", "p")
    m = {r["label"]: r for r in quality.class_metrics(c).collect()}
    assert (m[2]["precision"], m[2]["recall"], m[3]["f1"], m[3]["iou"]) == (2 / 3, 1.0, 0.0, 0.0)
    a = quality.agreement(c).first()
    po, pe = 3 / 5, (2 * 2 + 2 * 3) / 25
    assert a["n"] == 5 and a["accuracy"] == po and abs(a["kappa"] - (po - pe) / (1 - pe)) < 1e-12
    assert [tuple(r) for r in quality.confused_pairs(c).collect()] == [(1, 2, 1), (1, 3, 1)]
    e = quality.agreement(quality.confusion(df.limit(0), "t", "p")).first()
    assert (e["n"], e["accuracy"], e["kappa"]) == (0, 0.0, 0.0)
    conf = spark.createDataFrame([(0.95, True), (1.0, False), (0.05, False)], "c double, ok boolean")
    bins = quality.calibration(conf, "c", "ok")
    assert {r["bin"]: (r["n"], r["accuracy"]) for r in bins.collect() if r["n"]} == {9: (2, 0.5), 0: (1, 0.0)}
    assert abs(quality.calibration_error(bins).first()["ece"] - (2 * abs(0.5 - 0.975) + 0.05) / 3) < 1e-12


def test_voxels(spark):
    rows = [(1, 0.1, 0.1, 0.1, 5, 1.0), (2, 0.2, 0.3, 0.1, 2, 2.0), (3, 0.3, 0.2, 0.1, 2, None), (4, -0.1, 0.0, 0.0, 9, 1.0), (5, -0.2, 0.0, 0.0, 3, 1.0)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, classification int, intensity double")
    got = {(r["vx"], r["vy"], r["vz"]): r for r in grid.voxel_majority(df, 1.0).collect()}
    assert got[0, 0, 0]["label"] == 2 and got[0, 0, 0]["mean_intensity"] == 1.5 and got[-1, 0, 0]["label"] == 3  # the lowest on ties
    assert {r["n"] for r in grid.voxel_downsample(df, 1.0).collect()} == {3, 2} and grid.voxel_downsample(df.limit(0), 1.0).collect() == []


@pytest.mark.parametrize("least", [1, 2, 6])
def test_dbscan_dense_cells_and_marginal_links(spark, least):
    """Cells with many points, groups linked by one pair only at the very reach, repeated places, points without a place."""
    rng = np.random.default_rng(14)
    xyz = np.concatenate([rng.normal(size=(150, 3)) * 0.1, rng.normal(size=(80, 3)) * 0.1 + [0.9, 0, 0], np.tile([[3.0, 0, 0]], (30, 1)), [[3.6, 0, 0], [4.2, 0, 0], [9, 9, 9]], rng.uniform(-3, 6, (60, 3))])
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)) <= 0.6
    core, n = d.sum(1) >= least, len(xyz)
    low = np.where(core, np.arange(1, n + 1), 10**6)
    for _ in range(n):
        low = np.where(core, np.where(d & core[None], low[None], 10**6).min(1), 10**6)
    want = {i + 1: int(low[i]) if core[i] else int(np.where(d[i] & core, low, 10**6).min()) % 10**6 for i in range(n)}
    rows = [(i + 1, *map(float, v)) for i, v in enumerate(xyz)] + [(5000, None, 0.0, 0.0)]
    got = {r["point_id"]: r["cluster"] for r in cluster.dbscan(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 0.6, least).collect()}
    assert got == want | {5000: 0}


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.normal(size=(60, 3)) * 0.3 + m for m in ([0, 0, 0], [4, 0, 0], [0, 5, 0])] + [rng.uniform(-8, 12, (30, 3))])
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)) <= 0.6
    core = d.sum(1) >= 5
    low = np.where(core, np.arange(1, len(xyz) + 1), 10**6)
    for _ in range(len(xyz)):
        low = np.where(core, np.where(d & core[None], low[None], 10**6).min(1), 10**6)
    want = {i + 1: int(low[i]) if core[i] else int(np.where(d[i] & core, low, 10**6).min()) % 10**6 for i in range(len(xyz))}
    got = {r["point_id"]: r["cluster"] for r in cluster.dbscan(pts(spark, xyz), 0.6, 5).collect()}
    assert got == want and len(set(got.values())) >= 4


def test_patches_and_samples(spark):
    rng = np.random.default_rng(9)
    xy = rng.uniform(0, 50, (800, 2))
    df = spark.createDataFrame([(i, "t", float(a), float(b), 0.0) for i, (a, b) in enumerate(xy)], "point_id long, tile string, x double, y double, z double")
    got = {}
    for r in patches.patch_grid(df, 20.0, 0.1, 30).collect():
        got.setdefault((r["px"], r["py"]), set()).add(r["point_id"])
    lo, hi = xy.min(0), xy.max(0)
    steps = np.ceil((hi - lo) / 18).astype(int)
    want = {}
    for i in range(steps[0]):
        for j in range(steps[1]):
            a = lo + np.array([i, j]) * 18.0
            own = set(np.flatnonzero(((xy >= a) & (xy < a + 20)).all(1)).tolist())
            if len(own) >= 30:
                want[i, j] = own
    assert got == want
    p = patches.patch_grid(df, 20.0, 0.1, 30)
    assert {r["n"] for r in patches.resample(p, ["px", "py"], 150).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n")).collect()} == {150}
    a = patches.augment(p, 1, ["tile", "px", "py"], jitter=0.0, scale=0.0, drop=0.0).where("version = 1").select("point_id", "px", "py", F.hypot("local_x", "local_y").alias("r"))
    b = p.select("point_id", "px", "py", F.hypot("local_x", "local_y").alias("r0"))
    assert a.join(b, ["point_id", "px", "py"]).where(F.abs(F.col("r") - F.col("r0")) > 1e-9).count() == 0  # a turn keeps distances


def test_md5_split(spark):
    names = [f"tile_{i}" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["s"] for r in df.select("n", patches.md5_split(F.col("n"), 42, [("train", 0.8), ("val", 0.1), ("test", 0.1)]).alias("s")).collect()}
    for n in names:
        r = int(hashlib.md5(f"{n}_42".encode()).hexdigest(), 16) % 1_000_000 / 1_000_000
        assert got[n] == ("train" if r < 0.8 else "val" if r < 0.9 else "test")


def test_lines_and_centres(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 5.0, 0.0, 5.5)], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r["point_id"], r["poly_id"]): r["distance"] for r in regions.near_lines(pts(spark, [(5, 0.5, 0), (12, 0, 0), (-0.6, 5.2, 0), (5, 3, 0)]), seg, 2.0).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(1, 1): 0.5, (2, 1): 2.0, (3, 2): 0.6}
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, None, 0.0)], "centre_id long, cx0 double, cy0 double")
    assert {(r["point_id"], r["centre_id"]) for r in regions.nearest_centre(pts(spark, [(1.5, 0, 0), (2, 0, 0), (50, 0, 0)]), c, 5.0).collect()} == {(1, 1), (2, 2)}


def test_discrepancy_and_votes(spark):
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=(400, 2)), rng.normal(size=(300, 2)) + 1
    da, db = (spark.createDataFrame([tuple(map(float, r)) for r in m], "u double, v double") for m in (a, b))
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2) / 2).mean()
    exact = k(a, a) + k(b, b) - 2 * k(a, b)
    assert abs(learning.mean_discrepancy(da, db, ["u", "v"], 2048).first()["mmd"] - exact) < 0.05
    gap = ((np.cov(a.T) - np.cov(b.T)) ** 2).sum() / 16
    assert abs(learning.coral(da, db, ["u", "v"]).first()["coral"] - gap) < 1e-9
    v = learning.vote(spark.createDataFrame([(1, 3), (1, 3), (1, 2), (2, 5), (2, 4), (3, None)], "k int, label int"), "k", "label").collect()
    assert {r["k"]: r["label"] for r in v} == {1: 3, 2: 4}
