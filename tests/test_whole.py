"""Queries do the whole job: no radius, sample or window smaller than what is asked."""

import numpy as np
import pytest

from pointloom.operators import buildings, cluster, knn, regions
from pointloom.plans import base, labels, neighbours, objects
from pointloom.runtime import table


@pytest.fixture(scope="module")
def brute(spark, data):
    """The points by id, and for each the 10 nearest others at any distance: rows and distances."""

    def of(df):
        t = df.toPandas().sort_values("point_id").reset_index(drop=True)
        xyz, ids = t[["x", "y", "z"]].to_numpy(), t["point_id"].to_numpy()
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        near = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :10]
        return t, near, np.take_along_axis(d, near, 1)

    return of


def test_nearest_at_any_distance(spark, data, brute):
    t, near, d = brute(base.points(spark, data))
    assert (d[:, 0] > 1.5).any()  # points that no radius of 1.5 m serves
    ids = t["point_id"].to_numpy()
    got = neighbours.nearest(spark, data).toPandas().sort_values(["point_id", "rank"])
    assert (got["point_id"].to_numpy() == np.repeat(ids, 10)).all() and (got["nid"].to_numpy() == ids[near].ravel()).all()
    assert np.allclose(got["d"], d.ravel())


def test_spacing_and_outliers_cover_every_point(spark, data, brute):
    t, _, d = brute(base.points(spark, data))
    m = d.mean(1)
    got = neighbours.local_spacing(spark, data).toPandas().sort_values("point_id")
    assert len(got) == len(t) and (got["n"] == 10).all() and np.allclose(got["mean_distance"], m) and np.allclose(got["std_distance"], d.std(1))
    out = {r["point_id"] for r in neighbours.statistical_outliers(spark, data).collect()}
    assert out == set(t["point_id"][m >= m.mean() + m.std()])


def test_shape_of_every_point(spark, data, brute):
    t, near, _ = brute(base.points(spark, data))
    xyz = t[["x", "y", "z"]].to_numpy()
    got = neighbours.covariance_shape(spark, data).toPandas().sort_values("point_id").reset_index(drop=True)
    assert len(got) == len(t) and (got["n"] == 11).all()
    for i in range(0, len(t), 50):
        e = np.linalg.eigvalsh(np.cov((xyz[[i, *near[i]]] - xyz[i]).T, bias=True))[::-1]
        assert np.allclose(got.loc[i, ["l1", "l2", "l3"]].to_numpy(float), e, rtol=1e-5, atol=1e-4 + 1e-7 * e[0])


def test_labels_features_and_normals_of_every_point(spark, data, brute):
    t, near, _ = brute(base.points(spark, data).where("classification IS NOT NULL"))
    lab = t["classification"].to_numpy(int)
    got = neighbours.label_coherence(spark, data).toPandas().sort_values("point_id")
    share = (lab[near] == lab[:, None]).mean(1)
    most = np.array([np.bincount(v).argmax() for v in lab[near]])
    assert len(got) == len(t) and np.allclose(got["share"], share) and (got["label"].to_numpy() == np.where(share < 0.3, most, lab)).all()

    t, near, _ = brute(base.features(spark, data, "planarity"))
    v, m = t["planarity"].to_numpy(), np.median(t["planarity"].to_numpy()[near], axis=1)
    got = neighbours.smoothed_planarity(spark, data).toPandas().sort_values("point_id")
    assert np.allclose(got["planarity"], np.where(np.abs(v - m) > 0.3, m, v))
    t, near, _ = brute(base.features(spark, data, "nx", "ny", "nz"))
    n = t[["nx", "ny", "nz"]].to_numpy()
    got = neighbours.curvature_from_normals(spark, data).toPandas().sort_values("point_id")
    assert len(got) == len(t) and np.allclose(got["curvature"], np.sqrt(((n[near] - n[:, None]) ** 2).sum(2)).mean(1))


def test_ties_beyond_the_taken_rows_go_to_the_smaller_id(spark):
    rows = [(i, 0.0, 0.0, 0.0) for i in range(40, 0, -1)]
    got = knn.nearest(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 3).where("point_id = 20").orderBy("rank").collect()
    assert [r["nid"] for r in got] == [1, 2, 3]


def test_planes_far_from_their_centroid(spark, data):
    got = {r["point_id"]: (r["plane_id"], r["distance"]) for r in labels.plane_assignment(spark, data).collect()}
    g = table(spark, data, "planes").where("normal IS NOT NULL AND centroid IS NOT NULL").select("plane_id", "file_id", "normal", "centroid").distinct().toPandas().sort_values("plane_id")
    p = base.points(spark, data).select("point_id", "file_id", "x", "y", "z").toPandas()
    want, far = {}, 0
    for f, own in p.groupby("file_id"):
        own_g = g[g["file_id"] == f]
        if not len(own_g):
            continue
        n, c, xyz = np.array(own_g["normal"].tolist()), np.array(own_g["centroid"].tolist()), own[["x", "y", "z"]].to_numpy()
        d = np.abs(((xyz[:, None] - c) * (n / np.linalg.norm(n, axis=1)[:, None])).sum(2))
        best = d.argmin(1)
        for i, k in enumerate(best):
            if d[i, k] <= 0.5:
                want[own["point_id"].iloc[i]] = (own_g["plane_id"].iloc[k], d[i, k])
                far += np.hypot(*(xyz[i] - c[k])[:2]) > 5
    assert far and set(got) == set(want)
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 and (got[i][0] == want[i][0]) for i in want)


def test_plane_of_a_wide_roof(spark):
    roof = spark.createDataFrame([(7, 1, [0.0, 0.0, 2.0], [0.0, 0.0, 10.0])], "plane_id long, file_id long, normal array<double>, centroid array<double>")
    p = spark.createDataFrame([(1, 1, 80.0, -60.0, 10.2), (2, 1, 80.0, -60.0, 10.6), (3, 2, 0.0, 0.0, 10.0)], "point_id long, file_id long, x double, y double, z double")
    assert [(r["point_id"], r["plane_id"]) for r in cluster.nearest_plane(p, roof, 0.5).collect()] == [(1, 7)]


def test_farthest_samples_read_the_whole_patch(spark, monkeypatch):
    rng = np.random.default_rng(3)
    xyz = np.round(rng.uniform(0, 18, (900, 3)), 1)
    p = spark.createDataFrame([(i, "a", *map(float, v)) for i, v in enumerate(xyz)], "point_id long, tile string, x double, y double, z double")
    monkeypatch.setattr(objects, "points", lambda spark, d: p)
    want, d = [0], np.full(len(xyz), np.inf)
    while len(want) < 64:
        d = np.minimum(d, ((xyz - xyz[want[-1]]) ** 2).sum(1))
        d[want] = -1
        want.append(int(d.argmax()))
    got = [r for r in objects.farthest_samples(spark, "").orderBy("px", "py", "step").collect() if (r["px"], r["py"]) == (0, 0)]
    assert [r["point_id"] for r in got] == want


def test_large_patches_in_rounds_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], i, *map(float, v)) for i, v in enumerate(rng.integers(0, 4, (60, 3)))] + [("c", 99, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "g string, point_id long, x double, y double, z double")
    small = {tuple(r) for r in buildings.farthest_points(p, ["g"], 5).collect()}
    monkeypatch.setattr(buildings, "LARGE", 10)
    assert {tuple(r) for r in buildings.farthest_points(p, ["g"], 5).collect()} == small and len(small) == 11


def test_footprints_shift_over_the_whole_window(spark, monkeypatch):
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.uniform([3.5, -4.0], [8.5, 0.5], (150, 2)), np.round(rng.uniform(-8, 14, (250, 2)) * 2) / 2])
    cls = np.array([6] * 150 + [2, 6] * 125)
    p = spark.createDataFrame([(float(x), float(y), int(c)) for (x, y), c in zip(xy, cls)], "x double, y double, classification int")
    boxes = {1: (0.0, 0.0, 5.0, 4.5), 2: (-3.0, -3.5, 1.0, 2.0), 3: (500.0, 0.0, 501.0, 1.0)}
    polygons = spark.createDataFrame([(k, "buildings", *b) for k, b in boxes.items()], "poly_id long, layer string, xmin double, ymin double, xmax double, ymax double")
    monkeypatch.setattr(objects, "points", lambda spark, d: p)
    monkeypatch.setattr(objects, "table", lambda spark, d, name: polygons)
    got = {r["box_id"]: (r["dx"], r["dy"], r["score"]) for r in objects.footprint_shifts(spark, "").collect()}
    gain, want = np.where(cls == 6, 1.0, -1.0), {}
    for k, (x0, y0, x1, y1) in boxes.items():
        scores = []
        for dx in np.arange(-5, 5.1, 0.5):
            for dy in np.arange(-5, 5.1, 0.5):
                held = (xy[:, 0] >= x0 + dx) & (xy[:, 0] <= x1 + dx) & (xy[:, 1] >= y0 + dy) & (xy[:, 1] <= y1 + dy)
                scores.append((-gain[held].sum(), abs(dx) + abs(dy), dx, dy))
        s, _, dx, dy = min(scores)
        want[k] = (dx, dy, -s)
    assert got == want and max(abs(want[1][0]), abs(want[1][1])) > 1


def test_raster_gaps_take_the_nearest_cell_within_reach(spark):
    rng = np.random.default_rng(8)
    cells = {(int(r), int(c)): float(i) for i, (r, c) in enumerate(rng.integers(-15, 15, (25, 2)))}
    xy = rng.uniform(-40, 40, (300, 2))
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id long, x double, y double")
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, value double")
    got = {r["point_id"]: r["value"] for r in regions.sample_raster(p, df, 2.0).collect()}
    want, far = {}, 0
    for i, (x, y) in enumerate(xy):
        own = (int(np.floor(y / 2)), int(np.floor(x / 2)))
        d, _, v = min((np.hypot(x - (c + 0.5) * 2, y - (r + 0.5) * 2), (r, c), v) for (r, c), v in cells.items())
        want[i] = cells[own] if own in cells else v if d <= 10 else None
        far += 4.3 < d <= 10
    assert far and got == want and None in want.values()


@pytest.mark.parametrize("kind", ["mixed", "outliers", "one place", "line", "few"])
def test_tree_search_equals_brute_force(spark, monkeypatch, kind):
    """Uneven densities, points 100 km away, thousands at one place, a line, fewer points than asked for."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(knn, "FULL", 64)
    if kind == "mixed":
        xyz = np.concatenate([rng.normal(size=(700, 3)) * [1, 1, 3], rng.uniform(-300, 300, (120, 3)), rng.normal(size=(300, 3)) * 0.05 + [40, 0, 0]])
    elif kind == "outliers":
        xyz = np.concatenate([rng.normal(size=(500, 3)) * 5, [[1e5, 0, 0], [1e5, 1, 0], [-3e4, 9e4, 0], [2e5, 2e5, 500]]])
    elif kind == "one place":
        xyz = np.concatenate([np.tile([[3.0, 4.0, 5.0]], (700, 1)), np.tile([[3.0, 4.0, 5.5]], (20, 1)), rng.uniform(0, 9, (60, 3))])
    elif kind == "line":
        xyz = np.stack([np.arange(400) * 7.0, np.zeros(400), np.sort(rng.uniform(0, 50, 400))], 1)
    else:
        xyz = rng.normal(size=(5, 3))
    ids = rng.permutation(len(xyz)) + 1
    p = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, xyz)], "point_id long, x double, y double, z double")
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    k = min(10, len(xyz) - 1)
    near = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    got = knn.nearest(p, 10).toPandas().sort_values(["point_id", "rank"])
    want = {int(i): [int(v) for v in ids[n]] for i, n in zip(ids, near)}
    assert {i: list(g["nid"]) for i, g in got.groupby("point_id")} == want


def test_an_outlier_widens_no_leaf(spark):
    """A leaf with its halo sees at most eight times FULL points, wherever the others are."""
    rng = np.random.default_rng(13)
    xyz = np.concatenate([rng.uniform(0, 60, (12_000, 3)), [[1e5, 0, 0], [0, -2e5, 0]]])
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], "point_id long, x double, y double, z double")
    tree = knn._tree(p)
    sizes = [r["count"] for r in knn._seen(p, tree, 10).groupBy("level", "bx", "by").count().collect()]
    assert max(sizes) <= 8 * knn.FULL < len(xyz) and sum(sizes) < 5 * len(xyz)
    got = knn.nearest(p, 3).where("point_id >= 12000").groupBy("point_id").count().collect()
    assert sorted(r["count"] for r in got) == [3, 3]
