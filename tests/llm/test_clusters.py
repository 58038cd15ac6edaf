import numpy as np

from pointloom.llm import clusters

KIND = "plane_id long, file_id long, point_indices array<int>, normal array<double>, centroid array<double>, key string, vec int"


def planes(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)


def brute(rows, angle, distance, overlap):
    ok = {}
    for i, f, idx, n, c in rows:
        if n and c and len(n) == 3 and len(c) == 3 and np.isfinite(n + c).all() and np.linalg.norm(n) > 0:
            ok[i] = (f, set(idx or []), np.array(n) / np.linalg.norm(n), np.array(c))
    ids = sorted(ok)
    low = {i: i for i in ids}
    linked = set()
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and ok[a][0] == ok[b][0]:
                    (_, sa, na, ca), (_, sb, nb, cb) = ok[a], ok[b]
                    if np.degrees(np.arccos(min(1, abs(na @ nb)))) < angle and np.linalg.norm(ca - cb) < distance and sa | sb and len(sa & sb) >= overlap * len(sa | sb) and sa & sb:
                        linked |= {a, b}
                        low[a] = low[b] = min(low[a], low[b])
    return {i: low[i] for i in linked}


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        f, facet = int(rng.integers(0, 3)), int(rng.integers(0, 8))
        n = np.array([[0, 0, 1], [0, 1, 0.2], [1, 0, 0.5]][facet % 3], float) + rng.normal(size=3) * 0.06
        c = np.array([facet * 1.5, facet % 4, 0.0]) + rng.normal(size=3) * 0.5
        idx = rng.choice(30, 14, replace=False) + 20 * (facet % 4)
        rows.append((i, f, [int(x) for x in idx], [float(x) for x in n * rng.choice([-1, 2])], [float(x) for x in c]))
    got = {r["plane_id"]: r["cluster_id"] for r in clusters.similar_groups(planes(spark, rows), 10, 2, 0.3).collect()}
    want = brute(rows, 10, 2, 0.3)
    assert got == want and len(want) > 20


def test_hard_rows(spark):
    good = (1, 1, [1, 2, 2], [0.0, 0.0, 2.0], [0.0, 0.0, 0.0])
    rows = [good, good, (2, 1, [1, 2], [0.0, 0.0, -1.0], [0.0, 0.0, 1.0]), (3, 1, None, [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]), (4, 1, [1, 2], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]), (5, 1, [1, 2], None, [0.0, 0.0, 0.0]), (6, 1, [1, 2], [0.0, 0.0, 1.0], None)]
    rows += [(7, 2, [1, 2], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]), (8, 1, [1, 2], [float("nan"), 0.0, 1.0], [0.0, 0.0, 0.0]), (9, None, [1, 2], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0])]
    got = clusters.similar_groups(planes(spark, rows), 10, 2, 0.3).collect()
    assert sorted((r["plane_id"], r["cluster_id"]) for r in got) == [(1, 1), (2, 1)]


def test_empty(spark):
    assert clusters.similar_groups(planes(spark, []), 10, 2, 0.3).collect() == []


def test_blocks_of_a_hot_cluster(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    rows = [(i, 1, [1, 2, 3], [0.0, 0.0, 1.0], [0.0, 0.0, 0.001 * i]) for i in range(100)]
    got = clusters.similar_groups(planes(spark, rows), 10, 2, 0.3).collect()
    assert len(got) == 100 and {r["cluster_id"] for r in got} == {0}


def facets(rng, n, spread=8):
    """Planes of a few facets at one place: most share a facet, the others have their own indices."""
    rows = []
    for i in range(n):
        facet = 0 if rng.random() < 0.6 else int(rng.integers(1, spread))
        idx = rng.choice(12, 9, replace=False) + 40 * facet
        rows.append((i, 1, [int(x) for x in idx], [0.0, 0.02 * float(rng.normal()), 1.0], [float(v) for v in rng.normal(size=3) * 0.2]))
    return rows


def test_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 12)
    rows = facets(np.random.default_rng(21), 150)
    got = {r["plane_id"]: r["cluster_id"] for r in clusters.similar_groups(planes(spark, rows), 10, 2, 0.5).collect()}
    want = brute(rows, 10, 2, 0.5)
    assert got == want and len(set(want.values())) > 2


def test_a_hot_cluster_copies_only_what_is_left_over(spark, monkeypatch):
    """Twelve hundred planes of one facet in a hundred blocks: rows are shown to other blocks for the few odd ones only."""
    monkeypatch.setattr(clusters, "BLOCK", 12)
    rows = [(i, 1, [1, 2, 3], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0001 * i]) for i in range(1200)] + [(5000 + i, 1, [900 + i // 2], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]) for i in range(6)]
    shown = []
    between = clusters._between

    def counted(hot, *rest):
        shown.append(hot)
        return between(hot, *rest)

    monkeypatch.setattr(clusters, "_between", counted)
    got = clusters.similar_groups(planes(spark, rows), 10, 2, 0.3).collect()
    assert shown and {r["cluster_id"] for r in got} == {0, 5000, 5002, 5004} and len(got) == 1206
    links = spark.createDataFrame([(0, i) for i in range(1, 1200)], "a long, b long")  # what the blocks and their chain give
    at = clusters._labelled(shown[0], links)
    assert at.where("label <> 0").count() == 6  # only these are copied to the other blocks


def test_tree_keeps_all_mass_and_its_threshold():
    rng = np.random.default_rng(4)
    tree = clusters.CFTree(3, 0.5)
    x = rng.normal(size=(3000, 3))
    for v in x:
        tree.add(1.0, v, float(v @ v))
    n, ls, ss = (np.array(c) for c in zip(*tree.leaves()))
    c = ls / n[:, None]
    assert n.sum() == 3000 and len(n) < 1500 and np.allclose(ls.sum(0), x.sum(0))
    assert (ss / n - (c**2).sum(1) <= 0.25 + 1e-9).all()


def test_a_large_leaf_takes_in_nothing_far_off():
    tree = clusters.CFTree(1, 0.5)
    for v in [0.0] * 10_000 + [5.0]:
        tree.add(1.0, np.array([v]), v * v)
    assert sorted(n for n, _, _ in tree.leaves()) == [1, 10_000]


def test_more_facets_than_any_cap_stay_apart(spark):
    """Seven hundred different facets of one file are seven hundred clusters, on both sides of every cell border."""
    rows = [(i, 1, [i], [0.0, 0.0, 1.0], [6.0 * (i % 30), 6.0 * (i // 30), 0.1 * j]) for i in range(700) for j in (0,)]
    rows += [(10_000 + i, 1, [i], [0.0, 0.0, 1.0], [6.0 * (i % 30), 6.0 * (i // 30), 0.1]) for i in range(700)]
    v, c = clusters.plane_clusters(planes(spark, rows), 10, 2)
    got = clusters.describe(v, c).collect()
    assert len(got) == 700 and {r["size"] for r in got} == {2} and {tuple(sorted(x % 10_000 for x in r["typical"])) for r in got} == {(i, i) for i in range(700)}


def test_clusters_of_planted_facets_are_pure(spark):
    rng = np.random.default_rng(31)
    normals = [[0, 0, 1], [0, 1, 0], [1, 0, 0]]
    rows = []
    for i in range(600):
        f = i % 12
        n = np.array(normals[f % 3], float) + rng.normal(size=3) * 0.02
        rows.append((i, f // 6, [1], [float(x) for x in n * rng.choice([-2, 1])], [float(x) for x in np.array([(f % 6) * 5.0, 15.9, 0.0]) + rng.normal(size=3) * 0.2]))
    v, c = clusters.plane_clusters(planes(spark, rows), 10, 2)
    a = clusters.assign(v.select("plane_id", "key", "vec"), c).select("plane_id", "key", "cid").toPandas()
    a["facet"] = a["plane_id"] % 12
    assert len(a) == 600 and (a.groupby(["key", "cid"])["facet"].nunique() == 1).all()
    assert (a.groupby(["facet", "cid"]).size().groupby("facet").max() >= 45).all()  # of 50


def test_ward_separates_groups():
    rng = np.random.default_rng(5)
    c = np.concatenate([rng.normal(size=(30, 2)) * 0.1 + m for m in ([0, 0], [10, 0], [0, 10])])
    label = clusters.ward(np.ones(90), c, 15.0)
    assert len(np.unique(label)) == 3 and all(len(np.unique(label[i : i + 30])) == 1 for i in (0, 30, 60))


def test_description_counts_every_plane_once(spark):
    rows = [(i, i % 2, [1], [0.0, 0.0, 1.0], [float(i // 20), 0.0, 0.0]) for i in range(80)]
    v, c = clusters.plane_clusters(planes(spark, rows), 10, 2)
    got = clusters.describe(v, c).collect()
    assert sum(r["size"] for r in got) == 80 and all(1 <= len(r["typical"]) <= 3 for r in got)
