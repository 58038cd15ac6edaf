import numpy as np

from pointloom.llm import vectors
from pointloom.runtime import cut

KIND = "id long, vec array<double>"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], KIND)


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 50
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    v = cut(table(spark, x))
    asked = [int(i) for i in range(0, 6000, 100)]
    found = vectors.neighbours(v, 10, spark.createDataFrame([(i,) for i in asked], "id long"), per_leaf=1000)
    assert vectors.recall(found, v, asked, 10) >= 0.9
    rows = found.collect()
    assert all(r["id"] != r["neighbour"] for r in rows) and len(rows) == 10 * len(asked)


def test_every_vector_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = cut(table(spark, rng.uniform(0, 100, (1500, 3))))
    assert vectors.recall(vectors.neighbours(v, 5), v, list(range(0, 1500, 7)), 5) >= 0.9


def test_copies_ties_and_few_rows(spark):
    v = table(spark, [[0.0, 0.0]] * 3 + [[1.0, 0.0], [0.0, 1.0]])
    got = {(r["id"], r["rank"]): r["neighbour"] for r in vectors.neighbours(v, 3).collect()}
    assert [got[0, r] for r in (1, 2, 3)] == [1, 2, 3]  # ties: the smaller id
    assert len({k for k in got if k[0] == 4}) == 3
    one = vectors.neighbours(table(spark, [[1.0, 2.0]]), 3)
    assert one.collect() == []


def test_empty_and_unknown_queries(spark):
    none = table(spark, [])
    assert vectors.neighbours(none, 3).collect() == []
    v = table(spark, [[0.0, 1.0], [2.0, 3.0]])
    asked = spark.createDataFrame([(7,), (None,), (0,), (0,)], "id long")
    assert [(r["id"], r["neighbour"]) for r in vectors.neighbours(v, 3, asked).collect()] == [(0, 1)]


def test_a_hot_string_is_salted(spark):
    v = table(spark, [[5.0, 5.0]] * 900 + [[float(i), 0.0] for i in range(100)])
    got = vectors.neighbours(v, 2, spark.createDataFrame([(899,)], "id long"), per_leaf=50)
    assert [r["distance"] for r in got.collect()] == [0.0, 0.0]


def test_point_vectors_take_the_latest_whole_row(spark):
    names = ["nx", "ny", "nz", *vectors.GEO_FEATURES]
    kind = "point_id long, enriched_at long, extra string, " + ", ".join(f"{n} float" for n in names)
    good, bad = [0.5] * 13, [0.5] * 12 + [float("nan")]
    rows = [(1, 1, "a", *bad), (1, 2, "b", *good), (2, 1, "c", *good), (2, 2, "d", *bad), (3, 1, "e", *good), (4, 1, "f", *good), (None, 1, "g", *good), (5, 1, "h", *[None] * 13)]
    p = spark.createDataFrame([(1, 10.0, 20.0, 30.0, "x"), (1, 10.0, 20.0, 30.0, "y"), (2, 0.0, 0.0, 0.0, "z"), (3, None, 0.0, 0.0, "z"), (4, float("inf"), 0.0, 0.0, "z")], "point_id long, x double, y double, z double, vec string")
    got = vectors.point_vectors(p, spark.createDataFrame(rows, kind)).collect()
    assert [(r["id"], r["vec"][:4]) for r in got] == [(1, [1.0, 2.0, 3.0, 0.5])]


def shares(found, v, asked, k):
    """Of some ids the share of their true k nearest that were found, by brute force."""
    t = v.toPandas()
    x, ids = np.stack(t["vec"].to_numpy()), t["id"].to_numpy()
    got = {q: set(g["neighbour"]) for q, g in found.toPandas().groupby("id")}
    out = []
    for q in asked:
        d = ((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1)
        d[ids == q] = np.inf
        out.append(len(set(ids[np.argsort(d, kind="stable")[:k]]) & got[q]) / k)
    return np.array(out)


def test_recall_of_all_neighbours(spark, data):
    """The settings of the query p1_neighbours, over real vectors and over harder ones of sixteen directions."""
    from pointloom.runtime import table as read

    v = vectors.point_vectors(read(spark, data, "points"), read(spark, data, "point_features"))
    ids = sorted(r["id"] for r in v.select("id").collect())
    r = shares(vectors.all_neighbours(v, 10), v, ids[::7], 10)
    assert r.mean() >= 0.99 and (r < 0.9).mean() <= 0.02
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16)) * 20
    v = cut(table(spark, centres[rng.integers(0, 60, 9000)] + rng.normal(size=(9000, 16))))
    r = shares(vectors.all_neighbours(v, 10), v, range(0, 9000, 45), 10)
    assert r.mean() >= 0.9


def test_all_neighbours_slides_over_chunks(spark, monkeypatch):
    """Chunks much smaller than a partition lose nothing at their borders."""
    monkeypatch.setattr(vectors, "CHUNK", 200)
    rng = np.random.default_rng(6)
    v = cut(table(spark, rng.uniform(0, 100, (3000, 3))))
    found = vectors.all_neighbours(v, 5).collect()
    assert len(found) == 15_000 and len({(r["id"], r["neighbour"]) for r in found}) == 15_000 and all(r["id"] != r["neighbour"] for r in found)
    assert vectors.recall(vectors.all_neighbours(v, 5), v, list(range(0, 3000, 11)), 5) >= 0.95


def test_all_neighbours_of_copies_few_and_no_rows(spark):
    v = table(spark, [[0.0, 0.0]] * 3 + [[1.0, 0.0], [0.0, 1.0]])
    got = {(r["id"], r["rank"]): r["neighbour"] for r in vectors.all_neighbours(v, 3).collect()}
    assert [got[0, r] for r in (1, 2, 3)] == [1, 2, 3] and len(got) == 15
    assert vectors.all_neighbours(table(spark, []), 3).collect() == [] and vectors.all_neighbours(table(spark, [[1.0, 2.0]]), 3).collect() == []
    hot = table(spark, [[5.0, 5.0]] * 900 + [[float(i), 0.0] for i in range(100)])
    assert {r["distance"] for r in vectors.all_neighbours(hot, 2).where("id < 900").collect()} == {0.0}
    twice = table(spark, [[0.0, 0.0], [0.0, 0.0], [3.0, 4.0]], [7, 7, 8])
    assert {(r["id"], r["neighbour"]) for r in vectors.all_neighbours(twice, 2).collect()} == {(7, 8), (8, 7)}


def test_large_leaves_are_salted_whatever_the_borders(spark, monkeypatch):
    """Fewer borders than leaves are wanted: groups stay bounded, nothing is lost."""
    monkeypatch.setattr(vectors, "LEAVES", 2)
    rng = np.random.default_rng(9)
    v = cut(table(spark, rng.uniform(0, 100, (4000, 3))))
    forest, _, _ = vectors.fit(v, 2, 5, 100, 11)
    assert max(s.max() for s in forest.salts) >= 4
    asked = spark.createDataFrame([(i,) for i in range(0, 4000, 40)], "id long")
    assert vectors.recall(vectors.neighbours(v, 5, asked, per_leaf=100), v, list(range(0, 4000, 40)), 5) >= 0.95
