"""Queries over neighbourhoods: nearest points, shape, density, outliers, smoothing, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.functions import shape
from pointloom.operators import cluster, knn
from pointloom.plans.base import f, features, p, points
from pointloom.runtime import cut

K, RADIUS = 10, 1.5


def nearest(spark, d):
    """The 10 nearest points of each point, at any distance."""
    return knn.nearest(points(spark, d).select("point_id", "x", "y", "z"), K).select("point_id", "nid", "rank", "d")


def radius_counts(spark, d):
    n = knn.within_radius(points(spark, d), RADIUS).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))
    return points(spark, d).select("point_id").join(n, "point_id", "left").select("point_id", F.coalesce("n", F.lit(0)).alias("n"))


PAIRS = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]


def _covariances(spark, d):
    kind = ", ".join(["n int", *[f"c{a}{b} double" for a, b in PAIRS]])
    return knn.neighbourhoods(points(spark, d).select("point_id", "x", "y", "z"), K, knn.spread_measures, kind)


def covariances(spark, d):
    """The covariance matrix of each point and its 10 nearest at any distance."""
    return _covariances(spark, d).select("point_id", "n", *[(F.round(f"c{a}{b}", 3) + F.lit(0.0)).alias(f"c{a}{b}") for a, b in PAIRS])


def covariance_shape(spark, d):
    """Covariance of each point and its 10 nearest at any distance, its eigenvalues in closed form and the shape they give."""
    c = _covariances(spark, d).where("n >= 4")
    e = shape.eigenvalues_3x3(*[F.col(f"c{a}{b}") for a, b in PAIRS])
    out = c.withColumns({f"l{i + 1}": v for i, v in enumerate(e)})
    l = [F.col(f"l{i}") for i in (1, 2, 3)]  # noqa: E741
    return out.select("point_id", "n", *[F.round(v, 5).alias(f"l{i + 1}") for i, v in enumerate(l)], F.round(shape.linearity(*l), 3).alias("linearity"), F.round(shape.planarity(*l), 3).alias("planarity"))


def exact_shape(spark, d):
    """Eigenvalues and upward normals of the exact 10 nearest at any distance, and their measures."""
    out = knn.neighbourhoods(points(spark, d), K, knn.covariance_measures, "l1 double, l2 double, l3 double, nx double, ny double, nz double")
    e = [F.col(c) for c in ("l1", "l2", "l3")]
    return out.withColumns({n: c for n, c in {**shape.eigen_features(*e), **shape.curvature_features(*e)}.items()})


def exact_density(spark, d):
    """Density and spread of the exact 20 nearest at any distance."""
    kind = "point_density double, mean_distance double, std_distance double, max_distance double, n_2m int, extent double, height_ratio double, vertical_std double"
    return knn.neighbourhoods(points(spark, d), 20, knn.density_measures, kind)


def local_spacing(spark, d):
    """Mean and deviation of the distances to the 10 nearest at any distance, and a density from the farthest."""
    kind = "n int, mean_distance double, std_distance double, point_density double"
    return knn.neighbourhoods(points(spark, d).select("point_id", "x", "y", "z"), K, knn.density_measures, kind).where("n > 0")


def statistical_outliers(spark, d):
    """Points whose mean distance to their neighbours is a deviation or more above the mean of all."""
    m = cut(local_spacing(spark, d).select("point_id", "mean_distance"))
    t = m.agg((F.avg("mean_distance") + F.stddev_pop("mean_distance")).alias("t")).first()["t"]
    return m.where(F.col("mean_distance") >= F.lit(t)).select("point_id")


def radius_outliers(spark, d):
    """Points with fewer than 4 others within 1.5 m."""
    return radius_counts(spark, d).where("n < 4").select("point_id")


def smoothed_planarity(spark, d):
    """Planarity replaced by the median of the 10 nearest where it is off by more than 0.3 (3 neighbours at least)."""
    fs = cut(features(spark, d, "planarity").select("point_id", "x", "y", "z", "planarity"))
    m = knn.neighbourhoods(fs, K, knn.median_measure("planarity"), "n int, m double", ["planarity"])
    new = F.when((F.col("n") >= 3) & (F.abs(F.col("planarity") - F.col("m")) > 0.3), F.col("m")).when((F.col("n") < 3) & (F.col("n") > 0), F.col("m")).otherwise(F.col("planarity"))
    return fs.join(m, "point_id", "left").select("point_id", new.alias("planarity"))


def label_coherence(spark, d):
    """Per point with a label: the share of labelled neighbours with the same one, and the majority (lowest on ties) where that share is below 0.3."""
    ps = cut(points(spark, d).where("classification IS NOT NULL").select("point_id", "x", "y", "z", F.col("classification").alias("label")))
    g = knn.neighbourhoods(ps, K, knn.label_measures, "n int, same int, other long", ["label"]).where("n > 0").join(ps.select("point_id", "label"), "point_id")
    share = F.col("same") / F.col("n")
    return g.select("point_id", share.alias("share"), F.when(share < 0.3, F.col("other")).otherwise(F.col("label")).cast("int").alias("label"))


def curvature_from_normals(spark, d):
    """The mean length of the differences between a point's normal and those of its neighbours."""
    fs = cut(features(spark, d, "nx", "ny", "nz").select("point_id", "x", "y", "z", "nx", "ny", "nz"))
    out = knn.neighbourhoods(fs, K, knn.normal_measures, "n int, curvature double", ["nx", "ny", "nz"])
    return out.where("n > 0").select("point_id", "curvature")


def local_verticality(spark, d):
    """Height range over the greater horizontal range of the neighbours, a fifth of it, at most 1."""
    ps = points(spark, d).select("point_id", "x", "y", "z")
    o = ps.select(F.col("point_id").alias("nid"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    g = knn.within_radius(ps, RADIUS).join(o, "nid").groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), *[(F.max(f"o{c}") - F.min(f"o{c}")).alias(f"d{c}") for c in "xyz"])
    flat = F.greatest("dx", "dy")
    return g.where("n >= 3").select("point_id", F.when(flat > 0.01, F.least(F.lit(1.0), F.try_divide("dz", flat) / 5)).otherwise(0.0).alias("verticality"))


def height_over_ground(spark, d):
    """Height over the median of the five nearest ground points in the plane within 5 m; the height itself where there are none."""
    return heights_over_ground(cut(points(spark, d).select("point_id", "x", "y", "z", "classification")))


def heights_over_ground(ps):
    ground = ps.where("classification = 2").select(F.col("point_id").alias("nid"), "x", "y", F.col("z").alias("gz"))
    n = knn.nearest_others(ps, ground, 5, (1.25, 5.0)).join(ground.select("nid", "gz"), "nid")
    m = n.groupBy("point_id").agg(F.percentile("gz", 0.5).alias("g"))  # at most five values
    return ps.select("point_id", "z").join(m, "point_id", "left").select("point_id", (F.col("z") - F.coalesce("g", F.lit(0.0))).alias("height"))


def noise_points(spark, d):
    """Unclassified points with fewer than 3 others within 1.5 m, or more than 5 m off the median height of these."""
    ps = points(spark, d)
    z = ps.select(F.col("point_id").alias("nid"), F.col("z").alias("oz"))
    n = knn.within_radius(ps, RADIUS).join(z, "nid").groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("oz", 0.5).alias("m"))
    j = ps.where("classification = 1").select("point_id", "z").join(n, "point_id", "left")
    return j.where((F.coalesce("n", F.lit(0)) < 3) | (F.abs(F.col("z") - F.col("m")) > 5)).select("point_id")


def density_clusters(spark, d):
    """DBSCAN of the building points, 1 m and 5 points."""
    return cluster.dbscan(points(spark, d).where("classification = 6"), 1.0, 5)


def cluster_statistics(spark, d):
    """Size and extent of the density clusters."""
    c = cluster.dbscan(points(spark, d).where("classification = 6"), 1.0, 5).where("cluster > 0")
    return c.join(points(spark, d).select("point_id", "x", "y", "z"), "point_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))


QUERIES = {
    "nearest": nearest, "radius_counts": radius_counts, "covariances": covariances, "covariance_shape": covariance_shape, "exact_shape": exact_shape, "exact_density": exact_density, "local_spacing": local_spacing, "statistical_outliers": statistical_outliers,
    "radius_outliers": radius_outliers, "smoothed_planarity": smoothed_planarity, "label_coherence": label_coherence, "curvature_from_normals": curvature_from_normals, "local_verticality": local_verticality,
    "height_over_ground": height_over_ground, "noise_points": noise_points, "density_clusters": density_clusters, "cluster_statistics": cluster_statistics,
}


def _near(src: str) -> str:
    """Neighbours within 1.5 m over a frame, and the 10 nearest of them."""
    return f""", C AS (SELECT *, floor(x / {RADIUS})::BIGINT AS cx, floor(y / {RADIUS})::BIGINT AS cy, floor(z / {RADIUS})::BIGINT AS cz FROM {src}),
W AS (SELECT a.point_id, b.point_id AS nid, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS d FROM C AS a JOIN (
      SELECT point_id, x, y, z, cx + i AS cx, cy + j AS cy, cz + k AS cz FROM C, range(-1, 2) AS t1(i), range(-1, 2) AS t2(j), range(-1, 2) AS t3(k)) AS b USING (cx, cy, cz)
      WHERE a.point_id <> b.point_id AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= {RADIUS * RADIUS}),
N AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, nid) AS rank FROM W QUALIFY rank <= {K})"""


def nearest_sql(src: str, k: int, radii: tuple[float, ...] = (2.0, 8.0, 40.0)) -> str:
    """N(point_id, nid, d, rank): the k nearest at any distance. Who has k within a radius is served by cells of it, the others
    by the next one, and the last ones by all points."""
    gap = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)"
    out, rest = [f", S AS (SELECT point_id, x, y, z FROM {src})"], "S"
    for i, r in enumerate(radii):
        cell = f"floor(x / {r})::BIGINT AS cx, floor(y / {r})::BIGINT AS cy"
        out.append(f"""A{i} AS (SELECT a.point_id, b.point_id AS nid, sqrt({gap}) AS d FROM (SELECT *, {cell} FROM {rest}) AS a JOIN (SELECT point_id, x, y, z, cx + i AS cx, cy + j AS cy FROM (SELECT *, {cell} FROM S), range(-1, 2) AS t1(i), range(-1, 2) AS t2(j)) AS b USING (cx, cy)
      WHERE a.point_id <> b.point_id AND {gap} <= {r * r}),
N{i} AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, nid) AS rank, count(*) OVER (PARTITION BY point_id) AS m FROM A{i} QUALIFY m >= {k} AND rank <= {k}),
S{i} AS (SELECT * FROM {rest} ANTI JOIN N{i} USING (point_id))""")
        rest = f"S{i}"
    out.append(f"ALL_ AS (SELECT a.point_id, b.point_id AS nid, sqrt({gap}) AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt({gap}), b.point_id) AS rank FROM {rest} AS a JOIN S AS b ON a.point_id <> b.point_id QUALIFY rank <= {k})")
    parts = " UNION ALL ".join(f"SELECT point_id, nid, d, rank FROM N{i}" for i in range(len(radii)))
    return ", ".join(out) + f", N AS ({parts} UNION ALL SELECT * FROM ALL_)"


#: H(point_id, g): the median height of the five nearest ground points within 5 m in the plane.
HEIGHTS = """, H AS (SELECT point_id, quantile_cont(gz, 0.5) AS g FROM (SELECT a.point_id, b.z AS gz FROM (SELECT *, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy FROM P) AS a JOIN (
      SELECT point_id, x, y, z, cx + i AS cx, cy + j AS cy FROM (SELECT *, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy FROM P WHERE classification = 2), range(-1, 2) AS t1(i), range(-1, 2) AS t2(j)) AS b USING (cx, cy)
      WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < 5.0
      QUALIFY row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.point_id) <= 5) GROUP BY point_id)"""
_ALL = _near("P")
_KNN = nearest_sql("P", K)
_LAB = nearest_sql("(SELECT * FROM P WHERE classification IS NOT NULL)", K)
_COV = ", ".join(f"avg(({a}) * ({b})) - avg({a}) * avg({b}) AS c{a}{b}" for a, b in PAIRS)
_SPREAD = f""", M AS (SELECT point_id, 0.0 AS x, 0.0 AS y, 0.0 AS z FROM P WHERE point_id IN (SELECT point_id FROM N) UNION ALL SELECT N.point_id, o.x - a.x, o.y - a.y, o.z - a.z FROM N JOIN P AS a ON a.point_id = N.point_id JOIN P AS o ON o.point_id = nid),
C AS (SELECT point_id, count(*)::INT AS n, {_COV} FROM M GROUP BY point_id)"""
_DENSITY = """SELECT point_id, CASE WHEN r > 0 THEN n / (4.1887902047863905 * r * r * r) ELSE 0 END AS point_density, mean_distance, std_distance, r AS max_distance, n_2m, sqrt(dx * dx + dy * dy + dz * dz) AS extent,
        CASE WHEN sqrt(dx * dx + dy * dy) > 1e-10 THEN dz / sqrt(dx * dx + dy * dy) ELSE 0 END AS height_ratio, vertical_std FROM (SELECT N.point_id, count(*) AS n, max(d) AS r, avg(d) AS mean_distance, stddev_pop(d) AS std_distance, (count(*) FILTER (d <= 2.0))::INT AS n_2m,
        max(o.x) - min(o.x) AS dx, max(o.y) - min(o.y) AS dy, max(o.z) - min(o.z) AS dz, stddev_pop(o.z) AS vertical_std FROM N JOIN P AS o ON o.point_id = nid GROUP BY 1)"""
_SPACING = "SELECT point_id, count(*)::INT AS n, avg(d) AS mean_distance, stddev_pop(d) AS std_distance, CASE WHEN max(d) > 0 THEN count(*) / (pow(max(d), 3) * 4.1887902047863905) ELSE 0 END AS point_density FROM N GROUP BY point_id"
_LINK = """, U AS (SELECT * FROM P WHERE classification = 6), V AS (SELECT a.point_id AS a, b.point_id AS b FROM U AS a JOIN U AS b ON a.point_id <> b.point_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1
      AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 1)"""
_DBSCAN = f"""WITH RECURSIVE {p('', _LINK)[5:]}, K AS (SELECT a AS id FROM V GROUP BY a HAVING count(*) >= 4), L AS (SELECT a, b FROM V WHERE a IN (SELECT id FROM K) AND b IN (SELECT id FROM K)),
        R AS (SELECT id, id AS low FROM K UNION SELECT L.a, R.low FROM L JOIN R ON R.id = L.b WHERE R.low < L.a), Z AS (SELECT id, min(low) AS low FROM R GROUP BY id),
        O AS (SELECT point_id, coalesce(z.low, e.low, 0) AS cluster FROM U LEFT JOIN Z AS z ON z.id = point_id LEFT JOIN (SELECT a AS pid, min(low) AS low FROM V JOIN Z ON Z.id = b GROUP BY a) AS e ON e.pid = point_id)"""
SQL = {
    "nearest": p("SELECT point_id, nid, rank::INT AS rank, d FROM N", _KNN),
    "covariances": p("SELECT point_id, n, " + ", ".join(f"round(c{a}{b}, 3) + 0.0 AS c{a}{b}" for a, b in PAIRS) + " FROM C", _KNN + _SPREAD),
    "covariance_shape": p(
        """SELECT point_id, n, round(a, 5) AS l1, round(greatest(0, 3 * q - a - c), 5) AS l2, round(c, 5) AS l3, round(greatest(0, least(1, (greatest(a, 1e-6) - greatest(0, 3 * q - a - c)) / greatest(a, 1e-6))), 3) AS linearity, round(greatest(0, least(1, (greatest(0, 3 * q - a - c) - c) / greatest(a, 1e-6))), 3) AS planarity
        FROM (SELECT point_id, n, q, greatest(0, q + 2 * w * cos(phi)) AS a, greatest(0, q + 2 * w * cos(phi + 2 * pi() / 3)) AS c FROM (SELECT *, acos(greatest(-1, least(1, CASE WHEN w > 0 THEN ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * w * w * w) ELSE 0 END))) / 3 AS phi
        FROM (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS w FROM (SELECT *, (cxx + cyy + czz) / 3 AS q FROM C WHERE n >= 4))))""", _KNN + _SPREAD),
    "exact_density": p(_DENSITY, nearest_sql("P", 20)),
    "radius_counts": p("SELECT point_id, count(nid) AS n FROM P LEFT JOIN W USING (point_id) GROUP BY point_id", _ALL),
    "local_spacing": p(_SPACING, _KNN),
    "statistical_outliers": p(f"SELECT point_id FROM ({_SPACING}) QUALIFY mean_distance >= avg(mean_distance) OVER () + stddev_pop(mean_distance) OVER ()", _KNN),
    "radius_outliers": p("SELECT point_id FROM P LEFT JOIN W USING (point_id) GROUP BY point_id HAVING count(nid) < 4", _ALL),
    "smoothed_planarity": f(
        """SELECT point_id, CASE WHEN n >= 3 AND abs(planarity - m) > 0.3 THEN m WHEN n < 3 AND n > 0 THEN m ELSE planarity END AS planarity FROM F LEFT JOIN (SELECT N.point_id, count(*) AS n, quantile_cont(o.planarity, 0.5) AS m FROM N JOIN F AS o ON o.point_id = nid GROUP BY 1) USING (point_id)""", nearest_sql("F", K), "planarity"),
    "label_coherence": p(
        """SELECT point_id, same / total AS share, CASE WHEN same / total < 0.3 THEN other ELSE classification END AS label FROM (SELECT *, sum(n) OVER w AS total, sum(CASE WHEN other = classification THEN n ELSE 0 END) OVER w AS same, row_number() OVER (PARTITION BY point_id ORDER BY n DESC, other) AS r
        FROM (SELECT N.point_id, any_value(a.classification) AS classification, o.classification AS other, count(*)::DOUBLE AS n FROM N JOIN P AS a ON a.point_id = N.point_id JOIN P AS o ON o.point_id = nid GROUP BY N.point_id, o.classification) WINDOW w AS (PARTITION BY point_id)) WHERE r = 1""", _LAB),
    "curvature_from_normals": f("SELECT N.point_id, avg(sqrt((a.nx - o.nx) ** 2 + (a.ny - o.ny) ** 2 + (a.nz - o.nz) ** 2)) AS curvature FROM N JOIN F AS a ON a.point_id = N.point_id JOIN F AS o ON o.point_id = nid GROUP BY 1", nearest_sql("F", K), "nx ny nz"),
    "local_verticality": p(
        """SELECT point_id, CASE WHEN greatest(dx, dy) > 0.01 THEN least(1, dz / greatest(dx, dy) / 5) ELSE 0 END AS verticality FROM (SELECT W.point_id, count(*) AS n, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM W JOIN P ON P.point_id = nid GROUP BY 1) WHERE n >= 3""", _ALL),
    "height_over_ground": p("SELECT P.point_id, z - coalesce(g, 0) AS height FROM P LEFT JOIN H USING (point_id)", HEIGHTS),
    "noise_points": p("SELECT a.point_id FROM P AS a LEFT JOIN W ON W.point_id = a.point_id LEFT JOIN P AS o ON o.point_id = nid WHERE a.classification = 1 GROUP BY a.point_id HAVING count(nid) < 3 OR abs(any_value(a.z) - quantile_cont(o.z, 0.5)) > 5", _ALL),
    "density_clusters": f"{_DBSCAN} SELECT * FROM O",
    "cluster_statistics": f"{_DBSCAN} SELECT cluster, count(*) AS n, min(z) AS z0, max(z) AS z1, max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM O JOIN P USING (point_id) WHERE cluster > 0 GROUP BY cluster",
}
