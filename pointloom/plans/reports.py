"""Queries that report on labels, clusters, splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.functions import shape
from pointloom.operators import cluster, knn, learning, patches, regions
from pointloom.operators.frames import steady_avg
from pointloom.plans.base import f, features, p, points
from pointloom.plans.neighbours import _DBSCAN, K, _LAB
from pointloom.plans.sets import _MD5, SPLITS
from pointloom.plans.spatial import INSIDE, SEGMENTS
from pointloom.runtime import cut, finite, table

_SHAPES = ("planarity", "linearity", "sphericity")


def cluster_sizes(spark, d):
    """The density clusters of building points in one row: how many, noise, and their sizes."""
    by = cluster.dbscan(points(spark, d).where("classification = 6"), 1.0, 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("cluster") > 0, F.col("n"))
    return by.agg(F.count(own).alias("clusters"), F.coalesce(F.sum(F.when(F.col("cluster") == 0, F.col("n"))), F.lit(0)).alias("noise"), F.min(own).alias("smallest"), F.max(own).alias("largest"), F.sum(own).alias("clustered"))


def _coherence(spark, d):
    ps = cut(points(spark, d).where("classification IS NOT NULL").select("point_id", "x", "y", "z", F.col("classification").alias("label")))
    return knn.neighbourhoods(ps, K, knn.label_measures, "n int, same int, other long", ["label"]).where("n > 0")


def isolated_ratio(spark, d):
    """The share of labelled points of which less than three tenths of the neighbours have the same label, and the mean share."""
    return _coherence(spark, d).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("same") * 10 < F.col("n") * 3).alias("isolated"), (F.sum("same") / F.sum("n")).alias("coherence"))


def boundary_accuracy(spark, d):
    """How well a height rule agrees with the stored labels at the borders of classes (a neighbour has another label) and inside them."""
    h = F.col("height")
    rule = F.when(h < 0.5, 2).when(h < 2, 3).when(h < 5, 4).when(F.col("planarity") > 0.7, 6).otherwise(5)
    fs = features(spark, d, "height", "planarity").where("classification IS NOT NULL").select("point_id", (F.col("classification") == rule).alias("right"))
    at = fs.join(_coherence(spark, d).select("point_id", (F.col("same") < F.col("n")).alias("border")), "point_id")
    return at.groupBy("border").agg(F.count(F.lit(1)).alias("n"), (F.count_if("right") / F.count(F.lit(1))).alias("accuracy"))


def label_report(spark, d):
    """Per label the number of points, the share of all, the mean height and planarity and the range of heights."""
    fs = cut(features(spark, d, "height", "planarity").where("classification IS NOT NULL").select("classification", "height", "planarity"))
    n = fs.count()
    return fs.groupBy(F.col("classification").alias("label")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(max(n, 1))).alias("share"), steady_avg("height").alias("mean_height"), steady_avg("planarity").alias("mean_planarity"), F.min("height").alias("h0"), F.max("height").alias("h1"))


def split_report(spark, d):
    """Tiles and points of each split of tiles."""
    by = points(spark, d).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(patches.md5_split(F.col("tile"), 42, SPLITS).alias("split")).agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("points"))


def ground_report(spark, d):
    """Per tile the points and ground points, their share and the heights of the ground."""
    is_ground = F.col("classification") == 2
    g = points(spark, d).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_ground).alias("ground"), F.min(F.when(is_ground, F.col("z"))).alias("z0"), F.max(F.when(is_ground, F.col("z"))).alias("z1"))
    return g.withColumn("share", F.col("ground") / F.col("n"))


def building_buffer(spark, d):
    """Unclassified and ground-free points within a metre of a building's outline or inside it, taken as building."""
    near = regions.within_buffer(points(spark, d).where("classification IN (0, 1)"), table(spark, d, "polygons").where("layer = 'buildings'"), 1.0)
    return near.select("point_id", F.lit(6).alias("label"))


def disputed_files(spark, d):
    """The ten files whose points' labels disagree most, by the entropy of their vote (a report)."""
    v = learning.vote(points(spark, d).where("file_id IS NOT NULL").select("file_id", "classification"), "file_id", "classification")
    return learning.top_uncertain(v, F.round("vote_entropy", 9), 10, "file_id").select("file_id", "score")


def hybrid_points(spark, d):
    """The hundred points with the highest mix of entropy, margin and distance from certainty (a report)."""
    fs = features(spark, d, *_SHAPES)
    t = F.col("planarity") + F.col("linearity") + F.col("sphericity") + 1e-9
    pr = [F.col(c) / t for c in _SHAPES]
    score = (learning.entropy(pr) * 0.5 + learning.margin(pr) * 0.3 + learning.least_confidence(pr) * 0.2) / 1.0
    return learning.top_uncertain(fs.select("point_id", *_SHAPES), F.round(score, 9), 100, "point_id").select("point_id", "score")


def unit_features(spark, d):
    """The shape features of each point over their length."""
    unit = shape.normalize([F.col(c) for c in _SHAPES])
    return features(spark, d, *_SHAPES).select("point_id", *[u.alias(f"u_{c}") for u, c in zip(unit, _SHAPES)])


def sampled_index(spark, d):
    """The vegetation index of a raster of 2 m at each point: its cell, else the nearest one with an index within 10 m, else 0."""
    ps = points(spark, d)
    cells = regions.raster(ps.where(finite("ndvi")), steady_avg("ndvi"), 2.0)
    return regions.sample_raster(ps, cells, 2.0, default=0.0).withColumnRenamed("value", "ndvi")


def file_order(spark, d):
    """The files of the registry by the number of their points, the largest first; files without a number come last."""
    n = points(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("file_id IS NOT NULL")
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "file_id")))  # a row per file


QUERIES = {
    "cluster_sizes": cluster_sizes, "isolated_ratio": isolated_ratio, "boundary_accuracy": boundary_accuracy, "label_report": label_report, "split_report": split_report, "ground_report": ground_report, "building_buffer": building_buffer,
    "disputed_files": disputed_files, "hybrid_points": hybrid_points, "unit_features": unit_features, "sampled_index": sampled_index, "file_order": file_order,
}

_SAME = """(SELECT N.point_id, count(*) AS n, count(*) FILTER (o.classification = a.classification) AS same FROM N JOIN P AS a ON a.point_id = N.point_id JOIN P AS o ON o.point_id = nid GROUP BY N.point_id)"""
_T = "(planarity + linearity + sphericity + 1e-9)"
_ENT = "-(" + " + ".join(f"{c} / {_T} * ln({c} / {_T} + 1e-10)" for c in _SHAPES) + ")"
_MEAN = "sum(round({0} * 1000000)::BIGINT)::DOUBLE / count({0}) / 1000000"
_LEN = "(sqrt(planarity * planarity + linearity * linearity + sphericity * sphericity) + 1e-10)"
_GAP = "sqrt((q.x - (o.c + 0.5) * 2) * (q.x - (o.c + 0.5) * 2) + (q.y - (o.r + 0.5) * 2) * (q.y - (o.r + 0.5) * 2))"
SQL = {
    "cluster_sizes": f"{_DBSCAN} SELECT count(*) FILTER (cluster > 0) AS clusters, coalesce(sum(n) FILTER (cluster = 0), 0)::BIGINT AS noise, min(n) FILTER (cluster > 0) AS smallest, max(n) FILTER (cluster > 0) AS largest, (sum(n) FILTER (cluster > 0))::BIGINT AS clustered FROM (SELECT cluster, count(*) AS n FROM O GROUP BY cluster)",
    "isolated_ratio": p(f"SELECT count(*) AS points, count(*) FILTER (same * 10 < n * 3) AS isolated, sum(same)::DOUBLE / sum(n) AS coherence FROM {_SAME}", _LAB),
    "boundary_accuracy": f(f"SELECT border, count(*) AS n, count(*) FILTER (ok)::DOUBLE / count(*) AS accuracy FROM (SELECT point_id, classification = CASE WHEN height < 0.5 THEN 2 WHEN height < 2 THEN 3 WHEN height < 5 THEN 4 WHEN planarity > 0.7 THEN 6 ELSE 5 END AS ok FROM F WHERE classification IS NOT NULL) JOIN (SELECT point_id, same < n AS border FROM {_SAME}) USING (point_id) GROUP BY border", _LAB, "height planarity"),
    "label_report": f(f"SELECT classification AS label, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share, {_MEAN.format('height')} AS mean_height, {_MEAN.format('planarity')} AS mean_planarity, min(height) AS h0, max(height) AS h1 FROM F WHERE classification IS NOT NULL GROUP BY classification", read="height planarity"),
    "split_report": p(f"SELECT CASE WHEN ({_MD5}) / 1000000.0::DOUBLE < 0.8 THEN 'train' WHEN ({_MD5}) / 1000000.0::DOUBLE < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS tiles, sum(n)::BIGINT AS points FROM (SELECT md5(tile || '_42') AS h, count(*) AS n FROM P GROUP BY tile) GROUP BY 1"),
    "ground_report": p("SELECT tile, count(*) AS n, count(*) FILTER (classification = 2) AS ground, min(z) FILTER (classification = 2) AS z0, max(z) FILTER (classification = 2) AS z1, count(*) FILTER (classification = 2)::DOUBLE / count(*) AS share FROM P GROUP BY tile"),
    "building_buffer": p("SELECT point_id, 6 AS label FROM (SELECT point_id FROM D WHERE layer = 'buildings' AND distance <= 1.0 UNION SELECT point_id FROM I WHERE poly_id IN (SELECT poly_id FROM polygons WHERE layer = 'buildings')) JOIN P USING (point_id) WHERE classification IN (0, 1)", INSIDE + SEGMENTS),
    "disputed_files": p("SELECT file_id, round(ln(t) - wl / t, 9) AS score FROM (SELECT file_id, sum(w) AS t, sum(w * ln(w)) AS wl FROM (SELECT file_id, classification, count(*)::DOUBLE AS w FROM P WHERE classification IS NOT NULL AND file_id IS NOT NULL GROUP BY ALL) GROUP BY file_id) ORDER BY score DESC, file_id LIMIT 10"),
    "hybrid_points": f(f"SELECT point_id, round(({_ENT}) * 0.5::DOUBLE + (1 - (s[1] - s[2])) * 0.3::DOUBLE + (1 - s[1]) * 0.2::DOUBLE, 9) AS score FROM (SELECT *, list_reverse_sort([planarity / {_T}, linearity / {_T}, sphericity / {_T}]) AS s FROM F) ORDER BY score DESC, point_id LIMIT 100", read=" ".join(_SHAPES)),
    "unit_features": f("SELECT point_id, " + ", ".join(f"{c} / {_LEN} AS u_{c}" for c in _SHAPES) + " FROM F", read=" ".join(_SHAPES)),
    "sampled_index": p(
        f"""SELECT point_id, coalesce(direct, nearest, 0) AS ndvi FROM (SELECT q.point_id, R0.value AS direct, near.value AS nearest FROM Q0 AS q LEFT JOIN R0 USING (r, c) LEFT JOIN (SELECT q.point_id, o.value, row_number() OVER (PARTITION BY q.point_id ORDER BY {_GAP}, o.r, o.c) AS k
        FROM (SELECT * FROM Q0 ANTI JOIN R0 USING (r, c)) AS q JOIN (SELECT r + i AS near_r, c + j AS near_c, r, c, value FROM R0, range(-6, 7) AS a(i), range(-6, 7) AS b(j)) AS o ON o.near_r = q.r AND o.near_c = q.c WHERE {_GAP} <= 10 QUALIFY k = 1) AS near USING (point_id))""",
        f", Q0 AS (SELECT *, floor(y / 2)::BIGINT AS r, floor(x / 2)::BIGINT AS c FROM P), R0 AS (SELECT r, c, {_MEAN.format('ndvi')} AS value FROM Q0 WHERE isfinite(ndvi) GROUP BY r, c)"),
    "file_order": p("SELECT file_id, n, row_number() OVER (ORDER BY n DESC, file_id)::INT AS place FROM (SELECT file_id, count(*) AS n FROM P WHERE file_id IS NOT NULL GROUP BY file_id)"),
}
