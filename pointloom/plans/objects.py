"""Queries of objects, scales and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import buildings, cluster, knn, learning, patches, quantile, regions, scales
from pointloom.plans.base import f, features, p, points
from pointloom.plans.neighbours import _ALL
from pointloom.plans.spatial import INSIDE
from pointloom.runtime import cut, finite, table

RADII, WEIGHTS = [0.5, 1.0, 1.5], [1.0, 2.0, 1.0]


def building_floors(spark, d):
    return buildings.floors(points(spark, d), table(spark, d, "polygons").where("layer = 'buildings'"))


def footprint_shifts(spark, d):
    """The best shift of each building's extent, of up to 5 m on each axis in steps of 0.5 m."""
    b = table(spark, d, "polygons").where(F.col("layer").isin("buildings") & finite("xmin", "ymin", "xmax", "ymax"))
    b = b.select(F.col("poly_id").alias("box_id"), F.col("xmin").alias("x0"), F.col("ymin").alias("y0"), F.col("xmax").alias("x1"), F.col("ymax").alias("y1")).distinct()
    return buildings.best_shifts(points(spark, d), b, step=0.5, most=10)


def cluster_hulls(spark, d):
    """Convex hulls of the density clusters of building points."""
    ps = points(spark, d).where("classification = 6")
    c = cluster.dbscan(ps, 1.0, 5).where("cluster > 0")
    return buildings.hulls(c.join(ps.select("point_id", "x", "y"), "point_id"), "cluster")


def file_hulls(spark, d):
    return buildings.hulls(points(spark, d).select("file_id", "x", "y"), "file_id")


def _scales(spark, d):
    ps = points(spark, d).select("point_id", "x", "y", "z")
    z = ps.select(F.col("point_id").alias("nid"), F.col("z").alias("oz"))
    near = knn.within_radius(ps, RADII[-1]).join(z, "nid")
    return scales.at_radii(near.join(ps.select("point_id", "z"), "point_id").withColumn("dz", F.col("oz") - F.col("z")), "dz", RADII)


def multi_scale(spark, d):
    """Mean height difference to the neighbours at three radii, combined in three ways, and whether the scales disagree."""
    m, v = [F.col(f"mean{i}") for i in range(3)], [F.col(f"var{i}") for i in range(3)]
    s = _scales(spark, d)
    return s.select("point_id", *[f"n{i}" for i in range(3)], scales.variance_weighted(m, v, WEIGHTS).alias("by_variance"), scales.plain_weighted(m, WEIGHTS).alias("plain"), scales.adaptive(m, F.least(F.lit(1.0), F.col("var2"))).alias("adaptive"), scales.disagree(m, 0.01).alias("disagree"))


def tile_analysis(spark, d):
    """Per tile: density over the extent, median and 95th percentile of the distance to the nearest point within 1.5 m, and settings these suggest."""
    ps = points(spark, d)
    one = knn.within_radius(ps, 1.5).groupBy("point_id").agg(F.min("d").alias("d"))
    at = cut(ps.select("point_id", "tile", "x", "y").join(one, "point_id", "left"))
    g = at.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    g = g.join(quantile.group_quantiles(at, ["tile"], "d", {"spacing": 0.5, "noise": 0.95}, 0.01).drop("n"), "tile", "left")
    dens = F.when(F.col("area") > 0, F.try_divide("n", "area")).otherwise(0.0)
    return g.select("tile", "n", dens.alias("density"), "spacing", "noise", F.when(dens > 10, 20).when(dens > 1, 12).otherwise(8).alias("k"))


def farthest_samples(spark, d):
    """64 spread points of each patch, chosen from all of its points."""
    g = patches.patch_grid(points(spark, d).select("point_id", "tile", "x", "y", "z"), 20.0, 0.1, 50)
    return buildings.farthest_points(g, ["tile", "px", "py"], 64)


def training_samples(spark, d):
    """Patches as rows of arrays."""
    fs = features(spark, d, "planarity", "height", "curvature").select("point_id", "tile", "x", "y", "z", "classification", "planarity", "height", "curvature")
    r = patches.resample(patches.patch_grid(fs, 20.0, 0.1, 50), ["tile", "px", "py"], 256)
    s = buildings.samples(r, ["tile", "px", "py"], ["planarity", "height", "curvature"])
    return s.select("tile", "px", "py", F.size("points").alias("n"), F.array_join(F.transform(F.array_sort(F.array_distinct("labels")), lambda x: x.cast("string")), ",").alias("labels"))


def tile_functions(spark, d):
    """A user's function over blocks of tiles: the height range of each block, combined per tile."""
    import pandas as pd

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "lo": [pdf["z"].min()], "hi": [pdf["z"].max()], "n": [len(pdf)]})

    out = buildings.per_tile(points(spark, d).select("tile", "x", "y", "z"), span, "tile string, lo double, hi double, n long", size=50.0)
    return out.groupBy("tile").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def line_crossings(spark, d):
    """Where the outlines of roads and railways cross."""
    lines = table(spark, d, "polygons").where(F.col("layer").isin("roads", "railways", "power_lines"))
    e = regions.edges(lines).withColumnRenamed("poly_id", "line_id")
    return buildings.crossings(e)


def model_votes(spark, d):
    """Three trees trained on hash samples of at most about 20,000 labelled points each, and the vote of their predictions on all."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    cols = ["planarity", "linearity", "curvature", "roughness", "verticality", "height"]
    fs = VectorAssembler(inputCols=cols, outputCol="v").transform(features(spark, d, *cols).where("classification BETWEEN 0 AND 30").select("point_id", "classification", *cols))
    n = fs.count()
    out = fs
    for i in range(3):
        bag = fs.where(F.pmod(F.xxhash64("point_id", F.lit(i)), F.lit(1_000_000)) < F.lit(min(1_000_000, int(20_000 / max(n, 1) * 1_000_000) + 1)))
        model = DecisionTreeClassifier(labelCol="classification", featuresCol="v", predictionCol=f"p{i}", rawPredictionCol=f"r{i}", probabilityCol=f"q{i}", maxDepth=6, seed=i).fit(bag)
        out = model.transform(out)
    votes = out.select("point_id", F.explode(F.array(*[F.col(f"p{i}").cast("int") for i in range(3)])).alias("label"))
    return learning.vote(votes, "point_id", "label")


QUERIES = {
    "building_floors": building_floors, "footprint_shifts": footprint_shifts, "cluster_hulls": cluster_hulls, "file_hulls": file_hulls, "multi_scale": multi_scale, "tile_analysis": tile_analysis, "farthest_samples": farthest_samples,
    "training_samples": training_samples, "tile_functions": tile_functions, "line_crossings": line_crossings, "model_votes": model_votes,
}

_M = [f"mean{i}" for i in range(3)]


def _mean(weights: list[str]) -> str:
    num = " + ".join(f"(CASE WHEN {m} IS NOT NULL THEN {m} * {w} ELSE 0 END)" for m, w in zip(_M, weights))
    den = " + ".join(f"(CASE WHEN {m} IS NOT NULL THEN {w} ELSE 0 END)" for m, w in zip(_M, weights))
    return f"({num}) / nullif({den}, 0)"


_SCALES = _ALL + """, Z AS (SELECT W.point_id, d, o.z - a.z AS dz FROM W JOIN P AS a ON a.point_id = W.point_id JOIN P AS o ON o.point_id = nid),
Y AS (SELECT point_id, """ + ", ".join(f"count(*) FILTER (d <= {r}) AS n{i}, avg(dz) FILTER (d <= {r}) AS mean{i}, var_pop(dz) FILTER (d <= {r}) AS var{i}" for i, r in enumerate(RADII)) + " FROM Z GROUP BY point_id)"  # fmt: skip
SQL = {
    "building_floors": p(
        """SELECT poly_id, floor((z - base) / 3)::INT AS floor, count(*) AS n, min(z) AS z0, max(z) AS z1 FROM (SELECT poly_id, z, min(z) OVER (PARTITION BY poly_id) AS base FROM I JOIN P USING (point_id) WHERE poly_id IN (SELECT poly_id FROM polygons WHERE layer = 'buildings')) GROUP BY 1, 2""", INSIDE),
    "footprint_shifts": p(
        """SELECT box_id, dx, dy, score FROM (SELECT box_id, dx, dy, coalesce(sum(g), 0)::DOUBLE AS score FROM X LEFT JOIN (SELECT x, y, CASE classification WHEN 6 THEN 1 ELSE -1 END AS g FROM P WHERE classification IN (2, 6)) ON x BETWEEN x0 + dx AND x1 + dx AND y BETWEEN y0 + dy AND y1 + dy GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY score DESC, abs(dx) + abs(dy), dx, dy) = 1""",
        """, X AS (SELECT box_id, x0, y0, x1, y1, i::DOUBLE / 2 AS dx, j::DOUBLE / 2 AS dy FROM (SELECT DISTINCT poly_id AS box_id, xmin AS x0, ymin AS y0, xmax AS x1, ymax AS y1 FROM polygons WHERE layer = 'buildings' AND isfinite(xmin) AND isfinite(ymin) AND isfinite(xmax) AND isfinite(ymax)), range(-10, 11) AS a(i), range(-10, 11) AS b(j))"""),
    "multi_scale": p(
        f"""SELECT point_id, n0, n1, n2, {_mean([f'({w} / (1 + coalesce(var{i}, 0)))' for i, w in enumerate(WEIGHTS)])} AS by_variance, {_mean([str(w) for w in WEIGHTS])} AS plain,
        {_mean([f'exp(-2 * abs(1 - least(1, var2) - {i} / 2.0::DOUBLE))' for i in range(3)])} AS adaptive, coalesce(len(a) > 1 AND list_var_pop(a) > 0.01, false) AS disagree FROM (SELECT *, [v FOR v IN [mean0, mean1, mean2] IF v IS NOT NULL] AS a FROM Y)""", _SCALES),
    "tile_analysis": p(
        """SELECT tile, n, dens AS density, spacing, noise, CASE WHEN dens > 10 THEN 20 WHEN dens > 1 THEN 12 ELSE 8 END AS k FROM (SELECT tile, count(*) AS n, CASE WHEN (max(x) - min(x)) * (max(y) - min(y)) > 0 THEN count(*) / ((max(x) - min(x)) * (max(y) - min(y))) ELSE 0 END AS dens, quantile_cont(d, 0.5) AS spacing, quantile_cont(d, 0.95) AS noise
        FROM P LEFT JOIN (SELECT point_id, min(d) AS d FROM W GROUP BY point_id) USING (point_id) GROUP BY tile)""", _ALL),
    "tile_functions": p("SELECT tile, min(z) AS lo, max(z) AS hi, count(*) AS n FROM P GROUP BY tile"),
    "line_crossings": """WITH S AS (SELECT DISTINCT poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM (SELECT poly_id, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM (
        SELECT poly_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM polygons WHERE layer IN ('roads', 'railways', 'power_lines') AND ring IS NOT NULL AND len(ring) >= 2)) WHERE a.x <> b.x OR a.y <> b.y)
        SELECT DISTINCT line_a, line_b, round(x1 + t * rx, 3) AS x, round(y1 + t * ry, 3) AS y FROM (SELECT *, ((u1 - x1) * sy - (v1 - y1) * sx) / det AS t, ((u1 - x1) * ry - (v1 - y1) * rx) / det AS u FROM (
        SELECT a.poly_id AS line_a, b.poly_id AS line_b, a.x1, a.y1, b.x1 AS u1, b.y1 AS v1, a.x2 - a.x1 AS rx, a.y2 - a.y1 AS ry, b.x2 - b.x1 AS sx, b.y2 - b.y1 AS sy, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS det
        FROM S AS a JOIN S AS b ON a.poly_id < b.poly_id AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)) WHERE det <> 0)
        WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""",
}
