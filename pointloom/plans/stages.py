"""Queries of staged rules: by geometry, vegetation index, surfaces, parcels, buildings, clusters and corrections.

Thresholds below are fixed values of the classes they describe. Where the stages are tables of conditions, the SQL builds a
nested selection from the same tables; scores, clusters and joins are written out on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import buildings, cluster, knn, near, quantile, regions, stages
from pointloom.operators.grid import voxel_downsample
from pointloom.operators.stages import Signature, Stage
from pointloom.plans.base import b, bands, f, features, p, points
from pointloom.plans.neighbours import nearest_sql
from pointloom.plans.spatial import INSIDE
from pointloom.runtime import cut, finite, table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Codes 1 unclassified, 2 ground, 3 to 5 low, medium and high vegetation, 6 building, 9 water, 11 road.
GEOMETRY = [
    Stage("height > 2.5 AND planarity > 0.65 AND verticality > 0.3", "6"),
    Stage("height < 0.5 AND planarity > 0.7 AND nz > 0.9", "11"),
    Stage("height < 0.5 AND planarity > 0.7", "2"),
    Stage("curvature > 0.02 AND roughness > 0.03 AND planarity < 0.4 AND height < 2.0", "3"),
    Stage("curvature > 0.02 AND roughness > 0.03 AND planarity < 0.4 AND height >= 1.5", "5"),
]
NDVI = [Stage("ndvi >= 0.35 AND height < 2.0", "3"), Stage("ndvi >= 0.35 AND height >= 1.5", "5"), Stage("ndvi < 0.15 AND label IN (3, 4, 5)", "1")]
BASIC = Stage("label IN (0, 1)", "CASE WHEN planarity > 0.7 AND height >= 1.5 THEN 6 WHEN height < 0.5 THEN 2 WHEN height < 2 THEN 3 WHEN height < 5 THEN 4 ELSE 5 END")
BUILDING = [
    Stage("height > 1.5 AND height < 200 AND verticality > 0.5 AND planarity > 0.35", "6"),
    Stage("height > 1.5 AND height < 200 AND abs(nz) > 0.8 AND planarity > 0.65", "6"),
    Stage("height > 1.5 AND height < 200 AND anisotropy > 0.4 AND planarity > 0.3", "6"),
    Stage("height > 1.5 AND height < 200 AND linearity > 0.3 AND (verticality > 0.7 OR verticality < 0.3)", "6"),
    Stage("height > 0.8 AND height < 200 AND verticality > 0.4 AND planarity > 0.25 AND (verticality > 0.45 OR anisotropy > 0.35)", "6"),
    Stage("label IN (0, 1) AND height > 1.5 AND height < 200 AND planarity > 0.5", "6"),
]
#: Parts of buildings in the simple taxonomy: walls 0, flat roofs 1.
PARTS = [Stage("classification = 6 AND planarity > 0.85 AND nz > 0.9", "1"), Stage("classification = 6 AND planarity > 0.6 AND verticality > 0.7", "0")]
#: Parts in the detailed one, over the simple ones: chimney 8, balcony 16, window 13, roofs 3 (flat), 4 (gable), 5 (hip).
DETAILS = [
    Stage("classification = 6 AND height > 5 AND verticality > 0.9 AND planarity < 0.5", "8"),
    Stage("classification = 6 AND height > 2 AND height < roof - 1 AND planarity > 0.8 AND nz > 0.9", "16"),
    Stage("classification = 6 AND verticality > 0.7 AND intensity < mean_intensity - 0.2 AND height > 1 AND height < 10", "13"),
    Stage("classification = 6 AND label = 1 AND nz > 0.95 AND planarity > 0.9", "3"),
    Stage("classification = 6 AND label = 1 AND nz < 0.95 AND nz > 0.7 AND planarity > 0.85", "4"),
    Stage("classification = 6 AND label = 1 AND nz < 0.95 AND nz > 0.7 AND planarity > 0.75", "5"),
]
CORRECTIONS = [
    Stage("classification = 5 AND height < 2", "3"), Stage("classification = 3 AND height > 3.5", "5"), Stage("classification = 2 AND height > 0.5", "3"), Stage("classification = 6 AND height < 2", "3"),
    Stage("label IN (3, 5) AND ndvi < 0.2", "6"), Stage("label = 6 AND classification = 6 AND ndvi > 0.5", "3"),
]
#: The first rule that holds has the highest confidence; a feature that is missing rejects nothing.
ADAPTIVE = [
    Stage("height <= 0.5 AND planarity >= 0.7 AND nz >= 0.85 AND curvature <= 0.05 AND (ndvi IS NULL OR ndvi <= 0.3)", "2"),
    Stage("height BETWEEN 0 AND 0.5 AND curvature >= 0.02 AND roughness >= 0.03 AND (ndvi IS NULL OR ndvi >= 0.35)", "3"),
    Stage("height BETWEEN -0.2 AND 0.3 AND planarity >= 0.85 AND nz >= 0.9 AND curvature <= 0.05 AND (ndvi IS NULL OR ndvi <= 0.15)", "11"),
    Stage("height >= 2 AND curvature >= 0.02 AND roughness >= 0.03 AND planarity <= 0.4 AND (ndvi IS NULL OR ndvi >= 0.35)", "5"),
    Stage("height >= 1.5 AND planarity >= 0.65 AND verticality >= 0.6 AND curvature <= 0.1 AND nz <= 0.85 AND (ndvi IS NULL OR ndvi <= 0.2)", "6"),
]
TRANSPORT = [
    Stage("height BETWEEN -0.2 AND 0.3 AND planarity >= 0.85 AND roughness <= 0.05 AND abs(nz) >= 0.9 AND intensity BETWEEN 0.1 AND 0.6", "11"),
    Stage("label <> 11 AND height BETWEEN -0.2 AND 2 AND planarity >= 0.7 AND linearity >= 0.75 AND (ndvi IS NULL OR ndvi <= 0.25)", "10"),
]
SIGNATURES = [
    Signature("vegetation", {"curvature": (0.15, None), "planarity": (None, 0.7), "ndvi": (0.2, None), "nz": (None, 0.85)}),
    Signature("building", {"curvature": (None, 0.1), "planarity": (0.7, None), "ndvi": (None, 0.15), "verticality": (0.6, None), "height": (2.0, None)}),
    Signature("road", {"curvature": (None, 0.05), "planarity": (0.85, None), "ndvi": (None, 0.15), "nz": (0.9, None), "height": (None, 2.0)}),
    Signature("ground", {"curvature": (None, 0.15), "planarity": (0.6, None), "ndvi": (0.1, 0.4), "nz": (0.8, None), "height": (None, 0.5)}),
]
#: Class 5 and 6 of the codes stay two, all others of a family become one: code -> simple taxonomy -> how many codes share it.
TO_SIMPLE = {0: 14, 1: 14, 2: 9, 3: 10, 4: 10, 5: 11, 6: 0, 7: 10, 8: 14, 9: 12, 10: 14, 11: 14, 12: 14, 13: 14, 14: 14, 15: 14, 16: 14, 17: 13, 18: 11, 64: 14, 65: 14, 67: 14}
PARCELS = {
    "forest": [(0.3, "ndvi >= 0.5"), (0.2, "curvature >= 0.25"), (0.1, "planarity <= 0.6"), (0.4, "in_forest > 0")],
    "agriculture": [(0.3, "ndvi BETWEEN 0.2 AND 0.6"), (0.2, "planarity >= 0.7")],
    "building": [(0.4, "verticality >= 0.6"), (0.3, "ndvi <= 0.15"), (0.2, "planarity >= 0.7"), (0.1, "height_range > 3.0")],
    "road": [(0.4, "planarity >= 0.85"), (0.3, "ndvi <= 0.15"), (0.2, "abs(nz) > 0.9"), (0.1, "height < 1.0")],
    "water": [(0.5, "ndvi <= -0.05"), (0.3, "planarity >= 0.9"), (0.2, "height < 0.5")],
}
IN_PARCEL = [
    Stage("kind = 'forest'", "CASE WHEN ndvi >= 0.6 THEN 5 WHEN ndvi >= 0.5 THEN CASE WHEN height > 2 THEN 5 ELSE 4 END WHEN ndvi >= 0.4 THEN CASE WHEN height > 1 THEN 4 ELSE 3 END WHEN ndvi >= 0.3 THEN 3 ELSE 2 END"),
    Stage("kind = 'agriculture'", "CASE WHEN ndvi >= 0.4 THEN CASE WHEN height > 0.5 THEN 4 ELSE 3 END WHEN ndvi >= 0.2 THEN 3 ELSE 2 END"),
    Stage("kind = 'building'", "6"),
    Stage("kind = 'road'", "CASE WHEN ndvi > 0.3 AND height > 5 THEN 5 WHEN ndvi > 0.3 AND height > 2 THEN 4 WHEN planarity > 0.8 AND ndvi < 0.15 THEN 11 ELSE 2 END"),
    Stage("kind = 'water'", "9"),
    Stage("kind = 'mixed'", "CASE WHEN ndvi > 0.3 AND planarity < 0.6 AND curvature > 0.2 THEN CASE WHEN height > 2 THEN 5 WHEN height > 0.5 THEN 4 ELSE 3 END ELSE label END"),
]
#: Objects by predicate and density cluster: condition, reach, least neighbours, and a bound on the extent of a cluster.
OBJECTS = {
    "water_bodies": ("planarity >= 0.85 AND height <= 0.5 AND curvature <= 0.05 AND (ndvi IS NULL OR ndvi <= 0.15)", 2.0, 20, "long_side >= 0"),
    "bridges": ("height BETWEEN 3 AND 50 AND planarity >= 0.6 AND verticality <= 0.6", 3.0, 10, "long_side >= 10 AND short_side <= 50"),
    "railways": ("height BETWEEN -0.2 AND 2 AND planarity >= 0.5 AND linearity >= 0.2 AND (ndvi IS NULL OR ndvi <= 0.25)", 2.0, 10, "long_side >= 5"),
    "wires": ("height BETWEEN 5 AND 100 AND linearity >= 0.3 AND planarity <= 0.7 AND verticality <= 0.9 AND (ndvi IS NULL OR ndvi < 0.3)", 5.0, 5, "sqrt(long_side * long_side + short_side * short_side) >= 20"),
    "vehicles": ("height BETWEEN 0.5 AND 4 AND planarity >= 0.3 AND verticality <= 0.8 AND (ndvi IS NULL OR ndvi < 0.3)", 2.0, 5, "long_side * short_side BETWEEN 4 AND 50 AND n BETWEEN 10 AND 2000"),
}

_READ = {"geometry": "height planarity verticality nz curvature roughness", "building": "height planarity verticality nz anisotropy linearity", "height_planarity": "height planarity", "parts": "height planarity verticality nz", "transport": "height planarity roughness nz linearity"}


def rule_features(spark, d, read: str):
    """Points with the named features, all finite, and an index that is NULL where it is no number."""
    return features(spark, d, *read.split()).withColumn("ndvi", F.when(finite("ndvi"), F.col("ndvi")))


def _staged(rules, read: str):
    def query(spark, d):
        return stages.run(rule_features(spark, d, read), rules).select("point_id", "label")

    return query


geometry_labels = _staged(GEOMETRY, _READ["geometry"])
geometry_ndvi_labels = _staged([*GEOMETRY, *NDVI], _READ["geometry"])
building_labels = _staged(BUILDING, _READ["building"])
corrected_labels = _staged(CORRECTIONS, "height")
transport_labels = _staged(TRANSPORT, _READ["transport"])


def adaptive_labels(spark, d):
    """The five rules over the features a point has; 1 where none holds."""
    return stages.run(rule_features(spark, d, _READ["geometry"]), ADAPTIVE, "1").select("point_id", "label")


def building_parts(spark, d):
    """Parts of buildings: walls and flat roofs, the others keep their class."""
    return stages.run(rule_features(spark, d, _READ["parts"]), PARTS).select("point_id", "label")


def building_details(spark, d):
    """Detailed parts: chimneys, balconies, windows and kinds of roofs, against the height of roofs and the mean intensity of all buildings."""
    fs = cut(rule_features(spark, d, _READ["parts"]).select("point_id", "classification", "height", "planarity", "verticality", "nz", "intensity"))
    own = fs.where("classification = 6")
    roof = quantile.group_quantiles(own.withColumn("g", F.lit(1)), ["g"], "height", {"roof": 0.9}, 0.1).first()
    mean = own.agg(F.avg("intensity")).first()[0]
    at = fs.withColumns({"roof": F.lit(roof["roof"] if roof else None).cast("double"), "mean_intensity": F.lit(mean).cast("double")})
    return stages.run(at, [*PARTS, *DETAILS]).select("point_id", "label")


def comprehensive_labels(spark, d):
    """Geometry, index, regions in order of priority, and bands of height for what is left unclassified."""
    fs = rule_features(spark, d, _READ["geometry"])
    over = regions.priority_overlay(points(spark, d), table(spark, d, "polygons"), table(spark, d, "layer_codes")).select("point_id", F.col("label").alias("region"))
    at = fs.join(over, "point_id", "left")
    return stages.run(at, [*GEOMETRY, *NDVI, Stage("region IS NOT NULL", "region"), BASIC]).select("point_id", "label")


def surface_vegetation(spark, d):
    """Vegetation that hangs over roads, parking places, cemeteries and sports grounds, by height."""
    fs = rule_features(spark, d, "height")
    flat = table(spark, d, "polygons").where("layer IN ('roads', 'parking', 'cemeteries', 'sports')")
    over = near.inside(points(spark, d), flat).select(F.col("key_a").alias("point_id")).distinct().withColumn("over", F.lit(True))
    rule = Stage("over AND height > 2 AND coalesce(classification, 0) <> 2 AND (ndvi > 0.3 OR (ndvi IS NULL AND height > 3))", "CASE WHEN height <= 3 THEN 3 WHEN height <= 10 THEN 4 ELSE 5 END")
    return stages.run(fs.join(over, "point_id", "left"), [rule]).select("point_id", "label")


def safe_buildings(spark, d):
    """Points under a building's outline that are neither ground nor lower than half a metre over it."""
    fs = rule_features(spark, d, "height")
    held = near.inside(points(spark, d), table(spark, d, "polygons").where("layer = 'buildings'")).select(F.col("key_a").alias("point_id")).distinct()
    return fs.join(held, "point_id", "left_semi").where("coalesce(classification, 0) <> 2 AND height >= 0.5").select("point_id")


def signature_matches(spark, d):
    """How well each point fits the look of four classes, and the best of them (at least 0.7 of its bounds)."""
    fs = rule_features(spark, d, "curvature planarity nz verticality height")
    scores = {s.name: F.coalesce(s.share(), F.lit(0.0)) for s in SIGNATURES}
    return fs.select("point_id", *[F.round(c, 9).alias(n) for n, c in scores.items()], stages.best_score(scores, 0.7, "none")["kind"].alias("kind"))


def height_filter(spark, d):
    """Points between 2 and 30 m over the ground, bounds included."""
    return rule_features(spark, d, "height").where("height BETWEEN 2 AND 30").select("point_id", "height")


def confident_labels(spark, d):
    """Labels of the basic rule with a confidence; those below 0.6 become 0, and confidences scaled to 0.1..0.9."""
    fs = rule_features(spark, d, _READ["height_planarity"]).withColumn("c", F.when(F.col("height") < 0.5, 1 - F.col("height").cast("double") / 2).otherwise(F.col("planarity")))
    t = fs.agg(F.min("c").alias("lo"), F.max("c").alias("hi")).first()
    wide = t["hi"] is not None and t["hi"] > t["lo"]
    scaled = 0.1 + (F.col("c") - F.lit(t["lo"])) * (0.8 / (t["hi"] - t["lo"])) if wide else F.lit(0.5)
    return fs.select("point_id", F.when(F.col("c") < 0.6, 0).otherwise(F.coalesce("classification", F.lit(0))).alias("label"), scaled.alias("confidence"))


def simple_taxonomy(spark, d):
    """Classes in the simple taxonomy with the confidence of the mapping: 0.9 where one code leads there, 0.6 where several do, 0.4 for 'other'."""
    shared = {v: list(TO_SIMPLE.values()).count(v) for v in TO_SIMPLE.values()}
    to = F.coalesce(F.create_map(*[F.lit(x) for kv in TO_SIMPLE.items() for x in kv])[F.col("classification")], F.lit(14))
    sure = F.create_map(*[F.lit(x) for k, n in shared.items() for x in (k, 0.4 if k == 14 else 0.9 if n == 1 else 0.6)])
    return points(spark, d).select("point_id", to.alias("label")).withColumn("confidence", sure[F.col("label")])


def relaxed_spectral(spark, d):
    """The relaxed cascade over four bands for vegetation, and the confident one with its confidences."""
    n, r, g, bl = (F.col(c) for c in ("nir", "red", "green", "blue"))
    v = (n - r) / (n + r + 1e-8)
    relaxed = (v > 0.15) | ((n > 0.35) & (n / (r + 1e-8) > 1.5) & (v > 0)) | ((g > r) & (g > bl) & (v > 0.1) & (n > 0.3))
    veg = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - 0.3) / 0.3 + (n - 0.35) / 0.3))
    water = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(v + 0.1) / 0.2 + (0.2 - n) / 0.2))
    sure = F.when(water > 0.7, 9).when(veg > 0.7, 4).otherwise(1)
    return bands(spark, d).select(*KEYS, F.when(relaxed, 4).otherwise(1).alias("relaxed"), sure.alias("sure"), F.when(water > 0.7, water).when(veg > 0.7, veg).otherwise(0.0).alias("confidence"))


def _parcels(spark, d, fs):
    forest = near.inside(points(spark, d), table(spark, d, "polygons").where("layer = 'vegetation'")).select(F.col("key_a").alias("point_id")).distinct().withColumn("f", F.lit(1))
    at = cut(fs.join(forest, "point_id", "left"))
    mean = lambda c: (F.sum(F.round(F.col(c) * 10**6).cast("long")).cast("double") / F.count(c) / 10**6).alias(c)
    g = at.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), *[mean(c) for c in ("ndvi", "curvature", "planarity", "verticality", "height")], (F.max("height") - F.min("height")).alias("height_range"), F.count("f").alias("in_forest"))
    g = g.where("n >= 20").join(quantile.group_quantiles(at, ["file_id"], "nz", {"nz": 0.5}, 0.002).select("file_id", "nz"), "file_id")
    scores = {k: sum((F.when(F.coalesce(F.expr(c), F.lit(False)), w).otherwise(0.0) for w, c in tests[1:]), F.when(F.coalesce(F.expr(tests[0][1]), F.lit(False)), tests[0][0]).otherwise(0.0)) for k, tests in PARCELS.items()}
    return g.withColumn("best", stages.best_score(scores, 0.6, "mixed")).select("file_id", "n", F.col("best.kind").alias("kind"), F.col("best.score").alias("score"))


_PARCEL_READ = "curvature planarity verticality height nz"


def parcel_types(spark, d):
    """The kind of each group of at least 20 points by scores over its means; 'mixed' below 0.6."""
    return _parcels(spark, d, rule_features(spark, d, _PARCEL_READ))


def parcel_labels(spark, d):
    """Labels of the points of each group by its kind."""
    fs = cut(rule_features(spark, d, _PARCEL_READ).select("point_id", "file_id", "classification", "ndvi", *_PARCEL_READ.split()))
    return stages.run(fs.join(_parcels(spark, d, fs).select("file_id", "kind"), "file_id"), IN_PARCEL).select("point_id", "label")


def _objects(name: str):
    where, eps, least, bound = OBJECTS[name]
    read = "height planarity verticality curvature linearity"

    def query(spark, d):
        fs = cut(rule_features(spark, d, read).where(where).select("point_id", "x", "y", "z"))
        c = cluster.dbscan(fs, eps, least).where("cluster > 0").join(fs, "point_id")
        dx, dy = F.max("x") - F.min("x"), F.max("y") - F.min("y")
        g = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.greatest(dx, dy).alias("long_side"), F.least(dx, dy).alias("short_side"))
        return g.where(bound)

    query.__doc__ = f"Density clusters of the points that may be {name.replace('_', ' ')}, with their extents."
    return query


def plane_segments(spark, d):
    """Planes found among the points of buildings: by kind of slope, density clusters, and the points whose normal agrees with the cluster's mean."""
    fs = rule_features(spark, d, "nx ny nz planarity height").select("point_id", "x", "y", "z", "nx", "ny", "nz", "planarity", "height")
    fs = fs.withColumn("a", F.degrees(F.acos(F.least(F.lit(1.0), F.abs("nz"))))).where("planarity >= 0.6")
    kind = F.when((F.col("a") <= 10) & (F.col("height") >= 2), 1).when((F.col("a") >= 75) & (F.col("height") >= 0.5), 2).when((F.col("a") >= 15) & (F.col("a") <= 70) & (F.col("height") >= 2), 3)
    fs = cut(fs.withColumn("kind", kind).where("kind IS NOT NULL").drop("a"))
    out = None
    for k, eps, coherent in ((1, 1.0, 0.9), (2, 0.8, 0.9), (3, 1.2, 0.85)):
        own = fs.where(F.col("kind") == k)
        c = cut(cluster.dbscan(own.select("point_id", "x", "y", "z"), eps, 5).where("cluster > 0").join(own, "point_id"))
        up = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
        whole = lambda e: F.sum(F.round(e * 10**6).cast("long")).cast("double")
        m = c.groupBy("cluster").agg(*[whole(F.col(f"n{a}") * up).alias(f"m{a}") for a in "xyz"])
        length = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
        dot = F.abs(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz")) / length
        good = c.join(m, "cluster").where((length > 0) & (dot >= coherent))
        one = good.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1")).where("n >= 20").withColumn("kind", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", F.col("cluster").alias("plane"), "n", "z0", "z1")


def clean_points(spark, d, k: int = 12, deviations: float = 2.0, radius: float = 1.5, least: int = 2):
    """The chain of cleaning: points whose mean distance to their 12 nearest is no outlier, then those with enough others around."""
    ps = cut(points(spark, d).select("point_id", "x", "y", "z"))
    m = cut(knn.neighbourhoods(ps, k, knn.density_measures, "mean_distance double"))
    t = m.agg((F.avg("mean_distance") + deviations * F.stddev_pop("mean_distance")).alias("t")).first()["t"]
    kept = cut(ps.join(m.where(F.col("mean_distance") < F.lit(t)).select("point_id"), "point_id", "left_semi"))
    n = knn.within_radius(kept, radius).groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return kept.join(n, "point_id", "left_semi")


def cleaned(spark, d):
    return clean_points(spark, d).select("point_id")


def cleaned_voxels(spark, d):
    """The chain with its last step: one centroid per voxel of 2 m of what is left."""
    return voxel_downsample(clean_points(spark, d), 2.0)


def attracted_buildings(spark, d):
    """The building of each point: the one whose outline holds it, else the one whose centre is nearest within 10 m."""
    ps = points(spark, d)
    held = near.inside(ps, table(spark, d, "polygons").where("layer = 'buildings'")).groupBy("key_a").agg(F.min("key_b").alias("poly_id"))
    centres = table(spark, d, "fused_buildings").where(finite("centroid_x", "centroid_y")).select(F.col("building_id").alias("centre_id"), F.col("centroid_x").alias("cx0"), F.col("centroid_y").alias("cy0"))
    close = regions.nearest_centre(ps, centres, 10.0)
    at = ps.select("point_id").join(held, F.col("point_id") == F.col("key_a"), "left").join(close, "point_id", "left")
    return at.select("point_id", "poly_id", F.when(F.col("poly_id").isNull(), F.col("centre_id")).alias("attracted_id"))


def unit_patches(spark, d):
    """Coordinates of each file relative to its middle, over the greatest distance from it: within the unit sphere."""
    ps = cut(points(spark, d).select("point_id", "file_id", "x", "y", "z").where("file_id IS NOT NULL"))
    mid = lambda c: (F.sum(F.round(F.col(c) * 1000).cast("long")).cast("double") / F.count(c) / 1000).alias(f"m{c}")
    at = cut(ps.join(ps.groupBy("file_id").agg(*[mid(c) for c in "xyz"]), "file_id").select("point_id", "file_id", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"]))
    far = at.groupBy("file_id").agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("r"))
    unit = lambda c: F.when(F.col("r") > 0, F.col(c) / F.col("r")).otherwise(0.0).alias(f"u{c}")
    return at.join(far, "file_id").select("point_id", *[unit(c) for c in "xyz"])


def style_counts(spark, d):
    """How often each kind of feature is fetched, as counts and shares: a distribution of categories."""
    t = table(spark, d, "polygons").where("poly_id IS NOT NULL").select("poly_id", F.lower(F.trim("feature_type")).alias("style")).distinct()
    by = t.groupBy("style").agg(F.count(F.lit(1)).alias("n"))
    total = t.count()
    return by.withColumn("share", F.col("n") / F.lit(max(total, 1)))


QUERIES = {
    "geometry_labels": geometry_labels, "geometry_ndvi_labels": geometry_ndvi_labels, "building_labels": building_labels, "corrected_labels": corrected_labels, "transport_labels": transport_labels, "adaptive_labels": adaptive_labels,
    "building_parts": building_parts, "building_details": building_details, "comprehensive_labels": comprehensive_labels, "surface_vegetation": surface_vegetation, "safe_buildings": safe_buildings, "signature_matches": signature_matches,
    "height_filter": height_filter, "confident_labels": confident_labels, "simple_taxonomy": simple_taxonomy, "relaxed_spectral": relaxed_spectral, "parcel_types": parcel_types, "parcel_labels": parcel_labels,
    **{n: _objects(n) for n in OBJECTS}, "plane_segments": plane_segments, "cleaned": cleaned, "cleaned_voxels": cleaned_voxels, "attracted_buildings": attracted_buildings, "unit_patches": unit_patches, "style_counts": style_counts,
}


def _nested(rules: list[Stage], source: str, start: str = "classification") -> str:
    """The stages as nested selections over ``source``."""
    q = f"SELECT *, ({start})::INT AS label FROM {source}"
    for s in rules:
        q = f"SELECT * REPLACE (CASE WHEN coalesce({s.where}, false) THEN ({s.to})::INT ELSE label END AS label) FROM ({q})"
    return q


_R = ", R AS (SELECT * REPLACE (CASE WHEN isfinite(ndvi) THEN ndvi END AS ndvi) FROM F)"


def _labels(rules: list[Stage], read: str, source: str = "R", start: str = "classification", more: str = "") -> str:
    return f(f"SELECT point_id, label FROM ({_nested(rules, source, start)})", _R + more, read)


_WEIGHTS = {k: " + ".join(f"(CASE WHEN coalesce({c}, false) THEN {w}::DOUBLE ELSE 0 END)" for w, c in tests) for k, tests in PARCELS.items()}
_MEAN = lambda c: f"sum(round({c} * 1000000)::BIGINT)::DOUBLE / count({c}) / 1000000 AS {c}"
_PARCEL_SQL = (
    INSIDE
    + ", V AS (SELECT DISTINCT point_id FROM I WHERE poly_id IN (SELECT poly_id FROM polygons WHERE layer = 'vegetation')), G1 AS (SELECT file_id, count(*) AS n, "
    + ", ".join(_MEAN(c) for c in ("ndvi", "curvature", "planarity", "verticality", "height"))
    + ", max(height) - min(height) AS height_range, count(V.point_id) AS in_forest, quantile_cont(nz, 0.5) AS nz FROM R LEFT JOIN V USING (point_id) GROUP BY file_id HAVING count(*) >= 20), G2 AS (SELECT file_id, n, list_max(["
    + ", ".join(f"{{'score': round({w}, 9), 'o': {-i}, 'kind': '{k}'}}" for i, (k, w) in enumerate(_WEIGHTS.items()))
    + "]) AS best FROM G1), T1 AS (SELECT file_id, n, CASE WHEN best.score < 0.6 THEN 'mixed' ELSE best.kind END AS kind, best.score AS score FROM G2)"
)


def clusters_sql(source: str, eps: float, least: int, name: str) -> str:
    """``name``O(point_id, cluster): density clusters over a frame of points; 0 for noise. To be put behind WITH RECURSIVE."""
    return f""", {name}V AS (SELECT a.point_id AS a, b.point_id AS b FROM {source} AS a JOIN {source} AS b ON a.point_id <> b.point_id AND b.x BETWEEN a.x - {eps} AND a.x + {eps} AND b.y BETWEEN a.y - {eps} AND a.y + {eps}
      AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= {eps * eps}),
    {name}K AS (SELECT a AS id FROM {name}V GROUP BY a HAVING count(*) >= {least - 1}), {name}L AS (SELECT a, b FROM {name}V WHERE a IN (SELECT id FROM {name}K) AND b IN (SELECT id FROM {name}K)),
    {name}R AS (SELECT id, id AS low FROM {name}K UNION SELECT {name}L.a, {name}R.low FROM {name}L JOIN {name}R ON {name}R.id = {name}L.b WHERE {name}R.low < {name}L.a), {name}Z AS (SELECT id, min(low) AS low FROM {name}R GROUP BY id),
    {name}O AS (SELECT point_id, coalesce(z.low, e.low, 0) AS cluster FROM {source} LEFT JOIN {name}Z AS z ON z.id = point_id LEFT JOIN (SELECT a AS pid, min(low) AS low FROM {name}V JOIN {name}Z ON {name}Z.id = b GROUP BY a) AS e ON e.pid = point_id)"""


def _objects_sql(name: str) -> str:
    where, eps, least, bound = OBJECTS[name]
    q = f("", _R + f", U AS (SELECT point_id, x, y, z FROM R WHERE {where})" + clusters_sql("U", eps, least, "D"), "height planarity verticality curvature linearity")
    return f"WITH RECURSIVE {q[5:]} SELECT * FROM (SELECT cluster, count(*) AS n, greatest(max(x) - min(x), max(y) - min(y)) AS long_side, least(max(x) - min(x), max(y) - min(y)) AS short_side FROM DO_ JOIN U USING (point_id) WHERE cluster > 0 GROUP BY cluster) WHERE {bound}".replace("DO AS", "DO_ AS")


def _planes_sql() -> str:
    kinds = """, A1 AS (SELECT point_id, x, y, z, nx, ny, nz, height, degrees(acos(least(1, abs(nz)))) AS a FROM F WHERE planarity >= 0.6),
    B1 AS (SELECT *, CASE WHEN a <= 10 AND height >= 2 THEN 1 WHEN a >= 75 AND height >= 0.5 THEN 2 WHEN a >= 15 AND a <= 70 AND height >= 2 THEN 3 END AS kind FROM A1)"""
    parts = []
    for k, eps, coherent in ((1, 1.0, 0.9), (2, 0.8, 0.9), (3, 1.2, 0.85)):
        n = f"D{k}"
        kinds += f", U{k} AS (SELECT * FROM B1 WHERE kind = {k})" + clusters_sql(f"U{k}", eps, 5, n).replace(f"{n}O AS", f"{n}Q AS")
        kinds += f", {n}M AS (SELECT cluster, " + ", ".join(f"sum(round(n{a} * (CASE WHEN nz < 0 THEN -1.0::DOUBLE ELSE 1.0 END) * 1000000)::BIGINT)::DOUBLE AS m{a}" for a in "xyz") + f" FROM {n}Q JOIN U{k} USING (point_id) WHERE cluster > 0 GROUP BY cluster)"
        parts.append(f"SELECT {k} AS kind, cluster AS plane, count(*) AS n, min(z) AS z0, max(z) AS z1 FROM {n}Q JOIN U{k} USING (point_id) JOIN {n}M USING (cluster) WHERE sqrt(mx * mx + my * my + mz * mz) > 0 AND abs(nx * mx + ny * my + nz * mz) / sqrt(mx * mx + my * my + mz * mz) >= {coherent} GROUP BY cluster HAVING count(*) >= 20")
    q = f("", kinds, "nx ny nz planarity height")
    return f"WITH RECURSIVE {q[5:]} " + " UNION ALL ".join(parts)


_CLEAN = (
    nearest_sql("P", 12)
    + """, M1 AS (SELECT point_id, avg(d) AS m FROM N GROUP BY point_id), K1 AS (SELECT point_id, x, y, z, floor(x / 1.5)::BIGINT AS kx, floor(y / 1.5)::BIGINT AS ky FROM P WHERE point_id IN (SELECT point_id FROM M1 WHERE m < (SELECT avg(m) + 2.0 * stddev_pop(m) FROM M1))),
    Q1 AS (SELECT a.point_id FROM K1 AS a JOIN (SELECT point_id, x, y, z, kx + i AS kx, ky + j AS ky FROM K1, range(-1, 2) AS t1(i), range(-1, 2) AS t2(j)) AS b USING (kx, ky)
      WHERE a.point_id <> b.point_id AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 2.25 GROUP BY a.point_id HAVING count(*) >= 2)"""
)
_SHARES = {s.name: "coalesce((" + " + ".join(f"coalesce(({c})::INT, 0)" for c in s.checks()) + ")::DOUBLE / nullif(" + " + ".join(f"(({c}) IS NOT NULL)::INT" for c in s.checks()) + ", 0), 0)" for s in SIGNATURES}
_BAND = "(nir - red) / (nir + red + 1e-8)"
_CODES = {v: list(TO_SIMPLE.values()).count(v) for v in TO_SIMPLE.values()}
SQL = {
    "geometry_labels": _labels(GEOMETRY, _READ["geometry"]), "geometry_ndvi_labels": _labels([*GEOMETRY, *NDVI], _READ["geometry"]), "building_labels": _labels(BUILDING, _READ["building"]), "corrected_labels": _labels(CORRECTIONS, "height"),
    "transport_labels": _labels(TRANSPORT, _READ["transport"]), "adaptive_labels": _labels(ADAPTIVE, _READ["geometry"], start="1"), "building_parts": _labels(PARTS, _READ["parts"]),
    "building_details": _labels([*PARTS, *DETAILS], _READ["parts"], "W", more=", W AS (SELECT *, quantile_cont(height, 0.9) FILTER (classification = 6) OVER () AS roof, avg(intensity) FILTER (classification = 6) OVER () AS mean_intensity FROM R)"),
    "comprehensive_labels": _labels([*GEOMETRY, *NDVI, Stage("region IS NOT NULL", "region"), BASIC], _READ["geometry"], "W", more=INSIDE + """, W AS (SELECT R.*, g.region FROM R LEFT JOIN (SELECT point_id, l.asprs_class AS region, row_number() OVER (PARTITION BY point_id ORDER BY layer_priority DESC, l.layer DESC) AS place
        FROM I JOIN (SELECT DISTINCT poly_id, layer FROM polygons) USING (poly_id) JOIN layer_codes AS l USING (layer) QUALIFY place = 1) AS g USING (point_id))"""),
    "surface_vegetation": f("SELECT R.point_id, CASE WHEN s.point_id IS NOT NULL AND height > 2 AND coalesce(classification, 0) <> 2 AND (coalesce(ndvi > 0.3, false) OR (ndvi IS NULL AND height > 3)) THEN CASE WHEN height <= 3 THEN 3 WHEN height <= 10 THEN 4 ELSE 5 END ELSE classification END AS label FROM R LEFT JOIN (SELECT DISTINCT point_id FROM I WHERE poly_id IN (SELECT poly_id FROM polygons WHERE layer IN ('roads', 'parking', 'cemeteries', 'sports'))) AS s USING (point_id)", _R + INSIDE, "height"),
    "safe_buildings": f("SELECT point_id FROM R WHERE coalesce(classification, 0) <> 2 AND height >= 0.5 AND point_id IN (SELECT point_id FROM I WHERE poly_id IN (SELECT poly_id FROM polygons WHERE layer = 'buildings'))", _R + INSIDE, "height"),
    "signature_matches": f("SELECT point_id, " + ", ".join(f"round({n}, 9) AS {n}" for n in _SHARES) + ", CASE WHEN best.s < 0.7 THEN 'none' ELSE best.k END AS kind FROM (SELECT *, list_max([" + ", ".join(f"{{'s': round({n}, 9), 'o': {-i}, 'k': '{n}'}}" for i, n in enumerate(_SHARES)) + "]) AS best FROM (SELECT point_id, " + ", ".join(f"{e} AS {n}" for n, e in _SHARES.items()) + " FROM R))", _R, "curvature planarity nz verticality height"),
    "height_filter": f("SELECT point_id, height FROM F WHERE height >= 2 AND height <= 30", read="height"),
    "confident_labels": f("SELECT point_id, CASE WHEN c < 0.6 THEN 0 ELSE coalesce(classification, 0) END AS label, 0.1 + (c - min(c) OVER ()) * 0.8::DOUBLE / (max(c) OVER () - min(c) OVER ()) AS confidence FROM (SELECT *, CASE WHEN height < 0.5 THEN 1 - height / 2 ELSE planarity END AS c FROM F)", read="height planarity"),
    "simple_taxonomy": p("SELECT point_id, label, CASE label " + " ".join(f"WHEN {k} THEN {0.4 if k == 14 else 0.9 if n == 1 else 0.6}" for k, n in _CODES.items()) + " END::DOUBLE AS confidence FROM (SELECT point_id, CASE classification " + " ".join(f"WHEN {k} THEN {v}" for k, v in TO_SIMPLE.items()) + " ELSE 14 END AS label FROM P)"),
    "relaxed_spectral": b(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v > 0.15 OR (nir > 0.35 AND nir / (red + 1e-8) > 1.5 AND v > 0) OR (green > red AND green > blue AND v > 0.1 AND nir > 0.3) THEN 4 ELSE 1 END AS relaxed, CASE WHEN wa > 0.7 THEN 9 WHEN ve > 0.7 THEN 4 ELSE 1 END AS sure, CASE WHEN wa > 0.7 THEN wa WHEN ve > 0.7 THEN ve ELSE 0 END AS confidence
        FROM (SELECT *, greatest(0, least(1, (v - 0.3) / 0.3::DOUBLE + (nir - 0.35) / 0.3::DOUBLE)) AS ve, greatest(0, least(1, -(v + 0.1) / 0.2::DOUBLE + (0.2 - nir) / 0.2::DOUBLE)) AS wa FROM (SELECT *, {_BAND} AS v FROM B))"""),
    "parcel_types": f("SELECT * FROM T1", _R + _PARCEL_SQL, _PARCEL_READ),
    "parcel_labels": f(f"SELECT point_id, label FROM ({_nested(IN_PARCEL, '(SELECT R.*, kind FROM R JOIN T1 USING (file_id))')})", _R + _PARCEL_SQL, _PARCEL_READ),
    **{n: _objects_sql(n) for n in OBJECTS}, "plane_segments": _planes_sql(),
    "cleaned": p("SELECT point_id FROM Q1", _CLEAN),
    "cleaned_voxels": p("SELECT vx, vy, vz, " + ", ".join(f"sum(round({c} * 1000000)::BIGINT)::DOUBLE / count(*) / 1000000 AS {c}" for c in "xyz") + ", count(*) AS n, min(point_id) AS point_id FROM (SELECT *, floor(x / 2.0)::BIGINT AS vx, floor(y / 2.0)::BIGINT AS vy, floor(z / 2.0)::BIGINT AS vz FROM K1 JOIN Q1 USING (point_id)) GROUP BY vx, vy, vz", _CLEAN),
    "attracted_buildings": p("""SELECT P.point_id, h.poly_id, CASE WHEN h.poly_id IS NULL THEN c.building_id END AS attracted_id FROM P LEFT JOIN (SELECT point_id, min(poly_id) AS poly_id FROM I WHERE poly_id IN (SELECT poly_id FROM polygons WHERE layer = 'buildings') GROUP BY point_id) AS h USING (point_id)
        LEFT JOIN (SELECT point_id, building_id FROM (SELECT point_id, building_id, sqrt((x - centroid_x) ** 2 + (y - centroid_y) ** 2) AS d FROM P JOIN fused_buildings ON isfinite(centroid_x) AND isfinite(centroid_y) AND x BETWEEN centroid_x - 10 AND centroid_x + 10 AND y BETWEEN centroid_y - 10 AND centroid_y + 10) WHERE d <= 10 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, building_id) = 1) AS c USING (point_id)""", INSIDE),
    "unit_patches": p("""SELECT point_id, CASE WHEN r > 0 THEN x / r ELSE 0 END AS ux, CASE WHEN r > 0 THEN y / r ELSE 0 END AS uy, CASE WHEN r > 0 THEN z / r ELSE 0 END AS uz FROM (SELECT *, max(sqrt(x * x + y * y + z * z)) OVER (PARTITION BY file_id) AS r FROM (SELECT point_id, file_id, """ + ", ".join(f"{c} - sum(round({c} * 1000)::BIGINT) OVER (PARTITION BY file_id)::DOUBLE / count(*) OVER (PARTITION BY file_id) / 1000 AS {c}" for c in "xyz") + " FROM P WHERE file_id IS NOT NULL))"),
    "style_counts": "SELECT style, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM (SELECT DISTINCT poly_id, lower(trim(feature_type)) AS style FROM polygons WHERE poly_id IS NOT NULL) GROUP BY style",
}
