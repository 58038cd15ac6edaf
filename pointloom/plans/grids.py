"""Queries of cells, groups and label quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import grid, quality, quantile
from pointloom.operators.frames import FEATURE, current_features
from pointloom.plans.base import f, features, p, points
from pointloom.runtime import cut, table


def voxel_centroids(spark, d):
    return grid.voxel_downsample(points(spark, d), 2.0)


def voxel_labels(spark, d):
    return grid.voxel_majority(points(spark, d).where("classification IS NOT NULL"), 2.0)


def height_map(spark, d):
    return grid.heat_map(points(spark, d), "z", 5.0)


def ground_density(spark, d):
    return grid.ground_density(points(spark, d), 5.0)


def ground_gaps(spark, d):
    return grid.ground_gaps(points(spark, d), 5.0, 0.5)


def spatial_artifacts(spark, d):
    return grid.spatial_artifacts(points(spark, d), "z")


def dash_lines(spark, d):
    return grid.dash_lines(points(spark, d), "z")


def class_distribution(spark, d):
    return quality.distribution(points(spark, d), "classification")


def tile_statistics(spark, d):
    p = cut(points(spark, d).select("tile", "x", "y", "z", "intensity", "classification"))
    q = quantile.group_quantiles(p, ["tile"], "z", {"p25_z": 0.25, "median_z": 0.5, "p75_z": 0.75, "p90_z": 0.9}, 0.25).drop("n")
    return p.groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"), *[g(c).alias(f"{c}{i}") for c in "xyz" for i, g in ((0, F.min), (1, F.max))], F.avg("intensity").alias("mean_intensity"), F.stddev_pop("z").alias("std_z"),
        F.count_if(F.col("classification") == 2).alias("ground"),
    ).join(q, "tile")


def file_info(spark, d):
    """Per loaded file: points, extent and times, beside what the registry's latest row says."""
    p = points(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), *[g(c).alias(f"{c}{i}") for c in "xy" for i, g in ((0, F.min), (1, F.max))], (F.max("gps_time") - F.min("gps_time")).alias("seconds"))
    r = table(spark, d, "lidar_files").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("loaded_at", "num_points")).alias("r"))
    return p.join(r, "file_id", "left").select("file_id", "n", "x0", "x1", "y0", "y1", "seconds", F.col("r.num_points").alias("stated"), (F.col("r.num_points") == F.col("n")).alias("agrees"))


def group_features(spark, d):
    """Per file (a group of points): area, density, means, deviations, range and median of the features."""
    fs = cut(features(spark, d, "height", "planarity", "curvature", "nz").select("file_id", "x", "y", "height", "planarity", "curvature", "nz"))
    g = fs.groupBy("file_id")
    q = quantile.group_quantiles(fs, ["file_id"], "nz", {"median_nz": 0.5}, 0.002).select("file_id", "median_nz")
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    out = g.agg(
        F.count(F.lit(1)).alias("n"), area.alias("raw_area"), F.avg("height").alias("mean_height"), F.stddev_pop("height").alias("std_height"), (F.max("height") - F.min("height")).alias("range_height"),
        F.avg("planarity").alias("mean_planarity"), F.avg("curvature").alias("mean_curvature"),
    ).join(q, "file_id")
    out = out.withColumn("area", F.when(F.col("raw_area") > 0, F.col("raw_area")).otherwise(1.0))
    return out.select("file_id", "n", "area", (F.col("n") / F.col("area")).alias("point_density"), "mean_height", "std_height", "range_height", "mean_planarity", "mean_curvature", "median_nz")


def _predicted(spark, d):
    """Stored labels against those of a simple height rule."""
    h = F.col("height")
    rule = F.when(h < 0.5, 2).when(h < 2, 3).when(h < 5, 4).when(F.col("planarity") > 0.7, 6).otherwise(5)
    return features(spark, d, "height", "planarity").withColumn("predicted", rule)


def confusion(spark, d):
    return quality.confusion(_predicted(spark, d), "classification", "predicted")


def class_metrics(spark, d):
    return quality.class_metrics(confusion(spark, d))


def agreement(spark, d):
    return quality.agreement(confusion(spark, d))


def confused_pairs(spark, d):
    return quality.confused_pairs(confusion(spark, d))


def _calibration(spark, d):
    return quality.calibration(_predicted(spark, d).where("classification IS NOT NULL").withColumn("correct", F.col("classification") == F.col("predicted")), "planarity", "correct")


def calibration(spark, d):
    return _calibration(spark, d)


def calibration_error(spark, d):
    return quality.calibration_error(_calibration(spark, d))


def feature_statistics(spark, d):
    return quality.column_statistics(current_features(table(spark, d, "point_features")), FEATURE)


QUERIES = {
    "voxel_centroids": voxel_centroids, "voxel_labels": voxel_labels, "height_map": height_map, "ground_density": ground_density, "ground_gaps": ground_gaps, "spatial_artifacts": spatial_artifacts, "dash_lines": dash_lines,
    "class_distribution": class_distribution, "tile_statistics": tile_statistics, "file_info": file_info, "group_features": group_features, "confusion": confusion, "class_metrics": class_metrics, "agreement": agreement,
    "confused_pairs": confused_pairs, "calibration": calibration, "calibration_error": calibration_error, "feature_statistics": feature_statistics,
}

_C = ", ".join(f"floor({c} / 2.0)::BIGINT AS v{c}" for c in "xyz")
_HP = "height planarity"
_PRED = ", Q AS (SELECT *, CASE WHEN height < 0.5 THEN 2 WHEN height < 2 THEN 3 WHEN height < 5 THEN 4 WHEN planarity > 0.7 THEN 6 ELSE 5 END AS predicted FROM F), M AS (SELECT classification AS reference, predicted, count(*) AS n FROM Q WHERE classification IS NOT NULL GROUP BY ALL)"
_CAL = (
    _PRED
    + """, K AS (SELECT least(9, floor(planarity * 10))::INT AS bin, count(*) AS n, avg((classification = predicted)::INT) AS accuracy, avg(planarity) AS confidence FROM Q WHERE classification IS NOT NULL AND planarity BETWEEN 0 AND 1 GROUP BY 1),
C AS (SELECT s.bin::INT AS bin, coalesce(n, 0) AS n, coalesce(accuracy, 0) AS accuracy, coalesce(confidence, (s.bin + 0.5) / 10) AS confidence FROM range(10) AS s(bin) LEFT JOIN K USING (bin))"""
)


def _bins(axis: str, bins: int) -> str:
    return f"""(SELECT *, CASE WHEN b > a THEN floor(({axis} - a) * {bins} / (b - a)) + 1 ELSE {bins + 1} END::INT AS bin FROM (SELECT *, min({axis}) OVER (PARTITION BY tile) AS a, max({axis}) OVER (PARTITION BY tile) AS b FROM P))"""


def _cv(axis: str) -> str:
    return f"""(SELECT tile, CASE WHEN avg(m) > 1e-10 THEN stddev_pop(m) / avg(m) ELSE 0 END AS cv_{axis} FROM (SELECT tile, bin, sum(round(z * 1000000)::BIGINT)::DOUBLE / count(z) / 1000000 AS m FROM {_bins(axis, 50)} WHERE bin <= 50 GROUP BY ALL HAVING count(*) > 10) GROUP BY tile)"""


SQL = {
    "voxel_centroids": p(f"SELECT vx, vy, vz, sum(round(x * 1000000)::BIGINT)::DOUBLE / count(x) / 1000000 AS x, sum(round(y * 1000000)::BIGINT)::DOUBLE / count(y) / 1000000 AS y, sum(round(z * 1000000)::BIGINT)::DOUBLE / count(z) / 1000000 AS z, count(*) AS n, min(point_id) AS point_id FROM (SELECT *, {_C} FROM P) GROUP BY vx, vy, vz"),
    "voxel_labels": p(
        f"""SELECT vx, vy, vz, classification AS label, points, mean_intensity FROM (SELECT vx, vy, vz, classification, n, sum(n) OVER w AS points, (sum(s) OVER w)::DOUBLE / (sum(c) OVER w) / 1000000 AS mean_intensity, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY n DESC, classification) AS r
        FROM (SELECT vx, vy, vz, classification, count(*) AS n, sum(round(intensity * 1000000)::BIGINT) AS s, count(intensity) AS c FROM (SELECT *, {_C} FROM P WHERE classification IS NOT NULL) GROUP BY ALL) WINDOW w AS (PARTITION BY vx, vy, vz)) WHERE r = 1"""),
    "height_map": p("SELECT floor(x / 5)::BIGINT AS bx, floor(y / 5)::BIGINT AS by, sum(round(z * 1000000)::BIGINT)::DOUBLE / count(z) / 1000000 AS mean, count(z) AS n FROM P GROUP BY 1, 2"),
    "ground_density": p("SELECT floor(x / 5)::BIGINT AS gx, floor(y / 5)::BIGINT AS gy, count(*) AS n, count(*) FILTER (classification = 2) AS ground, count(*) FILTER (classification = 2) / 25.0 AS density FROM P GROUP BY 1, 2"),
    "ground_gaps": p(
        """SELECT tile, gx, gy, coalesce(ground, 0) / 25.0 AS density FROM (SELECT tile, gx, unnest(range(y0, y1 + 1)) AS gy FROM (SELECT tile, y0, y1, unnest(range(x0, x1 + 1)) AS gx FROM (
        SELECT tile, min(floor(x / 5))::BIGINT AS x0, max(floor(x / 5))::BIGINT AS x1, min(floor(y / 5))::BIGINT AS y0, max(floor(y / 5))::BIGINT AS y1 FROM P GROUP BY tile)))
        LEFT JOIN (SELECT tile, floor(x / 5)::BIGINT AS gx, floor(y / 5)::BIGINT AS gy, count(*) AS ground FROM P WHERE classification = 2 GROUP BY ALL) USING (tile, gx, gy) WHERE coalesce(ground, 0) / 25.0 < 0.5"""),
    "spatial_artifacts": p(
        f"""SELECT tile, coalesce(cv_x, 0) AS cv_x, coalesce(cv_y, 0) AS cv_y, greatest(coalesce(cv_x, 0), coalesce(cv_y, 0)) AS max_cv,
        CASE WHEN greatest(coalesce(cv_x, 0), coalesce(cv_y, 0)) < 0.1 THEN 'low' WHEN greatest(coalesce(cv_x, 0), coalesce(cv_y, 0)) < 0.2 THEN 'medium' WHEN greatest(coalesce(cv_x, 0), coalesce(cv_y, 0)) < 0.35 THEN 'high' ELSE 'severe' END AS severity
        FROM {_cv('x')} FULL JOIN {_cv('y')} USING (tile)"""),
    "dash_lines": p(
        f"""SELECT tile, bin, m AS mean FROM (SELECT *, lag(off) OVER o AS before, lead(off) OVER o AS after FROM (SELECT *, abs(m - avg(m) OVER w) AS off, stddev_pop(m) OVER w AS s, count(*) OVER w AS k FROM (
        SELECT tile, bin, sum(round(z * 1000000)::BIGINT)::DOUBLE / count(z) / 1000000 AS m FROM {_bins('y', 100)} WHERE bin <= 100 GROUP BY ALL HAVING count(*) > 5) WINDOW w AS (PARTITION BY tile)) WINDOW o AS (PARTITION BY tile ORDER BY bin))
        WHERE k >= 3 AND off > s AND (coalesce(before, 0) > 0.5 * s OR coalesce(after, 0) > 0.5 * s OR off > 2 * s)"""),
    "class_distribution": p("SELECT classification, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM P GROUP BY classification"),
    "tile_statistics": p(
        """SELECT tile, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, avg(intensity) AS mean_intensity, stddev_pop(z) AS std_z, quantile_cont(z, 0.25) AS p25_z, quantile_cont(z, 0.5) AS median_z,
        quantile_cont(z, 0.75) AS p75_z, quantile_cont(z, 0.9) AS p90_z, count(*) FILTER (classification = 2) AS ground FROM P GROUP BY tile"""),
    "file_info": p(
        """SELECT file_id, n, x0, x1, y0, y1, seconds, num_points AS stated, num_points = n AS agrees FROM (SELECT file_id, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(gps_time) - min(gps_time) AS seconds FROM P GROUP BY file_id)
        LEFT JOIN (SELECT file_id, num_points FROM lidar_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST, num_points DESC NULLS LAST) = 1) USING (file_id)"""),
    "group_features": f(
        """SELECT file_id, n, area, n / area AS point_density, mean_height, std_height, range_height, mean_planarity, mean_curvature, median_nz FROM (SELECT file_id, count(*) AS n,
        CASE WHEN (max(x) - min(x)) * (max(y) - min(y)) > 0 THEN (max(x) - min(x)) * (max(y) - min(y)) ELSE 1 END AS area, avg(height) AS mean_height, stddev_pop(height) AS std_height, max(height) - min(height) AS range_height,
        avg(planarity) AS mean_planarity, avg(curvature) AS mean_curvature, quantile_cont(nz, 0.5) AS median_nz FROM F GROUP BY file_id)""", read="height planarity curvature nz"),
    "confusion": f("SELECT * FROM M", _PRED, _HP),
    "class_metrics": f(
        """SELECT label, support, found, coalesce(tp / nullif(found, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(found + support, 0), 0) AS f1, coalesce(tp / nullif(found + support - tp, 0), 0) AS iou
        FROM (SELECT coalesce(a.label, b.label) AS label, coalesce(support, 0)::BIGINT AS support, coalesce(found, 0)::BIGINT AS found, coalesce(tp, 0)::DOUBLE AS tp FROM (SELECT reference AS label, sum(n) AS support, sum(n) FILTER (reference = predicted) AS tp FROM M GROUP BY 1) AS a
        FULL JOIN (SELECT predicted AS label, sum(n) AS found FROM M GROUP BY 1) AS b USING (label))""", _PRED, _HP),
    "agreement": f(
        """SELECT n::BIGINT AS n, po AS accuracy, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 0 END AS kappa FROM (SELECT sum(n) AS n, sum(n) FILTER (reference = predicted) / sum(n)::DOUBLE AS po FROM M),
        (SELECT sum(r::DOUBLE * c) / any_value(t) / any_value(t) AS pe FROM (SELECT reference AS label, sum(n) AS r FROM M GROUP BY 1) JOIN (SELECT predicted AS label, sum(n) AS c FROM M GROUP BY 1) USING (label), (SELECT sum(n)::DOUBLE AS t FROM M))""", _PRED, _HP),
    "confused_pairs": f("SELECT least(reference, predicted) AS label_a, greatest(reference, predicted) AS label_b, sum(n)::BIGINT AS n FROM M WHERE reference <> predicted GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5", _PRED, _HP),
    "calibration": f("SELECT * FROM C", _CAL, _HP),
    "calibration_error": f("SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM C", _CAL, _HP),
    "feature_statistics": "WITH L AS (SELECT * FROM point_features WHERE point_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY enriched_at DESC NULLS LAST) = 1) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS least, max(v) AS greatest, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (isnan({c})) AS nans, count(*) FILTER (isinf({c})) AS infs
        FROM (SELECT *, CASE WHEN isfinite({c}) THEN {c}::DOUBLE END AS v FROM L)""" for c in FEATURE),
}
