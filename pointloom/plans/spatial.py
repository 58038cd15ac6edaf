"""Queries of regions, lines, rasters and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import near, regions
from pointloom.plans.base import p, points
from pointloom.runtime import finite, settings, table

REACH = 1.0


def polygon_ids(spark, d):
    """Each point's first and last polygon (0 where none), and in how many it lies."""
    held = near.inside(points(spark, d), table(spark, d, "polygons"))
    by = held.groupBy("key_a").agg(F.min("key_b").alias("first_id"), F.max("key_b").alias("last_id"), F.count(F.lit(1)).alias("n"))
    all_ = points(spark, d).select("point_id").join(by, F.col("point_id") == F.col("key_a"), "left")
    return all_.select("point_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("first_id", "last_id", "n")])


def points_in_layer(spark, d):
    """Semi-join form: points in any building."""
    buildings = table(spark, d, "polygons").where("layer = 'buildings'")
    return near.inside(points(spark, d), buildings).select(F.col("key_a").alias("point_id")).distinct()


def priority_labels(spark, d):
    return regions.priority_overlay(points(spark, d), table(spark, d, "polygons"), table(spark, d, "layer_codes"))


def polygon_statistics(spark, d):
    """Per polygon: its points, their heights and their most frequent class (lowest on ties)."""
    held = near.inside(points(spark, d), table(spark, d, "polygons")).withColumnRenamed("key_a", "point_id").withColumnRenamed("key_b", "poly_id")
    j = held.join(points(spark, d).select("point_id", "z", "classification"), "point_id")
    by = j.groupBy("poly_id", "classification").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    best = F.max(F.when(F.col("classification").isNotNull(), F.struct("n", (-F.col("classification")).alias("m"))))
    return by.groupBy("poly_id").agg(F.sum("n").alias("points"), F.min("z0").alias("z0"), F.max("z1").alias("z1"), best.alias("b")).select("poly_id", "points", "z0", "z1", (-F.col("b.m")).alias("majority"))


def line_distances(spark, d):
    """Distance to the outline of each polygon within reach."""
    return regions.near_lines(points(spark, d), regions.edges(table(spark, d, "polygons")), REACH)


def buffered_mask(spark, d):
    roads = table(spark, d, "polygons").where("layer = 'roads'")
    return regions.within_buffer(points(spark, d), roads, REACH)


def nearest_buildings(spark, d):
    c = table(spark, d, "fused_buildings").where(finite("centroid_x", "centroid_y")).select(F.col("building_id").alias("centre_id"), F.col("centroid_x").alias("cx0"), F.col("centroid_y").alias("cy0"))
    return regions.nearest_centre(points(spark, d), c, 10.0)


def terrain_heights(spark, d):
    """Heights above a raster of the ground (the lowest ground point of 2 m cells, or the nearest such cell within 10 m)."""
    ps = points(spark, d)
    ground = regions.raster(ps.where("classification = 2"), F.min("z"), 2.0)
    at = regions.sample_raster(ps, ground, 2.0)
    return ps.select("point_id", "z").join(at, "point_id").select("point_id", (F.col("z") - F.col("value")).alias("above"))


def _tiles(spark, d):
    t = points(spark, d).groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return t


def touching_tiles(spark, d):
    return regions.touching_tiles(_tiles(spark, d))


def tile_halos(spark, d):
    """Per tile: core points and points of the buffer around it."""
    h = regions.with_halo(points(spark, d), _tiles(spark, d), 5.0)
    return h.groupBy("tile").agg(F.count_if("is_core").alias("core"), F.count_if(~F.col("is_core")).alias("halo"))


def boundary_points(spark, d):
    """Points at most 1 m from a side of their tile's extent."""
    ps = points(spark, d).join(_tiles(spark, d), "tile")
    rim = F.least(F.col("x") - F.col("x0"), F.col("x1") - F.col("x"), F.col("y") - F.col("y0"), F.col("y1") - F.col("y"))
    return ps.where(rim <= 1.0).select("point_id", "tile")


def bbox_filter(spark, d):
    """Closed bounding boxes of the fetches as a filter: points inside the extent of any successful fetch, per layer."""
    f = table(spark, d, "fetches").where(F.col("fetch_status").isin("success", "cache_hit") & finite("xmin", "ymin", "xmax", "ymax")).select("layer", "xmin", "ymin", "xmax", "ymax").distinct()
    for c in "xy":
        f = f.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}min") / 100).cast("long"), F.floor(F.col(f"{c}max") / 100).cast("long"))))
    ps = points(spark, d).select("point_id", "x", "y", F.floor(F.col("x") / 100).cast("long").alias("cx"), F.floor(F.col("y") / 100).cast("long").alias("cy"))
    met = ps.join(f, ["cx", "cy"]).where(F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax")))
    return met.select("layer", "point_id").distinct().groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def near_counts(spark, d):
    """How many points have a neighbour within NEAR_M, by file."""
    pairs = near.near_pairs(points(spark, d), settings(spark, d)["near_m"])
    ids = pairs.select("key_a").union(pairs.select("key_b")).distinct().withColumnRenamed("key_a", "point_id")
    return points(spark, d).select("point_id", "file_id").join(ids, "point_id").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "polygon_ids": polygon_ids, "points_in_layer": points_in_layer, "priority_labels": priority_labels, "polygon_statistics": polygon_statistics, "line_distances": line_distances, "buffered_mask": buffered_mask,
    "nearest_buildings": nearest_buildings, "terrain_heights": terrain_heights, "touching_tiles": touching_tiles, "tile_halos": tile_halos, "boundary_points": boundary_points, "bbox_filter": bbox_filter, "near_counts": near_counts,
}

INSIDE = """, G AS (SELECT poly_id, ring, [h FOR h IN coalesce(holes, []) IF len(list_distinct(h)) >= 3] AS holes, list_min([c.x FOR c IN ring]) AS gx0, list_max([c.x FOR c IN ring]) AS gx1, list_min([c.y FOR c IN ring]) AS gy0, list_max([c.y FOR c IN ring]) AS gy1
      FROM (SELECT DISTINCT poly_id, ring, holes FROM polygons WHERE ring IS NOT NULL AND len(list_distinct(ring)) >= 3)),
E AS (SELECT poly_id, 0 AS part, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM (SELECT poly_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM G)
      UNION ALL SELECT poly_id, part, h[i], h[i % len(h) + 1] FROM (SELECT poly_id, part, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT poly_id, unnest(range(1, len(holes) + 1)) AS part, unnest(holes) AS h FROM G))),
H AS (SELECT point_id, poly_id, part, count(*) % 2 AS odd FROM (SELECT point_id, x, y, poly_id FROM P JOIN G ON x BETWEEN gx0 AND gx1 AND y BETWEEN gy0 AND gy1) AS c JOIN E USING (poly_id)
      WHERE (a.y > c.y) <> (b.y > c.y) AND c.x < (b.x - a.x) * (c.y - a.y) / (b.y - a.y) + a.x GROUP BY ALL),
I AS (SELECT point_id, poly_id FROM H GROUP BY ALL HAVING max(CASE WHEN part = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN part > 0 THEN odd ELSE 0 END) = 0)
"""
SEGMENTS = """, S AS (SELECT DISTINCT poly_id, layer, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM (SELECT poly_id, layer, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM (
      SELECT poly_id, layer, ring, unnest(range(1, len(ring) + 1)) AS i FROM polygons WHERE ring IS NOT NULL AND len(ring) >= 2)) WHERE a.x <> b.x OR a.y <> b.y),
T AS (SELECT point_id, poly_id, layer, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t
      FROM P JOIN S ON x BETWEEN least(x1, x2) - 1.0 AND greatest(x1, x2) + 1.0 AND y BETWEEN least(y1, y2) - 1.0 AND greatest(y1, y2) + 1.0),
D AS (SELECT point_id, poly_id, layer, sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2) AS distance FROM T)
"""
TILES = ", T AS (SELECT tile, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM P GROUP BY tile)"
SQL = {
    "polygon_ids": p("SELECT point_id, coalesce(min(poly_id), 0) AS first_id, coalesce(max(poly_id), 0) AS last_id, count(poly_id) AS n FROM P LEFT JOIN I USING (point_id) GROUP BY point_id", INSIDE),
    "points_in_layer": p("SELECT DISTINCT point_id FROM I WHERE poly_id IN (SELECT poly_id FROM polygons WHERE layer = 'buildings')", INSIDE),
    "priority_labels": p(
        """SELECT point_id, layer, asprs_class AS label FROM (SELECT point_id, l.layer, l.asprs_class, row_number() OVER (PARTITION BY point_id ORDER BY layer_priority DESC, l.layer DESC) AS r FROM I JOIN (SELECT DISTINCT poly_id, layer FROM polygons) USING (poly_id) JOIN layer_codes AS l USING (layer)) WHERE r = 1""", INSIDE),
    "polygon_statistics": p(
        """SELECT poly_id, count(*) AS points, min(z) AS z0, max(z) AS z1, any_value(majority) AS majority FROM I JOIN P USING (point_id) LEFT JOIN (SELECT poly_id, classification AS majority FROM (SELECT poly_id, classification, row_number() OVER (PARTITION BY poly_id ORDER BY n DESC, classification) AS r
        FROM (SELECT poly_id, classification, count(*) AS n FROM I JOIN P USING (point_id) WHERE classification IS NOT NULL GROUP BY ALL)) WHERE r = 1) USING (poly_id) GROUP BY poly_id""", INSIDE),
    "line_distances": p("SELECT point_id, poly_id, min(distance) AS distance FROM D WHERE distance <= 1.0 GROUP BY ALL", SEGMENTS),
    "buffered_mask": p("SELECT point_id FROM D WHERE layer = 'roads' AND distance <= 1.0 UNION SELECT point_id FROM I WHERE poly_id IN (SELECT poly_id FROM polygons WHERE layer = 'roads')", INSIDE + SEGMENTS),
    "nearest_buildings": p(
        """SELECT point_id, building_id AS centre_id, d AS distance FROM (SELECT point_id, building_id, sqrt((x - centroid_x) ** 2 + (y - centroid_y) ** 2) AS d FROM P JOIN fused_buildings ON isfinite(centroid_x) AND isfinite(centroid_y) AND x BETWEEN centroid_x - 10 AND centroid_x + 10 AND y BETWEEN centroid_y - 10 AND centroid_y + 10)
        WHERE d <= 10 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, building_id) = 1"""),
    "terrain_heights": p(
        """SELECT point_id, z - value AS above FROM (SELECT *, floor(y / 2)::BIGINT AS r, floor(x / 2)::BIGINT AS c FROM P) JOIN R USING (r, c) UNION ALL
        SELECT point_id, z - value AS above FROM (SELECT q.point_id, q.z, o.value, row_number() OVER (PARTITION BY q.point_id ORDER BY sqrt((q.x - (o.c + 0.5) * 2) * (q.x - (o.c + 0.5) * 2) + (q.y - (o.r + 0.5) * 2) * (q.y - (o.r + 0.5) * 2)), o.r, o.c) AS k
        FROM (SELECT * FROM (SELECT *, floor(y / 2)::BIGINT AS r, floor(x / 2)::BIGINT AS c FROM P) ANTI JOIN R USING (r, c)) AS q JOIN (SELECT r + i AS near_r, c + j AS near_c, r, c, value FROM R, range(-6, 7) AS a(i), range(-6, 7) AS b(j)) AS o ON o.near_r = q.r AND o.near_c = q.c
        WHERE sqrt((q.x - (o.c + 0.5) * 2) * (q.x - (o.c + 0.5) * 2) + (q.y - (o.r + 0.5) * 2) * (q.y - (o.r + 0.5) * 2)) <= 10) WHERE k = 1 UNION ALL
        SELECT point_id, NULL FROM (SELECT *, floor(y / 2)::BIGINT AS r, floor(x / 2)::BIGINT AS c FROM P) AS q WHERE NOT EXISTS (FROM R WHERE sqrt((q.x - (R.c + 0.5) * 2) * (q.x - (R.c + 0.5) * 2) + (q.y - (R.r + 0.5) * 2) * (q.y - (R.r + 0.5) * 2)) <= 10) AND NOT EXISTS (FROM R WHERE R.r = q.r AND R.c = q.c)""",
        ", R AS (SELECT floor(y / 2)::BIGINT AS r, floor(x / 2)::BIGINT AS c, min(z) AS value FROM P WHERE classification = 2 GROUP BY 1, 2)"),
    "touching_tiles": p(
        """SELECT a.tile AS tile_a, b.tile AS tile_b FROM T AS a JOIN T AS b ON a.tile < b.tile WHERE (least(abs(a.x1 - b.x0), abs(b.x1 - a.x0)) <= 10 AND a.y0 < b.y1 AND b.y0 < a.y1) OR (least(abs(a.y1 - b.y0), abs(b.y1 - a.y0)) <= 10 AND a.x0 < b.x1 AND b.x0 < a.x1)""", TILES),
    "tile_halos": p(
        """SELECT t.tile, count(*) FILTER (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS core, count(*) FILTER (NOT (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)) AS halo FROM T AS t JOIN P ON x BETWEEN x0 - 5 AND x1 + 5 AND y BETWEEN y0 - 5 AND y1 + 5 GROUP BY t.tile""", TILES),
    "boundary_points": p("SELECT point_id, tile FROM P JOIN T USING (tile) WHERE least(x - x0, x1 - x, y - y0, y1 - y) <= 1.0", TILES),
    "bbox_filter": p(
        """SELECT layer, count(DISTINCT point_id) AS n FROM P JOIN fetches ON fetch_status IN ('success', 'cache_hit') AND isfinite(xmin) AND isfinite(ymin) AND isfinite(xmax) AND isfinite(ymax) AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY layer"""),
    "near_counts": p(
        """SELECT file_id, count(DISTINCT point_id) AS n FROM (SELECT a.point_id, a.file_id FROM C AS a JOIN (SELECT point_id, x, y, z, m, cx + i AS cx, cy + j AS cy, cz + k AS cz FROM C, range(-1, 2) AS a(i), range(-1, 2) AS b(j), range(-1, 2) AS d(k)) AS b USING (cx, cy, cz)
        WHERE a.point_id <> b.point_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= a.m * a.m) GROUP BY file_id""",
        ", C AS (SELECT P.*, setting_value AS m, floor(x / setting_value)::BIGINT AS cx, floor(y / setting_value)::BIGINT AS cy, floor(z / setting_value)::BIGINT AS cz FROM P, settings WHERE setting = 'near_m')"),
}
