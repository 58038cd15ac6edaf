"""Queries of the core over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import heavy, near, quantile
from pointloom.plans import grids, labels, neighbours, objects, reports, scalars, sets, spatial, stages
from pointloom.runtime import cut, settings, table


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """The different measurements of ``polygon_quality``: rows repeated exactly count once."""
    q = table(spark, d, "polygon_quality").select("quality_id", "building_id", "points_inside", "quality_score")
    return q.dropDuplicates(["quality_id"])


def p5_buildings(spark: SparkSession, d: str) -> DataFrame:
    """Per building: measurements, points inside and their relation to ``n_points``."""
    share = settings(spark, d)["heavy_share"]
    sums = {"n_measurements": F.count(F.lit(1)), "sum_points_inside": F.sum("points_inside"), "best_score": F.max("quality_score"), "n_above": F.count_if(F.col("points_inside") > F.col("n_points"))}
    b = table(spark, d, "fused_buildings").select("building_id", "n_points")
    out = heavy.per_key(cut(measurements(spark, d)), b, "building_id", sums, share)
    ratio = F.when(F.col("n_points") > 0, F.col("sum_points_inside") / F.col("n_points"))
    return out.select("building_id", "n_points", F.coalesce("n_measurements", F.lit(0)).alias("n_measurements"), "sum_points_inside", "best_score", F.coalesce("n_above", F.lit(0)).alias("n_above"), ratio.alias("inside_ratio"))


def p5_medians(spark: SparkSession, d: str) -> DataFrame:
    """Per building the median and the 90th percentile of its scores, and its different sources: measures whose parts don't combine."""
    m = cut(table(spark, d, "polygon_quality").select("quality_id", "building_id", "bld_source", "quality_score").dropDuplicates(["quality_id"]).where("building_id IS NOT NULL"))
    q = quantile.group_quantiles(m, ["building_id"], "quality_score", {"median_score": 0.5, "p90_score": 0.9}, 0.001)
    s = heavy.distinct_per_key(m.withColumn("source", F.lower(F.trim("bld_source"))), "building_id", "source")
    return q.join(s.withColumnRenamed("n", "sources"), "building_id", "left").select("building_id", "n", "median_score", "p90_score", F.coalesce("sources", F.lit(0)).alias("sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Buildings with more than HEAVY_SHARE of all different measurements."""
    share = settings(spark, d)["heavy_share"]
    facts = cut(measurements(spark, d).select("quality_id", "building_id"))
    total = facts.count()
    b = table(spark, d, "fused_buildings").select("building_id").distinct()
    out = heavy.per_key(facts, b, "building_id", {"n": F.count(F.lit(1))}, share)
    return out.where(F.col("n") > F.lit(share) * total).select("building_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Points within NEAR_M of each other, and polygons that hold points."""
    points = table(spark, d, "points")
    pairs = near.near_pairs(points, settings(spark, d)["near_m"])
    held = near.inside(points, table(spark, d, "polygons"))
    return pairs.withColumn("relation", F.lit("near")).unionByName(held.withColumn("relation", F.lit("inside"))).select("relation", "key_a", "key_b")


_PLANS = (scalars, grids, spatial, neighbours, labels, sets, objects, stages, reports)
QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_buildings": p5_buildings, "p5_medians": p5_medians, **{n: q for m in _PLANS for n, q in m.QUERIES.items()}}

_QUALITY = "(SELECT DISTINCT quality_id, building_id, points_inside, quality_score FROM polygon_quality)"

SQL = {
    "p4_found": """
WITH r AS (SELECT setting_value AS m FROM settings WHERE setting = 'near_m'),
p AS (SELECT DISTINCT point_id, x, y, z FROM points WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
c AS (SELECT p.*, floor(x / m)::BIGINT AS cx, floor(y / m)::BIGINT AS cy, floor(z / m)::BIGINT AS cz, m FROM p, r),
e AS (SELECT point_id AS id2, x AS x2, y AS y2, z AS z2, cx + i AS cx, cy + j AS cy, cz + k AS cz
      FROM c, range(-1, 2) AS a(i), range(-1, 2) AS b(j), range(-1, 2) AS d(k)),
near AS (SELECT DISTINCT point_id AS key_a, id2 AS key_b FROM c JOIN e USING (cx, cy, cz)
         WHERE point_id < id2 AND (x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2) <= m * m),
g AS (SELECT DISTINCT poly_id, ring, holes FROM polygons WHERE ring IS NOT NULL AND len(list_distinct(ring)) >= 3),
g2 AS (SELECT poly_id, ring, [h FOR h IN coalesce(holes, []) IF len(list_distinct(h)) >= 3] AS holes,
       list_min([c.x FOR c IN ring]) AS x0, list_max([c.x FOR c IN ring]) AS x1,
       list_min([c.y FOR c IN ring]) AS y0, list_max([c.y FOR c IN ring]) AS y1 FROM g),
pt AS (SELECT DISTINCT point_id, x, y FROM points WHERE isfinite(x) AND isfinite(y)),
cand AS (SELECT point_id, x, y, poly_id, ring, holes FROM pt JOIN g2 ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
edge AS (SELECT poly_id, 0 AS part, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM (SELECT poly_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM g2)
         UNION ALL
         SELECT poly_id, part, h[i], h[i % len(h) + 1] FROM (SELECT poly_id, part, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT poly_id, unnest(range(1, len(holes) + 1)) AS part, unnest(holes) AS h FROM g2))),
hits AS (SELECT point_id, poly_id, part, count(*) % 2 AS odd FROM cand JOIN edge USING (poly_id)
         WHERE (a.y > cand.y) <> (b.y > cand.y) AND cand.x < (b.x - a.x) * (cand.y - a.y) / (b.y - a.y) + a.x GROUP BY ALL),
held AS (SELECT point_id AS key_a, poly_id AS key_b FROM hits GROUP BY ALL
         HAVING max(CASE WHEN part = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN part > 0 THEN odd ELSE 0 END) = 0)
SELECT 'near' AS relation, key_a, key_b FROM near UNION ALL SELECT 'inside', key_a, key_b FROM held
""",
    "p5_found": f"""
SELECT building_id FROM {_QUALITY} WHERE building_id IN (SELECT building_id FROM fused_buildings) GROUP BY building_id
HAVING count(*) > (SELECT setting_value FROM settings WHERE setting = 'heavy_share') * (SELECT count(DISTINCT quality_id) FROM polygon_quality)
""",
    "p5_buildings": f"""
SELECT building_id, n_points, count(q.quality_id) AS n_measurements, sum(points_inside)::BIGINT AS sum_points_inside, max(quality_score) AS best_score, count(*) FILTER (points_inside > n_points) AS n_above,
       CASE WHEN n_points > 0 THEN sum(points_inside)::DOUBLE / n_points END AS inside_ratio
FROM fused_buildings LEFT JOIN {_QUALITY} AS q USING (building_id) GROUP BY building_id, n_points
""",
    "p5_medians": """
SELECT building_id, count(quality_score) FILTER (isfinite(quality_score)) AS n, quantile_cont(quality_score, 0.5) AS median_score, quantile_cont(quality_score, 0.9) AS p90_score, count(DISTINCT lower(trim(bld_source))) AS sources
FROM (SELECT * FROM polygon_quality QUALIFY row_number() OVER (PARTITION BY quality_id) = 1) WHERE building_id IS NOT NULL GROUP BY building_id HAVING count(quality_score) > 0
""",
    **{n: q for m in _PLANS for n, q in m.SQL.items()},
}
