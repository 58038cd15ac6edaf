"""Queries of patches, samples, splits, votes, the registry and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import learning, patches
from pointloom.plans.base import f, features, p, points
from pointloom.runtime import table
from pointloom.sources import tiles
from pointloom.streaming.tiles import ingest_windows, sessions

_COLS = ["planarity", "linearity", "curvature", "roughness"]
SPLITS = [("train", 0.8), ("val", 0.1), ("test", 0.1)]


def _patches(spark, d):
    return patches.patch_grid(points(spark, d).select("point_id", "tile", "x", "y", "z", "classification"), 20.0, 0.1, 50)


def patch_members(spark, d):
    return _patches(spark, d).select("tile", "px", "py", "point_id", F.round("local_x", 4).alias("lx"), F.round("local_y", 4).alias("ly"))


def patch_sizes(spark, d):
    return _patches(spark, d).groupBy("tile", "px", "py").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("classification") == 6).alias("buildings"))


def patches_by_class(spark, d):
    """Patches that hold a building point."""
    m = _patches(spark, d)
    return m.where("classification = 6").select("tile", "px", "py").distinct()


def augmented_patches(spark, d):
    return patches.augment(_patches(spark, d), 2, ["tile", "px", "py"]).groupBy("tile", "px", "py", "version").agg(F.count(F.lit(1)).alias("n"), F.avg("local_x").alias("mx"), F.avg("local_y").alias("my"))


def resampled_patches(spark, d):
    return patches.resample(_patches(spark, d), ["tile", "px", "py"], 512).groupBy("tile", "px", "py").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("copies"))


def tile_splits(spark, d):
    t = points(spark, d).select("tile").distinct()
    return t.select("tile", patches.md5_split(F.col("tile"), 42, SPLITS).alias("split"))


def file_batches(spark, d):
    """Files in batches of at most about 20,000 points, summed up."""
    n = points(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return patches.batches(n, "n", "file_id", 20_000).groupBy("batch").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("points"))


def synthetic_ground(spark, d):
    return patches.fill_ground(points(spark, d), 2.0, 1.5).select("tile", "x", "y", "z")


def feature_matrix(spark, d):
    """Features in a fixed order as one array."""
    return tiles.mode_columns(features(spark, d, *tiles.MODES["lod2"]), "lod2").select("point_id", F.concat_ws(",", *[F.round(c, 3).cast("string") for c in tiles.MODES["lod2"]]).alias("row"))


def registry(spark, d):
    return tiles.registry(table(spark, d, "lidar_files")).select("file_id", "file_path", "num_points", "num_classes")


def files_near(spark, d):
    """Files whose extent's middle is within 20 km of a place."""
    r = tiles.registry(table(spark, d, "lidar_files"))
    return tiles.files_near(r, 130_000.0, 6_051_000.0, 20_000.0).select("file_id")


def tile_grid(spark, d):
    """All kilometre tiles of the box of the hot place, with their points."""
    t = tiles.tiles_in_box(spark, 110_000, 6_040_000, 160_000, 6_052_000)
    n = points(spark, d).groupBy(tiles.tile_of(F.col("x"), F.col("y")).alias("tile")).agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, "tile", "left").select("col", "row", "tile", F.coalesce("n", F.lit(0)).alias("n"))


def pending_files(spark, d):
    """Files of the registry that have no points yet."""
    have = table(spark, d, "points").select("file_id").distinct()
    return tiles.registry(table(spark, d, "lidar_files")).join(have, "file_id", "left_anti").select("file_id")


def polygon_geojson(spark, d):
    g = tiles.geojson(table(spark, d, "polygons").select("poly_id", "layer", "ring", "holes").distinct(), ["layer"])
    return g.select("poly_id", F.get_json_object("feature", "$.geometry.type").alias("kind"), F.get_json_object("feature", "$.properties.layer").alias("layer")).distinct()


def fetch_status(spark, d):
    """Per layer: fetches by outcome, retries and mean time; repeated rows count once."""
    r = table(spark, d, "fetches").groupBy("fetch_id").agg(F.max(F.struct("layer", "fetch_status", "cache_hit", "retry_count", "elapsed_time", "n_features")).alias("r")).select("r.*")
    return r.groupBy("layer", "fetch_status").agg(F.count(F.lit(1)).alias("n"), F.sum("retry_count").alias("retries"), F.avg("elapsed_time").alias("mean_time"), F.sum("n_features").alias("features"), F.count_if("cache_hit").alias("cached"))


def uncertain_points(spark, d):
    """The 100 points whose shape is least certain, by entropy."""
    fs = features(spark, d, "planarity", "linearity", "sphericity")
    t = F.col("planarity") + F.col("linearity") + F.col("sphericity") + 1e-9
    pr = [F.col(c) / t for c in ("planarity", "linearity", "sphericity")]
    return learning.top_uncertain(fs, F.round(learning.entropy(pr), 9), 100, "point_id").select("point_id", "score")


def uncertainty(spark, d):
    fs = features(spark, d, "planarity", "linearity", "sphericity")
    t = F.col("planarity") + F.col("linearity") + F.col("sphericity") + 1e-9
    pr = [F.col(c) / t for c in ("planarity", "linearity", "sphericity")]
    return fs.select("point_id", learning.entropy(pr).alias("entropy"), learning.margin(pr).alias("margin"), learning.least_confidence(pr).alias("least_confidence"), learning.soft_vote([pr, [pr[1], pr[2], pr[0]]], [2.0, 1.0])[0].alias("soft"))


def label_votes(spark, d):
    """Per file a vote of its points' classes, with share and entropy."""
    return learning.vote(points(spark, d).select("file_id", "classification"), "file_id", "classification")


def covariance_gap(spark, d):
    fs = features(spark, d, *_COLS)
    return learning.coral(fs.where("classification = 2"), fs.where("classification = 6"), _COLS)


def discrepancy(spark, d):
    fs = features(spark, d, *_COLS)
    return learning.mean_discrepancy(fs.where("classification = 2"), fs.where("classification = 6"), _COLS, sigma=0.5)


def ingest_counts(spark, d):
    """Rows per 30 days of ingestion."""
    return ingest_windows(table(spark, d, "points")).select("start", "n")


def event_sessions(spark, d):
    """Sessions of a user: events no more than half an hour apart."""
    return sessions(table(spark, d, "events").where("ts IS NOT NULL"), "user_id", "ts", "30 minutes")


QUERIES = {
    "patch_members": patch_members, "patch_sizes": patch_sizes, "patches_by_class": patches_by_class, "augmented_patches": augmented_patches, "resampled_patches": resampled_patches, "tile_splits": tile_splits, "file_batches": file_batches,
    "synthetic_ground": synthetic_ground, "feature_matrix": feature_matrix, "registry": registry, "files_near": files_near, "tile_grid": tile_grid, "pending_files": pending_files, "polygon_geojson": polygon_geojson, "fetch_status": fetch_status,
    "uncertain_points": uncertain_points, "uncertainty": uncertainty, "label_votes": label_votes, "covariance_gap": covariance_gap, "discrepancy": discrepancy, "ingest_counts": ingest_counts, "event_sessions": event_sessions,
}

_PATCH = """, O AS (SELECT tile, point_id, x, y, classification, x - x0 AS ox, y - y0 AS oy, x0, y0, ceil((x1 - x0) / 18)::BIGINT AS sx, ceil((y1 - y0) / 18)::BIGINT AS sy FROM (
      SELECT *, min(x) OVER (PARTITION BY tile) AS x0, max(x) OVER (PARTITION BY tile) AS x1, min(y) OVER (PARTITION BY tile) AS y0, max(y) OVER (PARTITION BY tile) AS y1 FROM P)),
G AS (SELECT tile, px, py, point_id, classification, x - (x0 + px * 18.0::DOUBLE + 10) AS lx, y - (y0 + py * 18.0::DOUBLE + 10) AS ly, count(*) OVER (PARTITION BY tile, px, py) AS n FROM O, range(0, 100) AS a(px), range(0, 100) AS b(py)
      WHERE px < sx AND py < sy AND ox >= px * 18.0::DOUBLE AND ox < px * 18.0::DOUBLE + 20 AND oy >= py * 18.0::DOUBLE AND oy < py * 18.0::DOUBLE + 20 QUALIFY n >= 50)"""
_T = "(planarity + linearity + sphericity + 1e-9)"
_ENT = "-(" + " + ".join(f"{c} / {_T} * ln({c} / {_T} + 1e-10)" for c in ("planarity", "linearity", "sphericity")) + ")"
_REG = "(SELECT * FROM lidar_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST, file_path DESC NULLS LAST) = 1)"
_MD5 = "0"
for _i in range(4):
    _MD5 = f"(({_MD5}) * 967296 + ('0x' || substr(h, {8 * _i + 1}, 8))::BIGINT) % 1000000"
_LOD2 = tiles.MODES["lod2"]
SQL = {
    "patch_members": p("SELECT tile, px, py, point_id, round(lx, 4) AS lx, round(ly, 4) AS ly FROM G", _PATCH),
    "patch_sizes": p("SELECT tile, px, py, count(*) AS n, count(*) FILTER (classification = 6) AS buildings FROM G GROUP BY tile, px, py", _PATCH),
    "patches_by_class": p("SELECT DISTINCT tile, px, py FROM G WHERE classification = 6", _PATCH),
    "resampled_patches": p("SELECT tile, px, py, 512 AS n, CASE WHEN count(*) >= 512 THEN 1 ELSE ceil(512.0 / count(*)) END::INT AS copies FROM G GROUP BY tile, px, py", _PATCH),
    "tile_splits": p(f"SELECT tile, CASE WHEN ({_MD5}) / 1000000.0::DOUBLE < 0.8 THEN 'train' WHEN ({_MD5}) / 1000000.0::DOUBLE < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT tile, md5(tile || '_42') AS h FROM P GROUP BY tile)"),
    "synthetic_ground": p(
        """SELECT n.tile, n.x, n.y, z FROM (SELECT tile, i * 2.0::DOUBLE AS x, j * 2.0::DOUBLE AS y FROM (SELECT tile, i, unnest(range(y0, y1 + 1)) AS j FROM (SELECT tile, y0, y1, unnest(range(x0, x1 + 1)) AS i FROM (
        SELECT tile, min(floor(x / 2))::BIGINT AS x0, max(floor(x / 2))::BIGINT AS x1, min(floor(y / 2))::BIGINT AS y0, max(floor(y / 2))::BIGINT AS y1 FROM P GROUP BY tile)))) AS n
        JOIN (SELECT cx + i AS cx, cy + j AS cy, sum(s)::DOUBLE / sum(n) / 1000000 AS z FROM (SELECT floor(x / 10)::BIGINT AS cx, floor(y / 10)::BIGINT AS cy, sum(round(z * 1000000)::BIGINT) AS s, count(*) AS n FROM P WHERE classification = 2 GROUP BY 1, 2), range(-1, 2) AS a(i), range(-1, 2) AS b(j) GROUP BY 1, 2) AS w
        ON w.cx = floor(n.x / 10)::BIGINT AND w.cy = floor(n.y / 10)::BIGINT ANTI JOIN (SELECT x AS gx, y AS gy FROM P WHERE classification = 2) ON gx BETWEEN n.x - 1.5 AND n.x + 1.5 AND gy BETWEEN n.y - 1.5 AND n.y + 1.5 AND (gx - n.x) * (gx - n.x) + (gy - n.y) * (gy - n.y) <= 2.25"""),
    "feature_matrix": f("SELECT point_id, concat_ws(',', " + ", ".join(f"(round({c}, 3) + 0.0::DOUBLE)::VARCHAR" for c in _LOD2) + ") AS row FROM F", read=" ".join(_LOD2)),
    "registry": f"SELECT file_id, file_path, num_points, num_classes FROM {_REG}",
    "files_near": f"SELECT file_id FROM {_REG} WHERE isfinite(xmin) AND isfinite(xmax) AND isfinite(ymin) AND isfinite(ymax) AND pow((xmin + xmax) / 2 - 130000, 2) + pow((ymin + ymax) / 2 - 6051000, 2) <= 20000.0 * 20000",
    "tile_grid": p("""SELECT c AS col, r AS row, printf('%04d_%04d', c, r) AS tile, coalesce(n, 0) AS n FROM (SELECT c, r FROM range(110, 161) AS a(c), range(6040, 6053) AS b(r)) LEFT JOIN (SELECT floor(x / 1000)::BIGINT AS c, floor(y / 1000)::BIGINT AS r, count(*) AS n FROM P GROUP BY 1, 2) USING (c, r)"""),
    "pending_files": "SELECT DISTINCT file_id FROM lidar_files WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM points WHERE file_id IS NOT NULL)",
    "polygon_geojson": "SELECT DISTINCT poly_id, CASE WHEN len(ring) > 0 THEN 'Polygon' END AS kind, layer FROM polygons",
    "fetch_status": """SELECT layer, fetch_status, count(*) AS n, sum(retry_count)::BIGINT AS retries, avg(elapsed_time) AS mean_time, sum(n_features)::BIGINT AS features, count(*) FILTER (cache_hit) AS cached FROM (SELECT DISTINCT fetch_id, layer, fetch_status, cache_hit, retry_count, elapsed_time, n_features FROM fetches) GROUP BY layer, fetch_status""",
    "uncertain_points": f(f"SELECT point_id, round({_ENT}, 9) AS score FROM F ORDER BY score DESC, point_id LIMIT 100", read="planarity linearity sphericity"),
    "uncertainty": f(
        f"""SELECT point_id, {_ENT} AS entropy, 1 - (s[1] - s[2]) AS margin, 1 - s[1] AS least_confidence, planarity / {_T} * (2 / 3.0::DOUBLE) + linearity / {_T} * (1 / 3.0::DOUBLE) AS soft FROM (SELECT *, list_reverse_sort([planarity / {_T}, linearity / {_T}, sphericity / {_T}]) AS s FROM F)""", read="planarity linearity sphericity"),
    "label_votes": p(
        """SELECT file_id, classification, w / t AS share, ln(t) - wl / t AS vote_entropy FROM (SELECT file_id, classification, w, sum(w) OVER q AS t, sum(w * ln(w)) OVER q AS wl, row_number() OVER (PARTITION BY file_id ORDER BY w DESC, classification) AS r
        FROM (SELECT file_id, classification, count(*)::DOUBLE AS w FROM P WHERE classification IS NOT NULL GROUP BY ALL) WINDOW q AS (PARTITION BY file_id)) WHERE r = 1"""),
    "covariance_gap": f("SELECT (" + " + ".join(f"{1 if i == j else 2} * pow((covar_samp({a}, {b}) FILTER (classification = 2)) - (covar_samp({a}, {b}) FILTER (classification = 6)), 2)" for i, a in enumerate(_COLS) for j, b in enumerate(_COLS) if j >= i) + ") / 64 AS coral FROM F", read=" ".join(_COLS)),
    "ingest_counts": "SELECT to_timestamp((floor(epoch(ingested_at) / 2592000) * 2592000)::DOUBLE)::TIMESTAMP AS start, count(*) AS n FROM points WHERE ingested_at IS NOT NULL GROUP BY 1",
    "event_sessions": """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""",
}
