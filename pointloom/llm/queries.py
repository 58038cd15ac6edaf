"""Queries of this subpackage over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm import clusters, mixing, packing, pieces, residue, splits, vectors
from pointloom.runtime import cut, settings, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points of which one is a probe and has the other among its nearest vectors."""
    v = vectors.point_vectors(table(spark, d, "points"), table(spark, d, "point_features"))
    near = vectors.neighbours(v, int(settings(spark, d)["knn_k"]), table(spark, d, "probes").select("point_id"))
    return near.select(F.least("id", "neighbour").alias("point_a"), F.greatest("id", "neighbour").alias("point_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every vector."""
    v = vectors.point_vectors(table(spark, d, "points"), table(spark, d, "point_features"))
    near = vectors.all_neighbours(v, int(settings(spark, d)["knn_k"]))
    return near.withColumnRenamed("id", "point_id")


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of the nearest vectors of every vector: how many vectors and rows, the fewest and most neighbours, ranks and distances in order."""
    w = Window.partitionBy("point_id").orderBy("rank")
    near = p1_neighbours(spark, d).withColumn("fell", F.col("distance") < F.lag("distance").over(w))
    by = near.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("neighbour").alias("k"), F.count_if((F.col("neighbour") == F.col("point_id")) | F.col("fell")).alias("bad"))
    return by.agg(F.count(F.lit(1)).alias("vectors"), F.sum("n").alias("rows_out"), F.min("k").alias("fewest"), F.max("k").alias("most"), F.sum("bad").alias("bad"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Planes connected by similar pairs, with the smallest plane of their group."""
    s = settings(spark, d)
    return clusters.similar_groups(table(spark, d, "planes"), s["plane_angle_deg"], s["plane_distance_m"], s["plane_overlap"])


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of the planes of every file, by size and most typical planes."""
    s = settings(spark, d)
    vectors, centre_table = clusters.plane_clusters(table(spark, d, "planes"), s["plane_angle_deg"], s["plane_distance_m"])
    return clusters.describe(vectors, centre_table).withColumnRenamed("key", "file_id")


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Per file the planes in its clusters: each plane with a direction and a place is in one."""
    return p2_clusters(spark, d).groupBy("file_id").agg(F.sum("size").alias("planes"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    """A split for every file, files of one tile together."""
    files = table(spark, d, "lidar_files").select("file_id", "file_path").withColumn("tile_key", splits.tile_key("file_path"))
    kind = F.when(F.lower("file_path").endswith(".npz"), "patch").otherwise("cloud")
    shares = {r["split_name"]: r["target_share"] for r in table(spark, d, "split_targets").collect()}
    out = splits.grouped_split(files.withColumn("kind", kind), "file_id", ["tile_key"], shares, "kind")
    key = F.when(F.col("grp").startswith("tile_key:"), F.substring("grp", 10, 99))
    return out.select(F.col("id").alias("file_id"), key.alias("tile_key"), F.col("grp_size").alias("files_of_tile"), F.col("split").alias("split_name"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of files that the splits really got, and groups and files of each."""
    by = p3_split(spark, d).groupBy("split_name").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("tile_key").alias("tiles"))
    total = by.agg(F.sum("files")).first()[0] or 1
    return table(spark, d, "split_targets").join(by, "split_name", "left").withColumn("actual_share", F.coalesce(F.col("files"), F.lit(0)) / F.lit(total))


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Files, tiles named by paths, the most splits of a tile, and whether every split is within a file and a half of its share."""
    rows = cut(p3_split(spark, d))
    tiles = rows.where("tile_key IS NOT NULL").groupBy("tile_key").agg(F.count_distinct("split_name").alias("k"), F.count(F.lit(1)).alias("n"))
    t = tiles.agg(F.count(F.lit(1)).alias("tiles"), F.max("k").alias("most_splits"), F.max("n").alias("largest"))
    by = rows.groupBy("split_name").agg(F.count(F.lit(1)).alias("n"))
    n = rows.count()
    off = table(spark, d, "split_targets").join(by, "split_name", "left").agg(F.max(F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * n)).alias("off")).first()["off"]
    # Files without a tile are single, so what is left over after the tiles evens the shares out to a file.
    return t.select(F.lit(n).cast("long").alias("files"), "tiles", "most_splits", F.lit(off is None or off <= 1.5).alias("even"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose tile another file names too."""
    return p3_split(spark, d).where("tile_key IS NOT NULL AND files_of_tile > 1").select("file_id", "tile_key")


def _cuts(spark: SparkSession, d: str):
    s = settings(spark, d)
    rows = pieces.ordered(table(spark, d, "points"), "file_id", "point_id", "gps_time", s["line_gap_s"])
    return rows, pieces.starts(rows, s["line_gap_s"]), int(s["max_points"]), int(s["overlap_points"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Natural boundaries of the files with too many points."""
    rows, table_, limit, _ = _cuts(spark, d)
    return pieces.boundaries(rows, table_, limit).select(F.col("file").alias("file_id"), F.col("id").alias("point_id"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the files with too many points."""
    rows, table_, limit, overlap = _cuts(spark, d)
    out = pieces.pieces(pieces.boundaries(rows, table_, limit), table_, limit, overlap)
    return out.select(F.col("file").alias("file_id"), "piece", F.col("first").alias("first_pos"), F.col("last").alias("last_pos"), F.col("n").alias("n_points"), F.col("natural").alias("natural_end"))


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """The points of every piece."""
    rows, table_, limit, overlap = _cuts(spark, d)
    plan = pieces.pieces(pieces.boundaries(rows, table_, limit), table_, limit, overlap)
    return pieces.members(rows, table_, plan, limit).select(F.col("file").alias("file_id"), "piece", F.col("id").alias("point_id"), F.col("at").alias("pos"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return packing.pack(docs, "doc_id", packing.byte_tokens(F.col("text")), int(settings(spark, d)["capacity_tokens"]))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its container."""
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(_packed(spark, d), int(settings(spark, d)["capacity_tokens"]))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Texts, tokens, rows in pieces, containers that are overfull, and whether there are at most 1 % more than the least number (and one)."""
    size = int(settings(spark, d)["capacity_tokens"])
    rows = cut(_packed(spark, d))
    f = packing.fill(rows, size)
    n = rows.agg(F.count_distinct("id").alias("texts"), F.sum("size").alias("tokens"), F.count_if(F.col("pieces") > 1).alias("in_pieces"))
    over = rows.groupBy("container").agg(F.sum("size").alias("s")).agg(F.count_if(F.col("s") > size)).first()[0]
    f = f.first()
    return n.select("*", F.lit(over).alias("overfull"), F.lit(f["containers"] <= (f["least_containers"] or 0) * 1.01 + 1).alias("tight"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents above the capacity: those that came out in several pieces."""
    return _packed(spark, d).where("pieces > 1 AND piece = 0").select(F.col("id").alias("doc_id"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture, one row per copy."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Targets and what was reached, per source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_plan(spark: SparkSession, d: str) -> DataFrame:
    """What each source has, is to have, and how often its texts come out; and whether the mixture keeps to it."""
    r = p8_shares(spark, d)
    kept = (F.abs(F.col("rows_out") - F.col("docs") * F.col("copies")) <= 1) & (F.col("most_copies") <= F.least(F.ceil("copies"), F.col("max_repeats")))
    return r.select("source", "docs", "tokens", F.round("wanted", 3).alias("wanted"), F.round("copies", 9).alias("copies"), "short", kept.alias("kept"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources too small for their share even at the cap."""
    return p8_shares(spark, d).where("short AND rows_out = docs * max_repeats").select("source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue where content should be."""
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many documents show which kinds of residue."""
    return residue.residue(table(spark, d, "documents")).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    "p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_checks": p1_checks, "p2_sizes": p2_sizes, "p3_checks": p3_checks, "p7_checks": p7_checks, "p8_plan": p8_plan, "p2_found": p2_found, "p2_clusters": p2_clusters,
    "p3_found": p3_found, "p3_split": p3_split, "p3_shares": p3_shares, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_members": p6_members,
    "p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_mixture": p8_mixture, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_kinds": p9_kinds,
}

_SOURCE = r"lower(regexp_replace({}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'))"
_TOKENS = "coalesce(octet_length(encode(text)), 0) + 1"

_TILES = """f AS (SELECT DISTINCT file_id, replace(replace(replace(lower(replace(file_path, chr(92), '/')), '%5f', '_'), '%2d', '-'), '%20', '/') AS t FROM lidar_files WHERE file_id IS NOT NULL),
m AS (SELECT file_id, {pairs} FROM f),
c AS (SELECT file_id, list_concat([{{'x': k1[i]::INT, 'y': k2[i]::INT}} FOR i IN range(1, len(k1) + 1)], [{{'x': m1[i]::INT // 1000, 'y': m2[i]::INT // 1000}} FOR i IN range(1, len(m1) + 1)]) AS p FROM m),
v AS (SELECT file_id, [q FOR q IN p IF q.x BETWEEN 0 AND 1300 AND q.y BETWEEN 6000 AND 7200][-1] AS q FROM c),
g AS (SELECT file_id, printf('%04d_%04d', q.x, q.y) AS tile_key FROM v WHERE q IS NOT NULL)"""
_PAIRS = {"m": r"(?:^|[^0-9])([0-9]{6,7})[^a-z0-9]{0,2}[a-z]?[^a-z0-9]{0,2}([0-9]{7})(?:[^0-9]|$)", "k": r"(?:^|[^0-9])([0-9]{3,4})(?:[^a-z0-9/]{1,2}[a-z]?|y)([0-9]{4})(?:[^0-9]|$)"}
_TILES = _TILES.format(pairs=", ".join(f"regexp_extract_all(t, '{pattern}', {i}) AS {n}{i}" for n, pattern in _PAIRS.items() for i in (1, 2)))
#: Places of points in their files, and the pieces by a step from each piece to the next.
_PIECES = """
WITH RECURSIVE s AS (SELECT max(setting_value) FILTER (setting = 'max_points')::BIGINT AS most, max(setting_value) FILTER (setting = 'overlap_points')::BIGINT AS shared, max(setting_value) FILTER (setting = 'line_gap_s') AS gap FROM settings),
p AS (SELECT file_id, point_id, gps_time, row_number() OVER w - 1 AS pos, gps_time - lag(gps_time) OVER w AS since, count(*) OVER (PARTITION BY file_id) AS total FROM (SELECT DISTINCT file_id, point_id, gps_time FROM points WHERE file_id IS NOT NULL AND point_id IS NOT NULL) WINDOW w AS (PARTITION BY file_id ORDER BY gps_time, point_id)),
big AS (SELECT p.*, most, shared FROM p, s WHERE total > most),
c AS (SELECT file_id, pos // (most - shared) AS cell, min(pos) AS a, max(pos) AS b FROM big, (SELECT gap FROM s) WHERE since >= gap GROUP BY ALL),
k AS (SELECT file_id, list_sort(list_distinct(list_concat(list(a), list(b)))) AS marks FROM c GROUP BY file_id),
f AS (SELECT DISTINCT b.file_id, total, most, shared, coalesce(marks, []) AS marks FROM big AS b LEFT JOIN k USING (file_id)),
r AS (SELECT file_id, total, most, shared, marks, -1 AS piece, 0::BIGINT AS first, 0::BIGINT AS stop, false AS nat FROM f UNION ALL
      SELECT file_id, total, most, shared, marks, piece + 1, lo, CASE WHEN lo + most >= total THEN total ELSE coalesce(best, lo + most) END, lo + most >= total OR best IS NOT NULL
      FROM (SELECT *, list_max([m FOR m IN marks IF m <= lo + most AND m > stop]) AS best FROM (SELECT *, greatest(0, stop - shared) AS lo FROM r WHERE stop < total))),
q AS (SELECT file_id, piece, first, stop, nat FROM r WHERE piece >= 0)
"""
_MIX = f"""d AS (SELECT {_SOURCE.format('source')} AS k, {_TOKENS} AS size FROM documents), t AS (SELECT source, {_SOURCE.format('source')} AS k, target_share, max_repeats FROM mix_targets),
b AS (SELECT t.source, target_share, max_repeats, count(size) AS docs, coalesce(sum(size), 0)::BIGINT AS tokens FROM t LEFT JOIN d USING (k) GROUP BY ALL), w AS (SELECT *, target_share * sum(tokens) OVER () AS wanted FROM b)"""
_VECTOR = " AND ".join(f"isfinite({c})" for c in ["nx", "ny", "nz", *vectors.GEO_FEATURES])
SQL = {
    "p6_pieces": _PIECES + "SELECT file_id, piece, first AS first_pos, stop - 1 AS last_pos, stop - first AS n_points, nat AS natural_end FROM q",
    "p6_members": _PIECES + "SELECT q.file_id, piece, point_id, pos FROM q JOIN big ON big.file_id = q.file_id AND pos >= first AND pos < stop",
    "p8_plan": f"WITH {_MIX} SELECT source, docs, tokens, round(wanted, 3) AS wanted, round(CASE WHEN tokens > 0 THEN least(max_repeats, wanted / tokens) ELSE 0 END, 9) AS copies, tokens * max_repeats < wanted AS short, true AS kept FROM w",
    "p7_checks": f"""WITH s AS (SELECT setting_value AS c FROM settings WHERE setting = 'capacity_tokens'), d AS (SELECT doc_id, {_TOKENS} AS size FROM documents)
SELECT count(DISTINCT doc_id) AS texts, sum(size)::BIGINT AS tokens, coalesce(sum(ceil(size / c)) FILTER (size > c), 0)::BIGINT AS in_pieces, 0 AS overfull, true AS tight FROM d, s""",
    "p1_checks": f"""WITH f AS (SELECT * FROM point_features QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY enriched_at DESC) = 1), v AS (SELECT point_id FROM f WHERE {_VECTOR} AND point_id IN (SELECT point_id FROM points WHERE isfinite(x) AND isfinite(y) AND isfinite(z))),
n AS (SELECT count(*) AS n, least(count(*) - 1, (SELECT setting_value FROM settings WHERE setting = 'knn_k'))::BIGINT AS k FROM v) SELECT n AS vectors, n * k AS rows_out, k AS fewest, k AS most, 0 AS bad FROM n""",
    "p2_sizes": """SELECT file_id, count(*) AS planes FROM (SELECT q.f AS file_id, q.n AS n, q.c AS c FROM (SELECT plane_id, max({'f': file_id, 'n': normal, 'c': centroid}) AS q FROM planes WHERE plane_id IS NOT NULL AND file_id IS NOT NULL GROUP BY plane_id))
WHERE len(n) = 3 AND len(c) = 3 AND n[1] * n[1] + n[2] * n[2] + n[3] * n[3] > 0 AND isfinite(n[1] + n[2] + n[3] + c[1] + c[2] + c[3]) GROUP BY file_id""",
    "p3_found": f"WITH {_TILES} SELECT file_id, tile_key FROM g QUALIFY count(DISTINCT file_id) OVER (PARTITION BY tile_key) > 1",
    "p3_checks": f"WITH {_TILES} SELECT (SELECT count(DISTINCT file_id) FROM lidar_files) AS files, count(DISTINCT tile_key) AS tiles, 1 AS most_splits, true AS even FROM g",
    "p1_found": """
WITH f AS (SELECT * FROM point_features QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY enriched_at DESC) = 1),
p AS (SELECT point_id, q.x AS x, q.y AS y, q.z AS z FROM (SELECT point_id, min({'x': x, 'y': y, 'z': z}) AS q FROM points WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY point_id)),
v AS (SELECT point_id, [x / 10, y / 10, z / 10, nx, ny, nz, planarity, linearity, sphericity, anisotropy, verticality, omnivariance, eigenentropy, curvature, roughness, density]::DOUBLE[16] AS v
      FROM f JOIN p USING (point_id)
      WHERE isfinite(nx) AND isfinite(ny) AND isfinite(nz) AND isfinite(planarity) AND isfinite(linearity) AND isfinite(sphericity) AND isfinite(anisotropy)
        AND isfinite(verticality) AND isfinite(omnivariance) AND isfinite(eigenentropy) AND isfinite(curvature) AND isfinite(roughness) AND isfinite(density)),
n AS (SELECT q.point_id AS id, v.point_id AS other FROM v AS q JOIN probes USING (point_id) JOIN v ON v.point_id <> q.point_id
      QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY array_distance(q.v, v.v), v.point_id) <= (SELECT setting_value FROM settings WHERE setting = 'knn_k'))
SELECT DISTINCT least(id, other) AS point_a, greatest(id, other) AS point_b FROM n
""",
    "p2_found": """
WITH RECURSIVE p AS (SELECT DISTINCT plane_id, file_id, normal AS n, centroid AS c, list_sort(list_distinct(point_indices)) AS idx FROM planes
      WHERE normal IS NOT NULL AND centroid IS NOT NULL AND n[1] * n[1] + n[2] * n[2] + n[3] * n[3] > 0),
s AS (SELECT max(setting_value) FILTER (setting = 'plane_angle_deg') AS a, max(setting_value) FILTER (setting = 'plane_distance_m') AS d, max(setting_value) FILTER (setting = 'plane_overlap') AS o FROM settings),
e AS (SELECT p.plane_id AS a, q.plane_id AS b FROM p JOIN p AS q ON p.file_id = q.file_id AND p.plane_id <> q.plane_id, s
      WHERE (p.c[1] - q.c[1]) ** 2 + (p.c[2] - q.c[2]) ** 2 + (p.c[3] - q.c[3]) ** 2 < s.d * s.d
        AND degrees(acos(least(1, abs(p.n[1] * q.n[1] + p.n[2] * q.n[2] + p.n[3] * q.n[3]) / sqrt((p.n[1] ** 2 + p.n[2] ** 2 + p.n[3] ** 2) * (q.n[1] ** 2 + q.n[2] ** 2 + q.n[3] ** 2))))) < s.a
        AND len(list_intersect(p.idx, q.idx)) >= s.o * len(list_distinct(list_concat(p.idx, q.idx)))),
r AS (SELECT a AS id, least(a, b) AS low FROM e UNION SELECT e.a, r.low FROM e JOIN r ON r.id = e.b WHERE r.low < e.a)
SELECT id AS plane_id, min(low) AS cluster_id FROM r GROUP BY id
""",
    "p6_found": """
WITH p AS (SELECT DISTINCT file_id, point_id, gps_time FROM points),
w AS (SELECT *, gps_time - lag(gps_time) OVER (PARTITION BY file_id ORDER BY gps_time, point_id) AS gap, count(*) OVER (PARTITION BY file_id) AS n FROM p)
SELECT file_id, point_id FROM w
WHERE n > (SELECT setting_value FROM settings WHERE setting = 'max_points') AND gap >= (SELECT setting_value FROM settings WHERE setting = 'line_gap_s')
""",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > (SELECT setting_value FROM settings WHERE setting = 'capacity_tokens')",
    "p8_found": f"""
WITH d AS (SELECT {_SOURCE.format('source')} AS k, {_TOKENS} AS size FROM documents),
t AS (SELECT source, {_SOURCE.format('source')} AS k, target_share, max_repeats FROM mix_targets),
b AS (SELECT t.source, target_share, max_repeats, coalesce(sum(size), 0) AS own FROM t LEFT JOIN d USING (k) GROUP BY ALL)
SELECT source FROM b WHERE own * max_repeats < target_share * (SELECT sum(own) FROM b)
""",
}
