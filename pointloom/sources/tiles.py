"""Tables of points, tiles and their registry: reading, planning and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Feature columns by mode; full means every column that is there.
MODES = {
    "minimal": ["nx", "ny", "nz", "planarity", "height"],
    "lod2": ["nx", "ny", "nz", "planarity", "linearity", "curvature", "height", "verticality"],
    "lod3": ["nx", "ny", "nz", "planarity", "linearity", "sphericity", "anisotropy", "omnivariance", "eigenentropy", "curvature", "roughness", "verticality", "density", "height"],
    "asprs": ["nz", "planarity", "linearity", "curvature", "roughness", "verticality", "height"],
    "planes": ["nx", "ny", "nz", "planarity", "verticality"],
}


def read_points(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Points of a Parquet, ORC, CSV or JSON table; the box and the columns reach the scan. Closed box (xmin, ymin, xmax, ymax)."""
    reader = spark.read.format(fmt)
    df = reader.option("header", True).option("inferSchema", True).load(path) if fmt == "csv" else reader.load(path)
    if bbox:
        df = df.where(F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3]))
    return df.select(*columns) if columns else df


def mode_columns(df: DataFrame, mode: str, custom: list[str] | None = None) -> DataFrame:
    """The identifying columns and the features of a mode that the table has."""
    ids = [c for c in ("point_id", "file_id", "tile_id", "x", "y", "z") if c in df.columns]
    if mode == "full":
        return df
    wanted = custom if mode == "custom" else MODES[mode]
    return df.select(*ids, *[c for c in wanted or [] if c in df.columns and c not in ids])


def reuse_plan(df: DataFrame, requested: list[str]) -> dict[str, list[str]]:
    """Which requested features a table already holds as numbers, and which must be computed. Looks at the schema only."""
    have = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double", "integer", "long", "short")}
    return {"reuse": [c for c in requested if c in have], "compute": [c for c in requested if c not in have]}


def tile_of(x: Column, y: Column, size: float = 1000.0) -> Column:
    """The tile of a place: kilometre column and row of its south-west corner."""
    return F.format_string("%04d_%04d", F.floor(x / size).cast("int"), F.floor(y / size).cast("int"))


def tiles_in_box(spark: SparkSession, xmin: float, ymin: float, xmax: float, ymax: float, size: float = 1000.0) -> DataFrame:
    """``col, row, tile`` of the tiles that a box touches, made by two sequences."""
    a = [int(v // size) for v in (xmin, xmax, ymin, ymax)]
    df = spark.range(a[0], a[1] + 1).withColumnRenamed("id", "col").withColumn("row", F.explode(F.sequence(F.lit(a[2]).cast("long"), F.lit(a[3]).cast("long"))))
    return df.withColumn("tile", F.format_string("%04d_%04d", F.col("col").cast("int"), F.col("row").cast("int")))


def registry(files: DataFrame) -> DataFrame:
    """One row per file: the latest loaded (ties: the greatest by its values)."""
    rest = [c for c in files.columns if c not in ("file_id", "loaded_at")]
    return files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("loaded_at", *rest)).alias("r")).select("file_id", "r.*")


def files_near(files: DataFrame, x: float, y: float, reach: float) -> DataFrame:
    """Files whose extent's middle is within ``reach`` of a place; files without bounds are not among them."""
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2 - x, (F.col("ymin") + F.col("ymax")) / 2 - y
    return files.where(cx * cx + cy * cy <= reach * reach)


def pending(tiles: DataFrame, done: DataFrame, config: str) -> DataFrame:
    """Tiles to process: those whose hash of content and configuration is not in the manifest ``tile, hash``."""
    t = tiles.withColumn("hash", F.sha2(F.concat_ws("|", "tile", F.coalesce(F.col("version").cast("string"), F.lit("")), F.lit(config)), 256))
    return t.join(done.select("tile", "hash"), ["tile", "hash"], "left_anti")


def write_points(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write points or patches, partitioned by columns: rows are clustered by them first, so a task writes few files."""
    out = df.repartition(*by) if by else df
    writer = out.write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def geojson(polygons: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per polygon as text; rings are closed, NULL rings give a NULL geometry."""
    closed = lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    pairs = lambda r: F.transform(closed(r), lambda c: F.array(c["x"], c["y"]))
    rings = F.concat(F.array(pairs(F.col("ring"))), F.transform(F.coalesce("holes", F.array().cast(polygons.schema["holes"].dataType)), pairs))
    geometry = F.when(F.size("ring") > 0, F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
    return polygons.select("poly_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def read_las(spark: SparkSession, paths: list[str]) -> DataFrame:
    """LAS and LAZ files, one task per file, where a reader library is installed; a clear error where it is not."""
    try:
        import laspy  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading LAS needs the library laspy; convert the files to Parquet and use read_points") from e

    def run(batches):
        import laspy
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path in pdf["path"]:
                with laspy.open(path) as f:
                    for c in f.chunk_iterator(1_000_000):
                        yield pd.DataFrame({"file_path": path, "x": np.array(c.x), "y": np.array(c.y), "z": np.array(c.z), "intensity": np.array(c.intensity) / 65535.0, "return_number": np.array(c.return_number, int), "classification": np.array(c.classification, int)})

    kind = "file_path string, x double, y double, z double, intensity double, return_number int, classification int"
    return spark.createDataFrame([(x,) for x in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, kind)
