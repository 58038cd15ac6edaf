"""The point and feature frames that the other operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.runtime import finite, only

POINT = ["file_id", "tile_id", "idx", "x", "y", "z", "intensity", "return_number", "classification", "ndvi", "gps_time", "flight_line"]
FEATURE = ["nx", "ny", "nz", "planarity", "linearity", "sphericity", "anisotropy", "verticality", "omnivariance", "eigenentropy", "curvature", "roughness", "density", "height"]


def tile_name(x: Column, y: Column) -> Column:
    """The name of the kilometre tile of a place, by its south-west corner."""
    return F.format_string("T%04d_%04d", F.floor(x / 1000).cast("int"), F.floor(y / 1000).cast("int"))


def current_points(points: DataFrame) -> DataFrame:
    """One row per point with finite x, y, z: the latest ingested (NULL earliest), of equal ones the greatest by its values.

    Partial maxima are taken before the one shuffle. ``tile`` is ``tile_id``, or the kilometre
    tile that the place lies in where that is NULL.
    """
    p = only(points, "point_id", "ingested_at", *POINT).where(F.col("point_id").isNotNull() & finite("x", "y", "z"))
    last = p.groupBy("point_id").agg(F.max(F.struct("ingested_at", "classification", *[c for c in POINT if c != "classification"])).alias("p"))
    return last.select("point_id", *[F.col(f"p.{c}").alias(c) for c in POINT], F.coalesce("p.tile_id", tile_name(F.col("p.x"), F.col("p.y"))).alias("tile"))


def current_features(features: DataFrame, columns: list[str] = FEATURE) -> DataFrame:
    """One row per point: the latest enrichment, the named numbers of it as doubles (NaN and infinities kept).

    Only these columns are read and shuffled. Of several rows of one time the greatest by these numbers counts.
    """
    f = only(features, "point_id", "enriched_at", *columns).where("point_id IS NOT NULL")
    last = f.groupBy("point_id").agg(F.max(F.struct("enriched_at", *columns)).alias("f"))
    return last.select("point_id", *[F.col(f"f.{c}").cast("double").alias(c) for c in columns])


def steady_avg(column: str, scale: int = 10**6) -> Column:
    """The mean of a column over values rounded to 1 / scale: whole numbers are summed, so no order of rows changes it."""
    whole = F.round(F.col(column) * scale).cast("long")
    return F.try_divide(F.sum(whole).cast("double"), F.count(whole)) / scale


def with_group(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Every row with the aggregates of its group, by a pre-aggregated table joined back: no group is held in one task."""
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    same = None
    renamed = sums
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_g{i}")
        test = F.col(k).eqNullSafe(F.col(f"_g{i}"))
        same = test if same is None else same & test
    return df.join(renamed, same).drop(*[f"_g{i}" for i in range(len(keys))])


def with_total(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Every row with aggregates over the whole frame: one row of totals, read on the driver and set in as literals."""
    row = df.agg(*[c.alias(n) for n, c in measures.items()]).first()
    return df.withColumns({n: F.lit(row[n]) for n in measures})
