"""Aggregates over cells: voxels, heat maps, ground density and gaps, artefacts of scanning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.frames import steady_avg


def cell(column: str, size: float):
    """The number of the cell of a coordinate."""
    return F.floor(F.col(column) / size).cast("long")


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """One row per voxel: its centroid, number of points and a representative (the smallest id)."""
    keys = [cell(c, size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*keys).agg(*[steady_avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"), F.min("point_id").alias("point_id"))


def voxel_majority(points: DataFrame, size: float, label: str = "classification", measures: list[str] = ["intensity"]) -> DataFrame:
    """One row per voxel: the most frequent label (ties: the lowest) and the means of some columns (summed in whole millionths)."""
    keys = [f"v{c}" for c in "xyz"]
    at = points.withColumns({f"v{c}": cell(c, size) for c in "xyz"})
    by = at.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(F.col(m) * 10**6).cast("long")).alias(f"s_{m}") for m in measures], *[F.count(m).alias(f"c_{m}") for m in measures])
    best = F.max(F.struct("n", (-F.col(label)).alias("minus")))
    out = by.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("points"), *[(F.try_divide(F.sum(f"s_{m}").cast("double"), F.sum(f"c_{m}")) / 10**6).alias(f"mean_{m}") for m in measures])
    return out.select(*keys, (-F.col("best.minus")).alias("label"), "points", *[f"mean_{m}" for m in measures])


def heat_map(points: DataFrame, value: str, size: float) -> DataFrame:
    """The mean of a column and the number of rows per cell of x and y."""
    return points.groupBy(cell("x", size).alias("bx"), cell("y", size).alias("by")).agg(steady_avg(value).alias("mean"), F.count(value).alias("n"))


def ground_density(points: DataFrame, size: float, ground: int = 2) -> DataFrame:
    """Ground points per square metre of each cell that has any point."""
    is_ground = F.sum(F.when(F.col("classification") == ground, 1).otherwise(0))
    return points.groupBy(cell("x", size).alias("gx"), cell("y", size).alias("gy")).agg(F.count(F.lit(1)).alias("n"), is_ground.alias("ground"), (is_ground / (size * size)).alias("density"))


def ground_gaps(points: DataFrame, size: float, least: float, ground: int = 2) -> DataFrame:
    """Cells of each tile's extent with fewer ground points than ``least`` per square metre, empty ones included.

    The spine of a tile is made by two sequences, so its rows follow the extent and not the points.
    """
    at = points.withColumns({"gx": cell("x", size), "gy": cell("y", size)})
    spine = at.groupBy("tile").agg(*[f(c).alias(n) for c, f, n in (("gx", F.min, "x0"), ("gx", F.max, "x1"), ("gy", F.min, "y0"), ("gy", F.max, "y1"))])
    spine = spine.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1"))).select("tile", "gx", "gy")
    counts = at.where(F.col("classification") == ground).groupBy("tile", "gx", "gy").agg(F.count(F.lit(1)).alias("ground"))
    out = spine.join(counts, ["tile", "gx", "gy"], "left").withColumn("density", F.coalesce("ground", F.lit(0)) / (size * size))
    return out.where(F.col("density") < least).select("tile", "gx", "gy", "density")


def _binned(points: DataFrame, axis: str, bins: int, key: str = "tile") -> DataFrame:
    """Rows with their bin 1..bins of the tile's extent along an axis (left-closed; the greatest value is in bin bins + 1)."""
    span = points.groupBy(key).agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))
    at = points.join(span, key)
    width = F.col("_b") - F.col("_a")
    return at.withColumn("bin", F.when(width > 0, F.floor((F.col(axis) - F.col("_a")) * bins / width) + 1).otherwise(bins + 1).cast("int"))


def spatial_artifacts(points: DataFrame, value: str, bins: int = 50, least: int = 10, low: float = 0.1, medium: float = 0.2, high: float = 0.35) -> DataFrame:
    """Per tile the variation of binned means along x and y, as coefficients of variation, with a severity.

    Bins with at most ``least`` points are left out; a mean of means of 0 gives 0. Two aggregations, no window.
    """
    out = None
    for axis in "xy":
        means = _binned(points, axis, bins).where(F.col("bin") <= bins).groupBy("tile", "bin").agg(steady_avg(value).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
        one = means.groupBy("tile").agg(F.when(F.avg("m") > 1e-10, F.try_divide(F.stddev_pop("m"), F.avg("m"))).otherwise(0.0).alias(f"cv_{axis}"), F.count(F.lit(1)).alias(f"bins_{axis}"))
        out = one if out is None else out.join(one, "tile", "full")
    top = F.greatest(F.coalesce("cv_x", F.lit(0.0)), F.coalesce("cv_y", F.lit(0.0)))
    severity = F.when(top < low, "low").when(top < medium, "medium").when(top < high, "high").otherwise("severe")
    return out.select("tile", F.coalesce("cv_x", F.lit(0.0)).alias("cv_x"), F.coalesce("cv_y", F.lit(0.0)).alias("cv_y"), top.alias("max_cv"), severity.alias("severity"))


def dash_lines(points: DataFrame, value: str, bins: int = 100, least: int = 5) -> DataFrame:
    """Bins along y whose mean leaves the tile's mean of bins by a deviation, beside another that deviates by half one, or by two.

    The window runs over at most ``bins`` rows a tile.
    """
    means = _binned(points, "y", bins).where(F.col("bin") <= bins).groupBy("tile", "bin").agg(steady_avg(value).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    w, o = Window.partitionBy("tile"), Window.partitionBy("tile").orderBy("bin")
    d = means.withColumns({"g": F.avg("m").over(w), "s": F.stddev_pop("m").over(w), "k": F.count("m").over(w)})
    off = F.abs(F.col("m") - F.col("g"))
    d = d.withColumn("off", off).withColumns({"before": F.lag("off").over(o), "after": F.lead("off").over(o)})
    beside = (F.coalesce("before", F.lit(0.0)) > F.col("s") * 0.5) | (F.coalesce("after", F.lit(0.0)) > F.col("s") * 0.5)
    return d.where((F.col("k") >= 3) & (F.col("off") > F.col("s")) & (beside | (F.col("off") > F.col("s") * 2))).select("tile", "bin", F.col("m").alias("mean"))
