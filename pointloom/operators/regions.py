"""Labels from regions, lines and centres."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import near
from pointloom.runtime import cut, finite, only


def overlay(points: DataFrame, polygons: DataFrame, attributes: list[str], first: bool = True) -> DataFrame:
    """``point_id`` and the attributes of one polygon that holds it: the smallest ``poly_id`` if ``first``, else the greatest.

    Points in no polygon are not in the result.
    """
    held = near.inside(points, polygons)
    pick = F.min("key_b") if first else F.max("key_b")
    one = held.groupBy("key_a").agg(pick.alias("poly_id"))
    p = polygons.select("poly_id", *attributes).groupBy("poly_id").agg(*[F.min(a).alias(a) for a in attributes])
    return one.join(p, "poly_id").select(F.col("key_a").alias("point_id"), "poly_id", *attributes)


def priority_overlay(points: DataFrame, polygons: DataFrame, priorities: DataFrame) -> DataFrame:
    """``point_id, layer, label``: of all layers whose polygons hold a point, the one with the highest priority and its class.

    priorities  ``layer, asprs_class, layer_priority``; polygons of unknown layers label nothing. Ties: the layer's name.
    """
    held = near.inside(points, polygons)
    of = polygons.select("poly_id", "layer").distinct().join(F.broadcast(priorities.select("layer", "asprs_class", "layer_priority")), "layer")
    ranked = held.join(of, held["key_b"] == of["poly_id"])
    best = F.max(F.struct("layer_priority", "layer", "asprs_class")).alias("b")
    return ranked.groupBy("key_a").agg(best).select(F.col("key_a").alias("point_id"), F.col("b.layer").alias("layer"), F.col("b.asprs_class").alias("label"))


def edges(polygons: DataFrame) -> DataFrame:
    """The edges of the outer rings as ``poly_id, x1, y1, x2, y2``; corners with a NULL are left out, open rings are closed."""
    p = only(polygons, "poly_id", "ring").where(F.col("ring").isNotNull()).distinct()
    ring = F.filter("ring", lambda c: c.isNotNull() & c["x"].isNotNull() & c["y"].isNotNull() & ~F.isnan(c["x"]) & ~F.isnan(c["y"]))
    p = p.withColumn("ring", ring).where("size(ring) >= 2")
    turned = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    e = p.select("poly_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), turned.alias("b"))).alias("e"))
    return e.select("poly_id", *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for p, i in (("a", 1), ("b", 2)) for c in "xy"]).where("x1 <> x2 OR y1 <> y2").distinct()


def segment_distance(px, py, x1, y1, x2, y2):
    """The distance of a point to a segment in the plane."""
    dx, dy = x2 - x1, y2 - y1
    t = ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def near_lines(points: DataFrame, segments: DataFrame, reach: float, key: str = "poly_id") -> DataFrame:
    """``point_id, key, distance``: lines within ``reach`` of a point and the distance to their nearest segment.

    Cells of twice the reach: a segment is put into the cells along it, column by column, a point into its own, so the
    points are not copied and a long diagonal costs by its length.
    """
    side = 2 * reach
    cells = segments.where(finite("x1", "y1", "x2", "y2"))
    span = {c: (F.floor((F.least(f"{c}1", f"{c}2") - reach) / side).cast("long"), F.floor((F.greatest(f"{c}1", f"{c}2") + reach) / side).cast("long")) for c in "x"}
    cells = cells.withColumn("cx", F.explode(F.sequence(*span["x"])))
    # In a column of cells only those are filled that the segment may come near there, not the whole height of its extent.
    wide = F.col("x2") - F.col("x1")
    at = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("cx") + i) * side + j * reach - F.col("x1"), wide))) for i, j in ((0, -1), (1, 1))]
    ends = [F.when(wide == 0, F.col(f"y{i + 1}")).otherwise(F.col("y1") + t * (F.col("y2") - F.col("y1"))) for i, t in enumerate(at)]
    low, high = (F.floor((g(*ends) + s * reach) / side).cast("long") for g, s in ((F.least, -1), (F.greatest, 1)))
    cells = cells.withColumn("cy", F.explode(F.sequence(low, high)))
    middle = [(F.col(c) + 0.5) * side for c in ("cx", "cy")]
    cells = cells.where(segment_distance(*middle, *[F.col(c) for c in ("x1", "y1", "x2", "y2")]) <= reach + side * 0.7072)
    p = points.where(F.col("point_id").isNotNull() & finite("x", "y")).select("point_id", "x", "y", F.floor(F.col("x") / side).cast("long").alias("cx"), F.floor(F.col("y") / side).cast("long").alias("cy"))
    d = segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    met = p.join(cells, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= reach)
    return met.groupBy("point_id", key).agg(F.min("distance").alias("distance"))


def within_buffer(points: DataFrame, polygons: DataFrame, reach: float) -> DataFrame:
    """``point_id`` of the points inside a polygon or at most ``reach`` from its outline."""
    held = near.inside(points, polygons).select(F.col("key_a").alias("point_id"))
    return held.union(near_lines(points, edges(polygons), reach).select("point_id")).distinct()


def nearest_centre(points: DataFrame, centres: DataFrame, reach: float) -> DataFrame:
    """``point_id, centre_id, distance``: the nearest centre (``centre_id, cx0, cy0``) within ``reach`` in the plane; ties by id.

    An equi-join on cells of the reach; the centres go to nine cells, the points to their own.
    """
    p = points.where(F.col("point_id").isNotNull() & finite("x", "y")).select("point_id", "x", "y", F.floor(F.col("x") / reach).cast("long").alias("cx"), F.floor(F.col("y") / reach).cast("long").alias("cy"))
    c = centres.where(finite("cx0", "cy0")).select("centre_id", "cx0", "cy0")
    for axis in "xy":
        at = F.floor(F.col(f"c{axis}0") / reach).cast("long")
        c = c.withColumn(f"c{axis}", F.explode(F.sequence(at - 1, at + 1)))
    dx, dy = F.col("x") - F.col("cx0"), F.col("y") - F.col("cy0")
    met = p.join(c, ["cx", "cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= reach)
    best = met.groupBy("point_id").agg(F.min(F.struct("d", "centre_id")).alias("b"))
    return best.select("point_id", F.col("b.centre_id").alias("centre_id"), F.col("b.d").alias("distance"))


def raster(points: DataFrame, value, size: float) -> DataFrame:
    """A raster as rows ``row, col, value``: an aggregate of the points of each cell."""
    return points.groupBy(F.floor(F.col("y") / size).cast("long").alias("row"), F.floor(F.col("x") / size).cast("long").alias("col")).agg(value.alias("value")).where("value IS NOT NULL")


def sample_raster(points: DataFrame, cells: DataFrame, size: float, default: float | None = None, reach: float = 10.0) -> DataFrame:
    """``point_id, value``: the cell under each point, else the valid cell whose middle is nearest within ``reach`` (ties: the
    smaller row, then col), else the default.

    Points over no valid cell look at the 3 x 3 cells around; those to which a cell farther off may be nearer look at all in reach.
    """
    p = points.select("point_id", "x", "y", F.floor(F.col("y") / size).cast("long").alias("row"), F.floor(F.col("x") / size).cast("long").alias("col"))
    direct = cut(p.join(cells, ["row", "col"], "left"))
    c = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    todo, out = direct.where("value IS NULL").drop("value"), direct.where("value IS NOT NULL").select("point_id", "value")
    most = max(1, math.floor(reach / size + 0.5))
    for ring in sorted({1, most}):
        at = todo
        for k, v in (("_r", "row"), ("_c", "col")):
            at = at.withColumn(k, F.explode(F.sequence(F.col(v) - ring, F.col(v) + ring)))
        dx, dy = F.col("x") - (F.col("_c") + 0.5) * size, F.col("y") - (F.col("_r") + 0.5) * size
        d = F.sqrt(dx * dx + dy * dy)
        best = at.join(c, ["_r", "_c"]).where(d <= reach).groupBy("point_id").agg(F.min(F.struct(d.alias("d"), "_r", "_c", "value")).alias("b"))
        # Cells beyond the ring are at least half a cell more than it away.
        got = cut(todo.join(best, "point_id", "left").withColumn("_done", F.coalesce(F.col("b.d") < (ring + 0.5) * size, F.lit(False)) | F.lit(ring == most)))
        out = out.union(got.where("_done").select("point_id", F.coalesce("b.value", F.lit(default).cast("double"))))
        todo = got.where("NOT _done").select("point_id", "x", "y", "row", "col")
    return out


def touching_tiles(tiles: DataFrame, slack: float = 10.0) -> DataFrame:
    """Pairs of tiles ``tile_a < tile_b`` that share a vertical or horizontal edge up to ``slack``.

    Each side of a tile goes to cells of its position; sides of two tiles meet in an equi-join on these.
    """
    t = only(tiles, "tile", "x0", "y0", "x1", "y1")
    step = max(slack, 1.0)

    def sides(at_max: str, lo: str, hi: str, axis: str) -> DataFrame:
        c = F.floor(F.col(at_max) / step).cast("long")
        return t.select("tile", F.lit(axis).alias("axis"), F.col(at_max).alias("at"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), c.alias("c"))

    upper = sides("x1", "y0", "y1", "x").union(sides("y1", "x0", "x1", "y"))
    lower = sides("x0", "y0", "y1", "x").union(sides("y0", "x0", "x1", "y"))
    lower = lower.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))).toDF("tile_2", "axis", "at_2", "lo_2", "hi_2", "c")
    met = upper.join(lower, ["axis", "c"]).where(F.col("tile") != F.col("tile_2")).where((F.abs(F.col("at") - F.col("at_2")) <= slack) & (F.col("lo") < F.col("hi_2")) & (F.col("lo_2") < F.col("hi")))
    return met.select(F.least("tile", "tile_2").alias("tile_a"), F.greatest("tile", "tile_2").alias("tile_b")).distinct()


def with_halo(points: DataFrame, tiles: DataFrame, buffer: float, size: float = 1000.0) -> DataFrame:
    """``tile, point_id, is_core``: the points of each tile's bounds and of a buffer around them.

    Tiles are put into the grid cells they touch with their buffer; points stay in their own cell.
    """
    t = only(tiles, "tile", "x0", "y0", "x1", "y1")
    for c in "xy":
        t = t.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"{c}0") - buffer) / size).cast("long"), F.floor((F.col(f"{c}1") + buffer) / size).cast("long"))))
    p = points.select("point_id", "x", "y", F.floor(F.col("x") / size).cast("long").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("cy"))
    met = p.join(t, ["cx", "cy"]).where((F.col("x") >= F.col("x0") - buffer) & (F.col("x") <= F.col("x1") + buffer) & (F.col("y") >= F.col("y0") - buffer) & (F.col("y") <= F.col("y1") + buffer))
    core = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return met.select("tile", "point_id", core.alias("is_core"))
