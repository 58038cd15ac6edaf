"""Measures of objects: floors, footprints, hulls, samples, functions per tile."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import near
from pointloom.operators.regions import segment_distance  # noqa: F401 - part of this module's surface
from pointloom.runtime import cut

#: Points of a patch up to which it is one Arrow group.
LARGE = 500_000


def floors(points: DataFrame, polygons: DataFrame, height: float = 3.0) -> DataFrame:
    """``poly_id, floor, n, z0, z1``: the points of each polygon in storeys of ``height`` over its lowest point."""
    held = near.inside(points, polygons).withColumnRenamed("key_a", "point_id").withColumnRenamed("key_b", "poly_id")
    j = held.join(points.select("point_id", "z"), "point_id")
    low = j.groupBy("poly_id").agg(F.min("z").alias("base"))
    at = j.join(low, "poly_id").withColumn("floor", F.floor((F.col("z") - F.col("base")) / height).cast("int"))
    return at.groupBy("poly_id", "floor").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1"))


def best_shifts(points: DataFrame, boxes: DataFrame, step: float = 1.0, most: int = 1, reward: float = 1.0, penalty: float = 1.0) -> DataFrame:
    """``box_id, dx, dy, score``: the shift of each box (``box_id, x0, y0, x1, y1``) that holds most building points and least ground.

    A point in reach of a box is held by a range of shifts on each axis. The gains go to the corners of these ranges, are
    summed there and then along both axes, so no point is copied by shift and a box has at most one row a shift.
    Ties: the smallest move, then dx and dy. Boxes without points keep their place with score 0.
    """
    s = boxes.where("box_id IS NOT NULL").select("box_id", "x0", "y0", "x1", "y1")
    cells, far = s, most * step
    for c in "xy":
        cells = cells.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"{c}0") - far) / 20).cast("long"), F.floor((F.col(f"{c}1") + far) / 20).cast("long"))))
    gain = F.when(F.col("classification") == 6, reward).when(F.col("classification") == 2, -penalty).otherwise(0.0)
    p = points.select("x", "y", gain.alias("gain"), *[F.floor(F.col(c) / 20).cast("long").alias(f"c{c}") for c in "xy"]).where("gain <> 0")
    met = p.join(cells, ["cx", "cy"]).where(F.col("x").between(F.col("x0") - far, F.col("x1") + far) & F.col("y").between(F.col("y0") - far, F.col("y1") + far))
    for c in "xy":
        # The last shift whose lower edge is not beyond the point, the first whose upper edge is not before it; divisions may round.
        g = F.floor((F.col(c) - F.col(f"{c}0")) / step)
        last = F.when(F.col(f"{c}0") + (g + 1) * step <= F.col(c), g + 1).when(F.col(f"{c}0") + g * step > F.col(c), g - 1).otherwise(g)
        g = F.ceil((F.col(c) - F.col(f"{c}1")) / step)
        first = F.when(F.col(f"{c}1") + (g - 1) * step >= F.col(c), g - 1).when(F.col(f"{c}1") + g * step < F.col(c), g + 1).otherwise(g)
        met = met.withColumns({f"{c}a": F.greatest(first, F.lit(-most)).cast("int"), f"{c}b": (F.least(last, F.lit(most)) + 1).cast("int")})
    spans = met.where("xa < xb AND ya < yb").groupBy("box_id", "xa", "xb", "ya", "yb").agg(F.sum("gain").alias("gain"))
    corner = lambda i, j, sign: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (F.col("gain") * sign).alias("gain"))
    ends = spans.select("box_id", F.inline(F.array(corner("xa", "ya", 1), corner("xb", "ya", -1), corner("xa", "yb", -1), corner("xb", "yb", 1)))).where((F.col("i") <= most) & (F.col("j") <= most))
    side = F.sequence(F.lit(-most), F.lit(most))
    every = s.select("box_id").distinct().withColumn("i", F.explode(side)).withColumn("j", F.explode(side)).withColumn("gain", F.lit(0.0))
    sums = every.unionByName(ends).groupBy("box_id", "i", "j").agg(F.sum("gain").alias("score")).repartition("box_id")
    for a, b in ("ij", "ji"):
        sums = sums.withColumn("score", F.sum("score").over(Window.partitionBy("box_id", a).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)))
    every = sums.select("box_id", (F.col("i") * step).alias("dx"), (F.col("j") * step).alias("dy"), "score")
    move = F.abs("dx") + F.abs("dy")
    best = every.groupBy("box_id").agg(F.max(F.struct("score", (-move).alias("m"), (-F.col("dx")).alias("ax"), (-F.col("dy")).alias("ay"))).alias("b"))
    return best.select("box_id", (-F.col("b.ax")).alias("dx"), (-F.col("b.ay")).alias("dy"), F.col("b.score").alias("score"))


def _hull(xy: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, by a monotone chain."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def hulls(points: DataFrame, key: str, cell: float = 0.25) -> DataFrame:
    """``key, n, area, perimeter``: the convex hull of each group in the plane.

    Only the least and greatest y of each column of ``cell`` metres can be corners; these are aggregated first, so a group
    in a task is as large as its extent and not as its points. Exact for the points. Fewer than three corners: area 0.
    """
    column = F.floor(F.col("x") / cell).cast("long")
    ends = points.groupBy(key, column.alias("_c")).agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(e).alias(f"e{i}") for i, e in enumerate(("min_by(struct(x, y), struct(y, x))", "max_by(struct(x, y), struct(y, x))", "min_by(struct(x, y), struct(x, y))", "max_by(struct(x, y), struct(x, y))"))]
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = np.array([(e["x"], e["y"]) for i in range(4) for e in pdf[f"e{i}"]], float)
        h = _hull(xy)
        nxt = np.roll(h, -1, 0)
        area = abs((h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1]).sum()) / 2 if len(h) >= 3 else 0.0
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [int(pdf["n"].sum())], "area": [area], "perimeter": [float(np.hypot(*(nxt - h).T).sum())]})

    # Coordinates relative to the group keep their digits in the products.
    return ends.groupBy(key).applyInPandas(_relative(one), f"{key} {points.schema[key].dataType.simpleString()}, n long, area double, perimeter double")


def _relative(fn):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf["e0"].iloc[0]["x"], pdf["e0"].iloc[0]["y"]
        for i in range(4):
            pdf[f"e{i}"] = [{"x": e["x"] - x0, "y": e["y"] - y0} for e in pdf[f"e{i}"]]
        return fn(pdf)

    return run


def farthest_points(patches: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The keys, ``point_id`` and ``step`` of n points a patch, each the farthest from those before; the first has the smallest id.

    Exact over all points of a patch. Patches of at most ``LARGE`` points are Arrow groups; a larger one is spread, its
    points are farthest in partial maxima and one winner a round. Both give the same points. Ties: the smaller id.
    """
    kinds = ", ".join(f"{k} {patches.schema[k].dataType.simpleString()}" for k in keys)
    p = cut(patches.select(*keys, "point_id", "x", "y", "z"))
    large = p.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE)
    large = cut(large.drop("_n"))

    def run(t: pa.Table) -> pa.Table:
        ids = t["point_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, (x, y, z) = ids[order], (t[c].to_numpy()[order] for c in ("x", "y", "z"))
        away = lambda i: (x - x[i]) * (x - x[i]) + (y - y[i]) * (y - y[i]) + (z - z[i]) * (z - z[i])
        took, d = [0], away(0)
        d[0] = -1
        while len(took) < min(n, len(ids)):
            i = int(d.argmax())
            took.append(i)
            d = np.minimum(d, away(i))
            d[took] = -1
        cols = {k: pa.array([t[k][0].as_py()] * len(took), t[k].type) for k in keys}
        return pa.table({**cols, "point_id": pa.array(ids[took]), "step": pa.array(range(len(took)), pa.int32())})

    def same(other: str):
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys])

    if large.isEmpty():
        return p.groupBy(*keys).applyInArrow(run, f"{kinds}, point_id long, step int")
    out = p.join(F.broadcast(large), same("_"), "left_anti").groupBy(*keys).applyInArrow(run, f"{kinds}, point_id long, step int")
    rest = cut(p.join(F.broadcast(large), same("_"), "left_semi"))
    won = None
    for step in range(n):
        if won is None:
            best = rest.groupBy(*keys).agg(F.min(F.struct("point_id", "x", "y", "z")).alias("b"))
        else:
            has = won.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.collect_list(F.struct("point_id", "x", "y", "z")).alias("_w"))
            at = rest.join(F.broadcast(has), same("_")).where(~F.exists("_w", lambda w: w["point_id"] == F.col("point_id")))
            d = F.array_min(F.transform("_w", lambda w: sum(((F.col(c) - w[c]) * (F.col(c) - w[c]) for c in "yz"), (F.col("x") - w["x"]) * (F.col("x") - w["x"]))))
            best = at.groupBy(*keys).agg(F.min(F.struct((-d).alias("d"), "point_id", "x", "y", "z")).alias("b"))
        best = cut(best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in ("point_id", "x", "y", "z")], F.lit(step).alias("step")))
        won = best if won is None else won.unionByName(best)
    return out.unionByName(won.select(*keys, "point_id", "step"))


def samples(resampled: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """One row a patch for training: keys, points and features as arrays in order of id, and labels. Patches are bounded by resampling."""
    one = F.struct("point_id", "copy", F.array("local_x", "local_y", "z").alias("xyz"), F.array(*[F.col(c).cast("double") for c in features]).alias("features"), F.coalesce("classification", F.lit(0)).alias("label"))
    g = resampled.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("a"))
    return g.select(*keys, *[F.transform("a", _field(c)).alias(n) for c, n in (("xyz", "points"), ("features", "features"), ("label", "labels"))])


def _field(name: str):
    return lambda x: x[name]


def per_tile(points: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "tile", size: float | None = None) -> DataFrame:
    """Apply a function of a user to each tile, or to each block of ``size`` metres of it where tiles may be large."""
    if size is None:
        return points.groupBy(key).applyInPandas(fn, schema)
    at = points.withColumns({"_bx": F.floor(F.col("x") / size).cast("long"), "_by": F.floor(F.col("y") / size).cast("long")})
    return at.groupBy(key, "_bx", "_by").applyInPandas(_without(fn), schema)


def _without(fn):
    return lambda pdf: fn(pdf.drop(columns=["_bx", "_by"]))


def crossings(segments: DataFrame, side: float = 50.0) -> DataFrame:
    """``line_a < line_b, x, y``: where segments of different lines cross, by an equi-join on the cells of their extents."""
    s = segments.select("line_id", "x1", "y1", "x2", "y2")
    for c in "xy":
        s = s.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.least(f"{c}1", f"{c}2") / side).cast("long"), F.floor(F.greatest(f"{c}1", f"{c}2") / side).cast("long"))))
    o = s.toDF("line_b", "u1", "v1", "u2", "v2", "cx", "cy")
    j = s.withColumnRenamed("line_id", "line_a").join(o, ["cx", "cy"]).where("line_a < line_b")
    rx, ry, sx, sy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    det = rx * sy - ry * sx
    t = F.try_divide((F.col("u1") - F.col("x1")) * sy - (F.col("v1") - F.col("y1")) * sx, det)
    u = F.try_divide((F.col("u1") - F.col("x1")) * ry - (F.col("v1") - F.col("y1")) * rx, det)
    hit = j.withColumns({"t": t, "u": u}).where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    return hit.select("line_a", "line_b", F.round(F.col("x1") + F.col("t") * rx, 3).alias("x"), F.round(F.col("y1") + F.col("t") * ry, 3).alias("y")).distinct()
