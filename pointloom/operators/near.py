"""Points near other points, and points inside regions, by equi-joins on cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.runtime import cut, finite, only, partitions

#: Cells of the near join that hold more rows are split to the side of the search radius itself.
HEAVY_CELL = 4096
#: At most so many rows of split cells, and bytes of polygon cells, are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20


def _small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most so many rows; looks at no more than these."""
    few = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if few else df), few


def _cells(points: DataFrame, side: float, reach: float) -> DataFrame:
    """Each point once in its own cell (home) and once in every cell below whose upper rim it is within ``reach`` of."""
    own = [F.floor(F.col(c) / side).cast("long") for c in ("x", "y", "z")]
    low = [F.when(F.col(c) - o * side <= reach, F.array(o, o - 1)).otherwise(F.array(o)) for c, o in zip(("x", "y", "z"), own)]
    out = points.withColumns({"_ax": low[0], "_ay": low[1], "_az": low[2]})
    for a, c in (("_ax", "_cx"), ("_ay", "_cy"), ("_az", "_cz")):
        out = out.withColumn(c, F.explode(a)).drop(a)
    return out


def near_pairs(points: DataFrame, radius: float, id_col: str = "point_id") -> DataFrame:
    """Pairs ``(key_a < key_b)`` of different ids whose finite x, y, z are at most ``radius`` apart (3-D), each once.

    Rows of one id count once if they agree in place (of several places, any pair of them within the radius counts).
    NULL ids and coordinates that are NULL, NaN or infinite match nothing. Empty table: no pairs.

    Plan: cells of 8 radii; a pair meets in the cell of its componentwise minimum, so only points within a radius of a
    lower rim are copied (1.4 rows a point). One shuffle by cell serves removal of repeats and both sides of the join.
    Cells with more than HEAVY_CELL rows, found by a pre-aggregated count, are split into cells of one radius, where the
    number of candidates is within a constant of the number of pairs that must be returned.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    p = only(points, id_col, "x", "y", "z").toDF("id", "x", "y", "z")
    p = p.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(F.col("id").isNotNull() & finite("x", "y", "z"))
    side, reach = 8 * radius, radius * (1 + 1e-9)
    own = [F.floor(F.col(c) / side).cast("long").alias(f"_h{c}") for c in "xyz"]
    heavy = p.groupBy(*own).count().where(F.col("count") > HEAVY_CELL).drop("count")
    heavy = cut(heavy)
    if heavy.isEmpty():
        return _meet(_cells(p, side, reach), side, radius)
    heavy, _ = _small(heavy, BROADCAST_ROWS)
    # A pair whose minimum lies in a split cell may have a point in an upper neighbour: coarse cells are made first.
    copies = _cells(p, side, reach)
    on = (F.col("_cx") == F.col("_hx")) & (F.col("_cy") == F.col("_hy")) & (F.col("_cz") == F.col("_hz"))
    coarse = _meet(copies.join(heavy, on, "left_anti"), side, radius)
    inside = copies.join(heavy, on, "left_semi").select("id", "x", "y", "z").distinct()
    fine = _meet(_cells(inside, reach, reach), reach, radius)
    return coarse.union(fine).distinct()


def _meet(copies: DataFrame, side: float, radius: float) -> DataFrame:
    cell = ["_cx", "_cy", "_cz"]
    once = copies.repartition(*cell).dropDuplicates([*cell, "id", "x", "y", "z"])
    a = once.select(*cell, F.col("id").alias("key_a"), *[F.col(c).alias(f"{c}a") for c in "xyz"])
    b = once.select(*cell, F.col("id").alias("key_b"), *[F.col(c).alias(f"{c}b") for c in "xyz"])
    gap = sum((F.col(f"{c}a") - F.col(f"{c}b")) * (F.col(f"{c}a") - F.col(f"{c}b")) for c in "xyz")
    here = F.lit(True)
    for c in "xyz":
        here = here & (F.floor(F.least(f"{c}a", f"{c}b") / side).cast("long") == F.col(f"_c{c}"))
    return a.join(b, cell).where((F.col("key_a") < F.col("key_b")) & (gap <= radius * radius) & here).select("key_a", "key_b")


#: A boundary cell of a coverage is refined while it is larger than a 2^DEPTH-th of its polygon's extent, and further while it
#: holds more than EDGES edges; cells have sides of whole powers of four metres (so few levels are in use), not below 2^LEAST.
DEPTH, EDGES, LEAST = 2, 8, -12
_EDGE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])
_PART = T.StructType([T.StructField("hole", T.BooleanType()), T.StructField("base", T.BooleanType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("ups", "downs")], T.StructField("edges", T.ArrayType(_EDGE))])
_COVER = T.StructType([T.StructField("key_b", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("parts", T.ArrayType(_PART))])


def _corners(ring) -> np.ndarray:
    """Corners as (n, 2), without NULLs, non-finite ones, immediate repeats and the closing one."""
    if ring is None:
        return np.empty((0, 2))
    a = np.array([(c["x"], c["y"]) for c in ring if c is not None and c["x"] is not None and c["y"] is not None], float).reshape(-1, 2)
    a = a[np.isfinite(a).all(1)]
    return a[(a != np.roll(a, 1, 0)).any(1)] if len(a) > 1 else a


def _touching(e: np.ndarray, x0: np.ndarray, y0: np.ndarray, side: float) -> np.ndarray:
    """(boxes, edges): which edges (x1, y1, x2, y2) may touch closed boxes: their extents meet it and they have not all its corners on one side."""
    x0, y0 = x0[:, None], y0[:, None]
    x1, y1 = x0 + side, y0 + side
    lox, hix, loy, hiy = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    near = (lox <= x1) & (hix >= x0) & (loy <= y1) & (hiy >= y0)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    # The signed side of the middle of a box, against how far its corners may be from it.
    middle = dx * (y0 + side / 2 - e[:, 1]) - dy * (x0 + side / 2 - e[:, 0])
    reach = np.abs(dx) + np.abs(dy)
    return near & (np.abs(middle) <= reach * (side / 2 + 1e-9 * max(side, 1e-6)) + 1e-12)


def _beyond(e: np.ndarray, py: np.ndarray, x_from: np.ndarray, x_to: float) -> np.ndarray:
    """For each of some heights (half open) how many edges cross it at an x in (x_from, x_to]."""
    py = py[:, None]
    spans = (e[:, 1] > py) != (e[:, 3] > py)
    rise = np.where(e[:, 3] == e[:, 1], 1.0, e[:, 3] - e[:, 1])
    at = (e[:, 2] - e[:, 0]) * (py - e[:, 1]) / rise + e[:, 0]
    return (spans & (at > x_from[:, None]) & (at <= x_to)).sum(1)


def _borders(e: np.ndarray, x: float) -> tuple[np.ndarray, np.ndarray]:
    """Where edges cross the vertical line at x: the heights of those that go right as they rise, and of the others."""
    c = e[(e[:, 0] > x) != (e[:, 2] > x)]
    y = c[:, 1] + (x - c[:, 0]) * (c[:, 3] - c[:, 1]) / (c[:, 2] - c[:, 0])
    up = (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1]) > 0
    return np.sort(y[up]), np.sort(y[~up])


def _cover_one(key: int, ring, holes):
    """The coverage of one polygon: cells wholly inside, and cells of its boundary with what they need to test a point.

    For a part (the ring or a hole) a boundary cell keeps the edges that touch it, whether the number of edges right of its
    lower right corner is odd, and the heights at which edges cross its right border. A point is then inside the part if
    an odd number of edges is to its right: those in the cell are looked at one by one, those beyond its right border are
    the corner's, changed by every crossing of the border between the corner and the point. All of this is derived from
    the parent cell, so no cell looks at more edges than its parent holds.
    """
    outer = _corners(ring)
    if len(np.unique(outer, axis=0)) < 3:
        return
    rings = [outer, *[h for h in (_corners(h) for h in (holes if holes is not None else [])) if len(np.unique(h, axis=0)) >= 3]]
    lo, hi = outer.min(0), outer.max(0)
    top = max(LEAST, math.ceil(math.log2(max((hi - lo).max(), 2.0**LEAST))))
    top += top % 2
    side = 2.0**top
    every = [np.hstack([r, np.roll(r, -1, 0)]) for r in rings]
    far = max(e[:, [0, 2]].max() for e in every) + 1.0
    stack = []
    for cx in range(math.floor(lo[0] / side), math.floor(hi[0] / side) + 1):
        for cy in range(math.floor(lo[1] / side), math.floor(hi[1] / side) + 1):
            at = np.array([cy * side]), np.array([(cx + 1) * side])
            stack.append((top, cx, cy, [(i > 0, bool(_beyond(e, *at, far)[0] % 2), *_borders(e, (cx + 1) * side), e) for i, e in enumerate(every)]))
    i4, j4 = np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)
    while stack:
        level, cx, cy, parts = stack.pop()
        if parts and level > LEAST and (level > top - DEPTH or sum(len(q[4]) for q in parts) > EDGES):
            # All sixteen cells two levels below at once.
            side = 2.0**level
            x0, y0, x1, quarter = cx * side, cy * side, (cx + 1) * side, side / 4
            xs, ys = x0 + i4 * quarter, y0 + j4 * quarter
            alive, kept = np.ones(16, bool), [[] for _ in range(16)]
            for hole, base, ups, downs, e in parts:
                touch = _touching(e, xs, ys, quarter)
                # The corner of a cell: what lies beyond the parent's border at that height, plus what lies between the two borders.
                passed = ((ups >= y0) & (ups < ys[:, None])).sum(1) + ((downs > y0) & (downs <= ys[:, None])).sum(1)
                odd = (base + passed + _beyond(e, ys, xs + quarter, x1)) % 2 == 1
                borders = [_borders(e, x0 + (i + 1) * quarter) for i in range(3)] + [(ups, downs)]
                for c in range(16):
                    if touch[c].any():
                        (u, d), low, high = borders[i4[c]], ys[c], ys[c] + quarter
                        kept[c].append((hole, bool(odd[c]), u[(u >= low) & (u <= high)], d[(d >= low) & (d <= high)], e[touch[c]]))
                    elif odd[c] == hole:  # a cell without edges is wholly as its corner: outside the ring, or inside a hole
                        alive[c] = False
            stack += [(level - 2, 4 * cx + int(i4[c]), 4 * cy + int(j4[c]), kept[c]) for c in np.flatnonzero(alive)]
            continue
        yield (key, level, cx, cy, [(h, b, u.tolist(), d.tolist(), e.tolist()) for h, b, u, d, e in parts])


def coverage(polygons: DataFrame, id_col: str = "poly_id") -> DataFrame:
    """Adaptive coverage: per polygon the cells wholly inside (``parts`` empty) and its boundary cells, of sides that follow the
    polygon's extent and, on the boundary, the number of edges (see ``_cover_one``).

    Inner cells are as large as they can be. No row holds a whole ring: a boundary cell holds about EDGES edges, however
    many the ring has. Rings may be open, closed, of either direction or with repeated corners; NULL rings and those with
    fewer than three different corners cover nothing; corners with a NULL or NaN are left out.
    """

    part = pa.struct([("hole", pa.bool_()), ("base", pa.bool_()), *[(c, pa.list_(pa.float64())) for c in ("ups", "downs")], ("edges", pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])))])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(part)]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_COVER.names)

    def run(batches):
        for b in batches:
            rows = []
            for k, ring, holes in zip(*[b.column(c).to_pylist() for c in ("key", "ring", "holes")]):
                for r in _cover_one(k, ring, holes):
                    rows.append((*r[:4], [{"hole": q[0], "base": q[1], "ups": q[2], "downs": q[3], "edges": [dict(zip(("x1", "y1", "x2", "y2"), v)) for v in q[4]]} for q in r[4]]))
                    if len(rows) >= 4096:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    p = only(polygons, id_col, "ring", "holes").toDF("key", "ring", "holes").where(F.col("key").isNotNull() & F.col("ring").isNotNull())
    p = p.select(F.col("key").cast("long"), "ring", "holes").distinct()
    # Rings are few bytes but much work: their number of tasks must not follow their size.
    return p.repartition(4 * partitions(polygons.sparkSession), "key").mapInArrow(run, _COVER)


def _holds(part, x, y, x1, y0):
    """Whether a part of a boundary cell, with its right border at x1 and lower one at y0, holds (x, y): native expressions over its few edges."""
    beyond = F.size(F.filter(part["ups"], lambda v: (v >= y0) & (v < y))) + F.size(F.filter(part["downs"], lambda v: (v > y0) & (v <= y)))
    def crossing(e):
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at) & (at <= x1)

    return (F.size(F.filter(part["edges"], crossing)) + beyond + part["base"].cast("int")) % 2 == 1


def inside(points: DataFrame, polygons: DataFrame, id_col: str = "point_id", poly_col: str = "poly_id", tile: float = 1024.0) -> DataFrame:
    """Pairs ``(key_a point, key_b polygon)``, each once, where x, y lie within the ring (even-odd) and in none of the holes.

    Points with a NULL id or non-finite x or y lie in nothing, z does not matter, repeated rows count once. An empty
    table on either side gives no pairs. Points meet cells in an equi-join: an inner cell accepts at once, a boundary cell
    tests the few edges it holds. A point has one copy for each level of cells that its tile of ``tile`` metres has any of;
    points of tiles without polygons are left out before anything moves. Cells are broadcast up to BROADCAST_BYTES, else
    both sides are shuffled by cell (a hot cell is split by AQE, as the join is an ordinary one).
    """
    cells = cut(coverage(polygons, poly_col))
    p = only(points, id_col, "x", "y").toDF("key_a", "x", "y")
    p = p.select("key_a", F.col("x").cast("double"), F.col("y").cast("double")).where(F.col("key_a").isNotNull() & finite("x", "y"))
    side = F.pow(F.lit(2.0), F.col("level"))
    span = cells.select("level", *[F.sequence(F.floor(F.col(f"c{c}") * side / tile).cast("long"), F.floor(((F.col(f"c{c}") + 1) * side - 1e-9) / tile).cast("long")).alias(f"t{c}") for c in "xy"])
    tiles = cut(span.withColumn("tx", F.explode("tx")).withColumn("ty", F.explode("ty")).groupBy("tx", "ty").agg(F.collect_set("level").alias("levels")))
    weight = cells.agg(F.sum(64 + F.aggregate("parts", F.lit(0), lambda a, q: a + 64 + 32 * F.size(q["edges"]) + 8 * (F.size(q["ups"]) + F.size(q["downs"])))).alias("w"), F.count(F.lit(1))).first()[0]
    if weight is None:
        return p.limit(0).select("key_a", F.lit(0).cast("long").alias("key_b"))
    at = p.withColumns({f"t{c}": F.floor(F.col(c) / tile).cast("long") for c in "xy"})
    at = at.join(F.broadcast(tiles) if 64 * tiles.count() <= BROADCAST_BYTES else tiles, ["tx", "ty"]).drop("tx", "ty")
    at = at.withColumn("level", F.explode("levels")).drop("levels")
    at = at.withColumns({f"c{c}": F.floor(F.col(c) / side).cast("long") for c in "xy"})
    met = at.join(F.broadcast(cells) if weight <= BROADCAST_BYTES else cells, ["level", "cx", "cy"])
    x, y, x1, y0 = F.col("x"), F.col("y"), (F.col("cx") + 1) * side, F.col("cy") * side
    # A part of the boundary must hold the point if it is the ring, and must not if it is a hole.
    met = met.where(F.forall("parts", lambda q: _holds(q, x, y, x1, y0) != q["hole"]))
    return met.select("key_a", "key_b").distinct()
