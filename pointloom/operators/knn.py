"""Neighbourhoods: the k nearest and all within a radius, and measures over them.

Two forms. ``within_radius`` and ``nearest_within`` are relational (cells, one shuffle, generated code) and give long
tables of neighbours. ``neighbourhoods`` finds the exact k nearest at any distance and computes array measures in one
Arrow pass over leaves of a quadtree with a halo; points whose neighbours may be beyond it descend the tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.runtime import cut, finite, only

#: Side of the finest cells of the tree in metres (of places with very many points down to FINEST), points of a leaf, halo
#: of a leaf as a share of its side.
FINE, FINEST, FULL, HALO = 1.0, 1e-3, 1024, 0.25


def reached(home: DataFrame, others: DataFrame, radius: float, carry: list[str] = []) -> DataFrame:
    """``point_id, nid, d`` and carried columns of both (``<c>`` of the point, ``n_<c>`` of the other): the others within ``radius``.

    Cells of two radii; a point stays in its own, an other is put into every cell it may be reached from (about three of
    them). Both sides are shuffled by cell; a hot cell is split by AQE, as the join is an ordinary one.
    """
    side, reach = 2 * radius, radius * (1 + 1e-9)
    good = F.col("point_id").isNotNull() & finite("x", "y", "z")
    cells = only(others, "point_id", "x", "y", "z", *carry).where(good)
    for c in "xyz":
        own, offset = F.floor(F.col(c) / side).cast("long"), F.col(c) - F.floor(F.col(c) / side) * side
        low = F.when(offset <= reach, own - 1)
        high = F.when(offset >= side - reach, own + 1)
        cells = cells.withColumn(f"c{c}", F.explode(F.array_compact(F.array(own, low, high))))
    cells = cells.withColumnsRenamed({"point_id": "nid", **{c: f"n_{c}" for c in carry}})
    at = only(home, "point_id", "x", "y", "z", *carry).where(good)
    at = at.select("point_id", *carry, *[F.col(c).alias(f"q{c}") for c in "xyz"], *[F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in "xyz"])
    met = at.join(cells, ["cx", "cy", "cz"]).where("point_id <> nid")
    d2 = sum(((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "yz"), (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    return met.where(d2 <= radius * radius).select("point_id", "nid", F.sqrt(d2).alias("d"), *carry, *[f"n_{c}" for c in carry])


def within_radius(points: DataFrame, radius: float) -> DataFrame:
    """``point_id, nid, d``: all pairs of different points at most ``radius`` apart, in both directions."""
    return reached(points, points, radius)


def nearest_within(points: DataFrame, k: int, radius: float) -> DataFrame:
    """``point_id, nid, d, rank``: the k nearest others within ``radius`` (fewer where fewer are there); ties by id."""
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("d", "nid"))
    return within_radius(points, radius).withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_others(points: DataFrame, others: DataFrame, k: int, radii: tuple[float, ...]) -> DataFrame:
    """``point_id, nid, d, rank``: the k nearest of ``others (nid, x, y)`` in the plane nearer than the last radius; ties by id.

    Points that have k within a radius are served by it; only the others look through the next one, so dense places cost
    no wide search. Points move to no other cell; ``others`` are put into the nine cells around their own.
    """
    todo = points.where(F.col("point_id").isNotNull() & finite("x", "y")).select("point_id", F.col("x").alias("qx"), F.col("y").alias("qy"))
    o = others.where(finite("x", "y")).select("nid", "x", "y")
    out = None
    for r in radii:
        cells = o
        for c in "xy":
            own = F.floor(F.col(c) / r).cast("long")
            cells = cells.withColumn(f"c{c}", F.explode(F.sequence(own - 1, own + 1)))
        at = todo.withColumns({f"c{c}": F.floor(F.col(f"q{c}") / r).cast("long") for c in "xy"})
        dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
        met = at.join(cells, ["cx", "cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") < r)
        rank = F.row_number().over(Window.partitionBy("point_id").orderBy("d", "nid"))
        got = cut(met.withColumn("rank", rank).where(F.col("rank") <= k).select("point_id", "nid", "d", "rank"))
        full = got.where(F.col("rank") == k).select("point_id")
        keep = got if r == radii[-1] else got.join(full, "point_id", "left_semi")
        out = keep if out is None else out.unionByName(keep)
        if r != radii[-1]:
            todo = cut(todo.join(full, "point_id", "left_anti"))
    return out


Measure = Callable[[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


@dataclass(frozen=True)
class Tree:
    """A quadtree over the plane: cells of ``side`` (level 0) with counts and heights, all nodes above them, and its leaves.

    A leaf is the largest node with at most FULL points; a finest cell that holds more is one as well. All are tables.
    """

    side: float
    top: int
    cells: DataFrame
    nodes: DataFrame
    leaves: DataFrame
    levels: list[int]
    most: int
    total: int


def _cell(side: float) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in "xy"]


def _tree(p: DataFrame) -> Tree | None:
    """The tree of a table, or None of an empty one. Points are read once for each fineness of cells, mostly once."""
    side = FINE
    while True:
        cells = cut(p.groupBy(*_cell(side)).agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1")))
        span = cells.agg(F.max("n").alias("n"), F.sum("n").alias("total"), *[g(c).alias(f"{c}{i}") for c in ("cx", "cy") for i, g in ((0, F.min), (1, F.max))]).first()
        if span["n"] is None:
            return None
        if span["n"] <= 4 * FULL or side <= FINEST:
            break
        side /= 8
    top = max(int(span["cx1"] - span["cx0"]).bit_length(), int(span["cy1"] - span["cy0"]).bit_length())
    top += top % 2
    at = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    nodes = at.groupBy("level", F.expr("shiftright(cx, level)").alias("bx"), F.expr("shiftright(cy, level)").alias("by")).agg(F.sum("n").alias("n"), F.min("z0").alias("z0"), F.max("z1").alias("z1"))
    nodes = cut(nodes)
    above = nodes.where(F.col("n") > FULL).select((F.col("level") - 1).alias("level"), F.col("bx").alias("_px"), F.col("by").alias("_py"))
    small = nodes.where((F.col("n") <= FULL) | (F.col("level") == 0)).withColumns({"_px": F.shiftright("bx", 1), "_py": F.shiftright("by", 1)})
    leaves = small.join(above, ["level", "_px", "_py"], "left_semi").unionByName(small.where(F.col("level") == top)).select("level", "bx", "by", "n")
    # The halo of a leaf is bounded too: where the nodes around it hold many points it has none, and its rim is its own border.
    around = leaves.select("level", F.col("bx").alias("_x"), F.col("by").alias("_y"), *[F.explode(F.sequence(F.col("bx") - 1, F.col("bx") + 1)).alias("bx")], "by")
    around = around.withColumn("by", F.explode(F.sequence(F.col("by") - 1, F.col("by") + 1))).join(nodes.select("level", "bx", "by", "n"), ["level", "bx", "by"])
    around = around.groupBy("level", F.col("_x").alias("bx"), F.col("_y").alias("by")).agg((F.sum("n") <= 8 * FULL).alias("wide"))
    leaves = cut(leaves.join(around, ["level", "bx", "by"]))
    return Tree(side, top, cells, nodes, leaves, sorted(r["level"] for r in leaves.select("level").distinct().collect()), int(span["n"]), int(span["total"]))


def _seen(p: DataFrame, tree: Tree, k: int) -> DataFrame:
    """Every point once per leaf that it lies in (``own``) or whose halo it is in. What a leaf needs is found by cells."""
    w = F.pow(F.lit(2.0), F.col("level"))
    at = tree.cells.select("cx", "cy").withColumn("level", F.explode(F.array(*[F.lit(x) for x in tree.levels])))
    for c in "xy":
        low, high = F.floor((F.col(f"c{c}") - w * HALO) / w), F.floor((F.col(f"c{c}") + 1 + w * HALO) / w)
        at = at.withColumn(f"b{c}", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    home = (F.expr("shiftright(cx, level)") == F.col("bx")) & (F.expr("shiftright(cy, level)") == F.col("by"))
    cover = cut(at.join(tree.leaves, ["level", "bx", "by"]).withColumn("own", home).where("own OR wide"))
    rows = p.withColumns({f"c{c}": e for c, e in zip("xy", _cell(tree.side))}).join(cover, ["cx", "cy"]).drop("cx", "cy").withColumns({"cand": F.lit(True), "salt": F.lit(0)})
    if tree.most <= 4 * FULL:
        return rows.drop("n")
    # Cells of FINEST with too many points: of points at one place only the k + 1 smallest ids can be neighbours, and the
    # points are spread over salts.
    much = F.col("n") > 4 * FULL
    place = F.row_number().over(Window.partitionBy("level", "bx", "by", "x", "y", "z").orderBy("point_id"))
    salts = F.ceil(F.col("n") / (4 * FULL)).cast("int")
    big = rows.where(much).withColumns({"cand": place <= k + 1, "_mine": F.pmod(F.xxhash64("point_id"), salts).cast("int")})
    big = big.withColumn("salt", F.explode(F.when(F.col("cand"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array("_mine"))))
    big = big.withColumn("own", F.col("own") & (F.col("salt") == F.col("_mine"))).where("own OR cand").drop("_mine")
    return rows.where(~much).unionByName(big).drop("n")


def neighbourhoods(points: DataFrame, k: int, measure: Measure, schema: str, carry: list[str] = []) -> DataFrame:
    """``point_id`` and the columns of ``schema`` that ``measure`` gives over each point's k nearest others, at any distance.

    measure(xyz of the points (m, 3), distances (m, k), neighbours' xyz (m, k, 3), neighbours' carried columns (m, k) and
            the points' own as own_<column> (m), valid (m, k)) -> columns. Where a table holds fewer than k others, ``valid`` is false for the rest.
    points  ``point_id, x, y, z`` and the carried columns, one row per id; non-finite places and NULL ids are left out.

    Leaves of a quadtree, of at most FULL points, are searched with a halo in one Arrow group each. A point is done if its
    k-th neighbour is nearer than the rim of what its leaf saw. The others descend the tree: of the nodes of each level
    only those remain that may hold a nearer point than k others are sure to be, down to single cells (``_descend``). So
    no leaf is ever widened, wherever its points' neighbours are. Neighbours are in order of distance, ties by id.
    """
    p = cut(only(points, "point_id", "x", "y", "z", *carry).where(F.col("point_id").isNotNull() & finite("x", "y", "z")))
    names = [c.strip().split()[0] for c in schema.split(",")]
    kind = f"point_id long, done boolean, leaf int, reach double, {schema}"
    tree = _tree(p)
    if tree is None:
        return p.limit(0).select("point_id", *[F.lit(None).cast(c.strip().split()[1]).alias(n) for n, c in zip(names, schema.split(","))])
    total, side0 = tree.total, tree.side

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side = side0 * 2.0 ** key[0].as_py()
        halo = HALO if t["wide"][0].as_py() else 0.0
        lo = np.array([key[1].as_py(), key[2].as_py()]) * side - side * halo
        hi = lo + side * (1 + 2 * halo)
        ids, own, cand = t["point_id"].to_numpy(), np.asarray(t["own"].to_numpy(zero_copy_only=False), bool), np.asarray(t["cand"].to_numpy(zero_copy_only=False), bool)
        xyz = np.stack([t[c].to_numpy() for c in "xyz"], 1)
        extra = {c: t[c].to_numpy(zero_copy_only=False) for c in carry}
        parts = [_chunk(rows, ids, xyz, extra, np.flatnonzero(cand), k, lo, hi, total, measure) for rows in np.array_split(np.flatnonzero(own), max(1, math.ceil(own.sum() * cand.sum() / 1_000_000)))]
        parts = [q for q in parts if q is not None]
        cols = {c: np.concatenate([q[c] for q in parts]) if parts else np.empty(0) for c in ["point_id", "done", "reach", *names]}
        cols["leaf"] = np.full(len(cols["point_id"]), key[0].as_py())
        return pa.table({c: pa.array(cols[c], from_pandas=c == "reach") for c in ["point_id", "done", "leaf", "reach", *names]}).cast(_arrow_schema(kind))

    got = cut(_seen(p, tree, k).groupBy("level", "bx", "by", "salt").applyInArrow(run, kind))
    todo = got.where("NOT done").select("point_id", "leaf", "reach")
    out = got.where("done").select("point_id", *names)
    if todo.isEmpty():
        return out
    asked = cut(p.join(todo, "point_id"))
    found = _descend(p, asked, tree, k, carry)
    return out.unionByName(_measured(found, asked, k, measure, schema, carry))


def _descend(p: DataFrame, asked: DataFrame, tree: Tree, k: int, carry: list[str]) -> DataFrame:
    """``point_id, rank, d`` and the neighbours' places and carried columns: the k nearest of some points, through the tree.

    asked  points with ``reach``, the distance of the k-th neighbour that their leaf saw (NULL if it saw fewer), and ``leaf``,
           its level. A leaf that saw too few has a parent with more than FULL points: its farthest corner is their reach.

    Each point starts at the nodes of the level whose side is its reach, four or nine of them; nodes that begin beyond the
    reach are dropped, the others replaced by their children two levels below, down to single cells. Where the reach is the
    parent's, it shrinks on the way: the nodes of a level, in order of their greatest distance, hold k + 1 points (the point
    itself among them) up to some distance.
    """
    sure = asked.where("reach IS NOT NULL").select("point_id", "x", "y", "z", (F.col("reach") * (1 + 1e-9)).alias("r"))
    w = F.lit(tree.side) * F.pow(F.lit(2.0), F.col("level"))
    far = [F.greatest(F.abs(F.col(c) - F.col(f"b{c}") * w), F.abs((F.col(f"b{c}") + 1) * w - F.col(c))) for c in "xy"] + [F.greatest(F.abs(F.col("z") - F.col("z0")), F.abs(F.col("z1") - F.col("z")))]
    own = asked.where("reach IS NULL").select("point_id", "x", "y", "z", F.least(F.col("leaf") + 1, F.lit(tree.top)).alias("level"), *[F.floor(F.col(c) / tree.side).cast("long").alias(f"c{c}") for c in "xy"])
    own = own.withColumns({f"b{c}": F.expr(f"shiftright(c{c}, level)") for c in "xy"}).join(tree.nodes, ["level", "bx", "by"])
    unsure = cut(own.select("point_id", "x", "y", "z", (F.sqrt(far[0] * far[0] + far[1] * far[1] + far[2] * far[2]) * (1 + 1e-9)).alias("r")))
    cells = _held(sure, tree, k, False)
    if not unsure.isEmpty():
        cells = cells.unionByName(_held(unsure, tree, k, True))
    f = cut(cells.select("point_id", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"), F.col("bx").alias("cx"), F.col("by").alias("cy"), "r"))
    others = p.withColumns({f"c{c}": e for c, e in zip("xy", _cell(tree.side))}).withColumnRenamed("point_id", "_oid")
    d2 = sum(((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "yz"), (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    met = f.join(others, ["cx", "cy"]).withColumn("d2", d2).where((F.col("_oid") != F.col("point_id")) & (F.col("d2") <= F.col("r") * F.col("r")))
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("d2", "_oid"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("point_id", "rank", F.sqrt("d2").alias("d"), *dict.fromkeys(["x", "y", "z", *carry]))


def _held(q: DataFrame, tree: Tree, k: int, shrink: bool) -> DataFrame:
    """``point_id, x, y, z, r, bx, by``: the cells of level 0 within reach ``r`` of each point, from the level of its reach down."""
    least = F.ceil(F.log2(F.greatest(F.col("r") / tree.side, F.lit(1.0))) / 2).cast("int") * 2
    q = cut(q.withColumn("start", F.least(least, F.lit(tree.top))))
    top = q.agg(F.max("start")).first()[0]
    f = None
    for level in range(top if top is not None else 0, -1, -2):
        s = tree.side * 2.0**level
        begun = q.where(F.col("start") == level).drop("start")
        for c in "xy":
            begun = begun.withColumn(f"b{c}", F.explode(F.sequence(F.floor((F.col(c) - F.col("r")) / s).cast("long"), F.floor((F.col(c) + F.col("r")) / s).cast("long"))))
        if f is not None:
            for c in "xy":
                f = f.withColumn(f"b{c}", F.explode(F.sequence(F.col(f"b{c}") * 4, F.col(f"b{c}") * 4 + 3)))
            begun = begun.unionByName(f)
        near, far = [], []
        for c, lo, hi in (("x", F.col("bx") * s, (F.col("bx") + 1) * s), ("y", F.col("by") * s, (F.col("by") + 1) * s), ("z", F.col("z0"), F.col("z1"))):
            near.append(F.greatest(lo - F.col(c), F.col(c) - hi, F.lit(0.0)))
            far.append(F.greatest(F.abs(F.col(c) - lo), F.abs(hi - F.col(c))))
        # What the extent in the plane leaves out needs no look at the nodes.
        begun = begun.where(near[0] * near[0] + near[1] * near[1] <= F.col("r") * F.col("r"))
        f = begun.join(tree.nodes.where(F.col("level") == level).drop("level"), ["bx", "by"])
        f = f.where(near[0] * near[0] + near[1] * near[1] + near[2] * near[2] <= F.col("r") * F.col("r"))
        if shrink:
            f = f.withColumns({"_near": F.sqrt(sum((v * v for v in near[1:]), near[0] * near[0])), "_far": F.sqrt(sum((v * v for v in far[1:]), far[0] * far[0]))})
            f = f.withColumn("_upto", F.sum("n").over(Window.partitionBy("point_id").orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)))
            reach = F.min(F.when(F.col("_upto") >= k + 1, F.col("_far"))).over(Window.partitionBy("point_id"))
            f = f.withColumn("r", F.least(F.col("r"), reach * (1 + 1e-9))).where(F.col("_near") <= F.col("r"))
        f = f.select("point_id", "x", "y", "z", "r", "bx", "by")
    return f


def _measured(found: DataFrame, asked: DataFrame, k: int, measure: Measure, schema: str, carry: list[str]) -> DataFrame:
    """``measure`` over ranked neighbours in rows: at most k to an array, many points to a batch."""
    cols = list(dict.fromkeys(["x", "y", "z", *carry]))
    lists = found.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("rank", "d", *[F.col(c).alias(f"n_{c}") for c in cols]))).alias("near"))
    rows = asked.select("point_id", *cols).join(lists, "point_id", "left")
    names = [c.strip().split()[0] for c in schema.split(",")]
    kind = f"point_id long, {schema}"

    def run(batches):
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            near = b.column("near")
            n = np.nan_to_num(np.asarray(near.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int)
            flat = near.flatten()
            valid = np.arange(k)[None] < n[:, None]

            def padded(name: str, fill, flat=flat, valid=valid, m=m):
                v = flat.field(name).to_numpy(zero_copy_only=False)
                full = np.full((m, k), fill, dtype=v.dtype if len(v) else float)
                full[valid] = v
                return full

            q = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
            nxyz = np.stack([padded(f"n_{c}", 0.0) for c in "xyz"], 2)
            extra = {c: padded(f"n_{c}", 0) for c in carry} | {f"own_{c}": b.column(c).to_numpy(zero_copy_only=False) for c in carry}
            out = measure(q, padded("d", np.inf), nxyz, extra, valid)
            t = pa.table({"point_id": b.column("point_id"), **{c: pa.array(out[c]) for c in names}}).cast(_arrow_schema(kind))
            yield from t.to_batches()

    return rows.mapInArrow(run, kind)


def _arrow_schema(kind: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c, types[t]) for c, t in (f.strip().split() for f in kind.split(","))])


def _chunk(rows, ids, xyz, extra, cand, k, lo, hi, total, measure):
    if not len(rows):
        return None
    q, n = xyz[rows], len(cand)
    others, oids = xyz[cand], ids[cand]
    d2 = (q[:, None, 0] - others[None, :, 0]) ** 2
    d2 += (q[:, None, 1] - others[None, :, 1]) ** 2
    d2 += (q[:, None, 2] - others[None, :, 2]) ** 2
    at = np.searchsorted(cand, rows)  # the place of a point among the candidates, if it is one
    itself = (at < n) & (cand[np.minimum(at, n - 1)] == rows)
    d2[np.flatnonzero(itself), at[itself]] = np.inf
    m = min(k, n - 1)
    if m > 0:
        # Some more than k, so that a tie at the end is seen; then in order of distance and id.
        some = min(m + 8, n)
        near = np.argpartition(d2, some - 1, axis=1)[:, :some] if some < n else np.broadcast_to(np.arange(n), (len(rows), n)).copy()
        d = np.take_along_axis(d2, near, 1)
        order = np.lexsort((oids[near], d), axis=1)[:, :m]
        most = d.max(1)
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        for r in np.flatnonzero(d[:, -1] == most) if some < n else []:  # the tie may go on beyond what was taken
            near[r] = np.lexsort((oids, d2[r]))[:m]
    else:
        near, d = np.zeros((len(rows), 0), int), np.zeros((len(rows), 0))
    if m < k:
        pad = k - m
        near, d = np.pad(near, ((0, 0), (0, pad))), np.pad(d, ((0, 0), (0, pad)), constant_values=np.inf)
    valid = np.isfinite(d)
    rim = np.minimum(q[:, :2] - lo, hi - q[:, :2]).min(1)
    enough = valid[:, -1] if k else np.ones(len(rows), bool)
    done = (enough & (np.sqrt(d[:, -1]) < rim)) | (len(ids) >= total)
    dist = np.sqrt(d)
    out = measure(q, dist, others[near], {c: v[cand][near] for c, v in extra.items()} | {f"own_{c}": v[rows] for c, v in extra.items()}, valid)
    return {"point_id": ids[rows], "done": done, "reach": np.where(enough, dist[:, -1] if k else 0.0, np.nan), **out}


def covariance_measures(q, d, nxyz, extra, valid):
    """Eigenvalues (largest first) and the normal (upwards) of the k nearest and the point itself."""
    every = np.concatenate([q[:, None, :], nxyz], 1)
    w = np.concatenate([np.ones((len(q), 1), bool), valid], 1)[..., None]
    n = w.sum(1)
    mean = (every * w).sum(1) / n
    c = (every - mean[:, None]) * w
    cov = np.einsum("mki,mkj->mij", c, c) / n[..., None]
    values, vectors = np.linalg.eigh(cov)
    normal = vectors[:, :, 0]
    normal = normal * np.where(normal[:, 2:] < 0, -1.0, 1.0)
    values = np.maximum(values, 0.0)
    return {"l1": values[:, 2], "l2": values[:, 1], "l3": values[:, 0], "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2]}


def density_measures(q, d, nxyz, extra, valid):
    """Density k / (4/3 pi r^3), mean and deviation of distances, extent and vertical deviation of the neighbours."""
    n = np.maximum(valid.sum(1), 1)
    dist = np.where(valid, d, 0.0)
    mean = dist.sum(1) / n
    std = np.sqrt((np.where(valid, d - mean[:, None], 0.0) ** 2).sum(1) / n)
    far = dist.max(1) if dist.shape[1] else np.zeros(len(q))
    with np.errstate(divide="ignore", invalid="ignore"):
        density = np.where(far > 0, valid.sum(1) / (4.0 / 3.0 * np.pi * far**3), 0.0)
    low = np.where(valid[..., None], nxyz, np.inf).min(1)
    high = np.where(valid[..., None], nxyz, -np.inf).max(1)
    span = np.where(np.isfinite(high - low), high - low, 0.0)
    flat = np.hypot(span[:, 0], span[:, 1])
    ratio = np.where(flat > 1e-10, span[:, 2] / np.where(flat > 1e-10, flat, 1.0), 0.0)
    zs = np.where(valid, nxyz[..., 2], 0.0)
    zm = zs.sum(1) / n
    vstd = np.sqrt((np.where(valid, nxyz[..., 2] - zm[:, None], 0.0) ** 2).sum(1) / n)
    return {
        "n": valid.sum(1).astype(np.int32), "point_density": density, "mean_distance": mean, "std_distance": std, "max_distance": far, "n_2m": ((d <= 2.0) & valid).sum(1).astype(np.int32),
        "extent": np.sqrt((span**2).sum(1)), "height_ratio": ratio, "vertical_std": vstd,
    }


def nearest(points: DataFrame, k: int) -> DataFrame:
    """``point_id, nid, d, rank``: the k nearest others at any distance (fewer only where the table holds fewer); ties by id."""

    def ids_and_distances(q, d, nxyz, extra, valid):
        cols = {f"n{i}": extra["nid"][:, i] for i in range(k)} | {f"d{i}": d[:, i] for i in range(k)}
        return {"n": valid.sum(1).astype(np.int32), **cols}

    kind = ", ".join(["n int", *[f"n{i} long" for i in range(k)], *[f"d{i} double" for i in range(k)]])
    wide = neighbourhoods(points.withColumn("nid", F.col("point_id")), k, ids_and_distances, kind, ["nid"])
    one = F.array(*[F.struct(F.col(f"n{i}").alias("nid"), F.col(f"d{i}").alias("d"), F.lit(i + 1).alias("rank")) for i in range(k)])
    return wide.select("point_id", F.explode(F.slice(one, F.lit(1), F.col("n"))).alias("e")).select("point_id", "e.*")


def spread_measures(q, d, nxyz, extra, valid):
    """Number of the neighbours and the population covariances of them and the point, relative to it (they keep their digits)."""
    rel = np.where(valid[..., None], nxyz - q[:, None, :], 0.0)
    n = valid.sum(1) + 1
    c = np.where(valid[..., None], rel - (rel.sum(1) / n[:, None])[:, None, :], 0.0)
    own = -rel.sum(1) / n[:, None]
    cov = (np.einsum("mki,mkj->mij", c, c) + own[:, :, None] * own[:, None, :]) / n[:, None, None]
    return {"n": n.astype(np.int32), **{f"c{a}{b}": cov[:, i, j] for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j}}


def median_measure(column: str) -> Measure:
    """``n, m``: number of neighbours and the median of their ``column``."""

    def run(q, d, nxyz, extra, valid):
        n, v = valid.sum(1), np.sort(np.where(valid, extra[column], np.inf), 1)
        at = np.arange(len(v))
        low, high = v[at, np.maximum(n - 1, 0) // 2], v[at, np.minimum(n // 2, v.shape[1] - 1)]
        return {"n": n.astype(np.int32), "m": np.where(n > 0, (low + high) / 2, np.nan)}

    return run


def label_measures(q, d, nxyz, extra, valid):
    """``n, same, other``: neighbours, those with the point's label, and the most frequent label (the lowest on ties)."""
    lab = np.asarray(extra["label"], np.int64)
    count = np.where(valid, ((lab[:, :, None] == lab[:, None, :]) & valid[:, None, :]).sum(2), -1)
    other = np.where(count == count.max(1)[:, None], lab, np.iinfo(np.int64).max).min(1)
    same = ((lab == np.asarray(extra["own_label"], np.int64)[:, None]) & valid).sum(1)
    return {"n": valid.sum(1).astype(np.int32), "same": same.astype(np.int32), "other": other}


def normal_measures(q, d, nxyz, extra, valid):
    """``n, curvature``: the mean length of the differences between the normals (nx, ny, nz) of a point and its neighbours."""
    gap = np.sqrt(sum((extra[c] - extra[f"own_{c}"][:, None]) ** 2 for c in ("nx", "ny", "nz")))
    n = valid.sum(1)
    return {"n": n.astype(np.int32), "curvature": np.where(valid, gap, 0.0).sum(1) / np.maximum(n, 1)}


def agg_features(neighbours: DataFrame, points: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Aggregates over a long table of neighbours joined with the neighbours' columns (named ``n_<column>``)."""
    others = points.select(*[F.col(c).alias(f"n_{c}" if c != "point_id" else "nid") for c in points.columns])
    return neighbours.join(others, "nid").groupBy("point_id").agg(*[c.alias(n) for n, c in measures.items()])
