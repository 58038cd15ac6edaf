"""Density clusters and nearest planes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import knn
from pointloom.operators.graph import components
from pointloom.runtime import cut, finite


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``point_id, cluster``: density clusters named by their smallest core point; 0 for noise.

    A core point has at least ``least`` points within ``eps``, itself included. Core points within reach of each other are
    connected; a border point takes the smallest cluster within its reach, whatever the order of rows. A cluster whose
    smallest core point has the id 0 would be named as noise: ids are expected above 0. Points without a place are noise.

    Cells whose points are all within reach of each other carry the work. The points of a cell with ``least`` of them are
    core without looking; only the others count their neighbours. All core points of a cell are one node of the graph,
    named by the smallest. A few points that stand for each cell give most links; then cells near one of another group
    are looked at in full. So dense places cost by their cells, pairs of points are never written, and no pair of a dense
    group is looked at.
    """
    ids = points.select("point_id").where("point_id IS NOT NULL").distinct()
    side = eps / math.sqrt(3) * (1 - 1e-9)
    cell = ["_x", "_y", "_z"]
    p = cut(points.select("point_id", "x", "y", "z").where(F.col("point_id").isNotNull() & finite("x", "y", "z")).dropDuplicates(["point_id"]).withColumns({f"_{c}": F.floor(F.col(c) / side).cast("long") for c in "xyz"}))
    full = p.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    p = cut(p.join(full.withColumn("_full", F.lit(True)), cell, "left"))
    thin = p.where("_full IS NULL")
    known = knn.reached(thin, p, eps).groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least - 1).select("point_id")
    dense = p.where("_full")
    core = dense if least > 1 else p
    core = cut(core.unionByName(thin.join(known, "point_id", "left_semi")).dropDuplicates(["point_id"]).drop("_full"))
    names = core.groupBy(*cell).agg(F.min("point_id").alias("name"))
    core = cut(core.join(names, cell))
    sub = [F.floor(F.col(c) * 2 / side).cast("long").alias(f"_s{c}") for c in "xyz"]
    stand = core.groupBy("name", *sub).agg(F.min(F.struct("point_id", "x", "y", "z")).alias("s")).select("name", "s.*")
    links = cut(knn.reached(stand, stand, eps, ["name"]).where("name < n_name").select("name", "n_name").distinct())
    group = _groups(core, links)
    # Cells within two of a cell of another group may still have a pair within reach.
    own = cut(group.groupBy(*cell).agg(F.min("group").alias("group")))
    around = own
    for c in cell:
        around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)))
    rim = around.groupBy(*cell).agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 <> g1").select(*cell)
    open_ = cut(group.join(rim, cell, "left_semi"))
    if not open_.isEmpty():
        more = cut(knn.reached(open_, open_, eps, ["group"]).where("group < n_group").select("group", "n_group").distinct())
        if not more.isEmpty():
            group = _groups(group.withColumnRenamed("group", "name"), more.toDF("name", "n_name"))
    named = cut(group.select("point_id", "x", "y", "z", "group"))
    rest = p.select("point_id", "x", "y", "z").join(named.select("point_id"), "point_id", "left_anti").withColumn("group", F.lit(0).cast("long"))
    border = knn.reached(rest, named, eps, ["group"]).groupBy("point_id").agg(F.min("n_group").alias("group"))
    out = ids.join(named.select("point_id", "group").unionByName(border), "point_id", "left")
    return out.select("point_id", F.coalesce("group", F.lit(0)).alias("cluster"))


def _groups(core: DataFrame, links: DataFrame) -> DataFrame:
    """The core points with the group that links between their names put them in."""
    comp = components(links, "name", "n_name").select(F.col("node").alias("name"), F.col("component").alias("_c"))
    return cut(core.join(comp, "name", "left").withColumn("group", F.coalesce("_c", "name")).drop("_c", "name"))


def nearest_plane(points: DataFrame, planes: DataFrame, reach: float) -> DataFrame:
    """``point_id, plane_id, distance``: of all planes of a point's file, wherever their centroids are, the one nearest along
    its normal, at most ``reach`` away; ties by id.

    Planes meet the occupied cubes of their file, first coarse and then fine ones; a cube is left out only if none of it can
    be within reach. Points meet the planes of their fine cube, so none is copied.
    """
    good = planes.where("plane_id IS NOT NULL AND size(normal) = 3 AND size(centroid) = 3").where("NOT exists(normal, v -> v IS NULL OR isnan(v)) AND NOT exists(centroid, v -> v IS NULL OR isnan(v))")
    length = F.sqrt(F.aggregate("normal", F.lit(0.0), lambda a, v: a + v * v))
    g = good.groupBy("plane_id").agg(F.max(F.struct("file_id", "normal", "centroid")).alias("g")).select("plane_id", "g.*").withColumn("len", length).where("len > 0")
    g = g.select("plane_id", "file_id", *[(F.col("normal")[i] / F.col("len")).alias(f"n{c}") for i, c in enumerate("xyz")], *[F.col("centroid")[i].alias(f"g{c}") for i, c in enumerate("xyz")])
    coarse, fine = 32 * reach, 4 * reach
    p = cut(points.where(F.col("point_id").isNotNull() & finite("x", "y", "z")).select("point_id", "file_id", "x", "y", "z"))
    p = p.withColumns({f"c{c}": F.floor(F.col(c) / fine).cast("long") for c in "xyz"})

    def crossed(cubes: DataFrame, side: float, keys: list[str]) -> DataFrame:
        off = sum(((F.col(f"{k}") + 0.5) * side - F.col(f"g{c}")) * F.col(f"n{c}") for k, c in zip(keys, "xyz"))
        return cubes.where(F.abs(off) <= (F.abs("nx") + F.abs("ny") + F.abs("nz")) * (side / 2) + reach + 1e-6)

    cubes = cut(p.select("file_id", "cx", "cy", "cz").distinct().withColumns({f"b{c}": F.floor(F.col(f"c{c}") / 8).cast("long") for c in "xyz"}))
    large = crossed(cubes.select("file_id", "bx", "by", "bz").distinct().join(g, "file_id"), coarse, ["bx", "by", "bz"])
    small = crossed(cubes.join(large, ["file_id", "bx", "by", "bz"]), fine, ["cx", "cy", "cz"]).drop("bx", "by", "bz")
    d = F.abs((F.col("x") - F.col("gx")) * F.col("nx") + (F.col("y") - F.col("gy")) * F.col("ny") + (F.col("z") - F.col("gz")) * F.col("nz"))
    met = p.join(small, ["file_id", "cx", "cy", "cz"]).where(d <= reach)
    best = met.groupBy("point_id").agg(F.min(F.struct(d.alias("d"), "plane_id")).alias("b"))
    return best.select("point_id", F.col("b.plane_id").alias("plane_id"), F.col("b.d").alias("distance"))
