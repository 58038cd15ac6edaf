"""Overlapping patches, augmentation, resampling and splits of point sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.rank import ranked
from pointloom.runtime import cut, partitions


def patch_grid(points: DataFrame, size: float, overlap: float, least: int, group: str = "tile") -> DataFrame:
    """Every point once per patch that holds it, with ``px, py`` and coordinates relative to the patch's middle.

    Patches of ``size`` metres start at the group's least x and y and follow at size x (1 - overlap), as long as they
    begin before its greatest; cells are half open. Patches with fewer than ``least`` points are left out.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    stride = size * (1 - overlap)
    points = cut(points)  # read three times below
    span = points.groupBy(group).agg(*[f(c).alias(f"_{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    at = points.join(span, group)
    for c in "xy":
        o = F.col(c) - F.col(f"_{c}0")
        steps = F.ceil((F.col(f"_{c}1") - F.col(f"_{c}0")) / stride)
        first = F.greatest(F.lit(0), F.floor((o - size) / stride) + 1)
        last = F.least(F.floor(o / stride), steps - 1)
        # One more on the lower side, as divisions may round; what doesn't hold the point is then filtered.
        at = at.withColumn(f"p{c}", F.explode(F.sequence((first - 1).cast("long"), F.greatest(last, first).cast("long"))))
        i = F.col(f"p{c}")
        at = at.where((i >= 0) & (i < steps) & (o >= i * stride) & (o < i * stride + size))
    at = cut(at)
    counts = at.groupBy(group, "px", "py").agg(F.count(F.lit(1)).alias("patch_points")).where(F.col("patch_points") >= least)
    out = at.join(counts, [group, "px", "py"])
    return out.withColumns({f"local_{c}": F.col(c) - (F.col(f"_{c}0") + F.col(f"p{c}") * stride + size / 2) for c in "xy"}).drop("_x0", "_x1", "_y0", "_y1")


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, *columns: str) -> Column:
    """A standard normal number of the same kind (Box-Muller)."""
    u, v = uniform(seed, *columns), uniform(seed + 7919, *columns)
    return F.sqrt(F.log(1 - u) * -2) * F.cos(v * (2 * math.pi))


def augment(patches: DataFrame, versions: int, keys: list[str], seed: int = 7, jitter: float = 0.05, scale: float = 0.05, drop: float = 0.1) -> DataFrame:
    """The patches and ``versions`` changed copies of each (``version`` 0 is the original): turned about the vertical, scaled,
    jittered, and thinned by up to ``drop``. A copy's turn and scale are those of its patch. Normals, where there are
    ``nx, ny``, are turned along.
    """
    v = patches.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(versions))))
    of = [*keys, "version"]
    changed = F.col("version") > 0
    angle, s = uniform(seed, *of) * (2 * math.pi), 1 + (uniform(seed + 1, *of) * 2 - 1) * scale
    noise = [normal(seed + 2 + i, "point_id", *of) * jitter for i in range(3)]
    v = v.where(~changed | (uniform(seed + 5, "point_id", *of) >= uniform(seed + 6, *of) * drop)).withColumns({"_a": F.when(changed, angle).otherwise(0.0), "_s": F.when(changed, s).otherwise(1.0)})
    x, y = F.col("local_x"), F.col("local_y")
    cos, sin = F.cos("_a"), F.sin("_a")
    out = {"local_x": (x * cos - y * sin) * F.col("_s"), "local_y": (x * sin + y * cos) * F.col("_s"), "z": F.col("z") * F.col("_s")}
    out = {c: F.when(changed, e + n).otherwise(F.col(c)) for (c, e), n in zip(out.items(), noise)}
    if {"nx", "ny"} <= set(patches.columns):
        out |= {"nx": F.col("nx") * cos - F.col("ny") * sin, "ny": F.col("nx") * sin + F.col("ny") * cos}
    return v.withColumns(out).drop("_a", "_s")


def resample(patches: DataFrame, keys: list[str], target: int, seed: int = 7) -> DataFrame:
    """Exactly ``target`` rows a patch: a hash-ordered choice of larger ones, rows of smaller ones repeated in turn (``copy``).

    Ranks come from hash parts, so a patch that holds most rows is not one task.
    """
    h = F.xxhash64(F.lit(seed), "point_id", *keys)
    at = ranked(patches.withColumn("_h", h), keys, [F.col("_h"), F.col("point_id")], F.pmod(F.col("_h"), F.lit(partitions(patches.sparkSession))), "_rank")
    n = patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = at.join(n, keys)
    copies = F.when(F.col("_rank") < target % F.col("_n"), F.floor(F.lit(target) / F.col("_n")) + 1).otherwise(F.floor(F.lit(target) / F.col("_n")))
    copies = F.when(F.col("_n") >= target, F.when(F.col("_rank") < target, 1).otherwise(0)).otherwise(copies).cast("int")
    return at.withColumn("_c", copies).where("_c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_h", "_rank", "_n", "_c")


def md5_split(name: Column, seed: int, shares: list[tuple[str, float]]) -> Column:
    """A split by the md5 of ``<name>_<seed>`` modulo a million: the same for a name wherever it is computed.

    The 128-bit remainder is folded from four 32-bit parts, as (a * 2^32 + b) mod m needs no more than 53 bits.
    """
    digest = F.md5(F.concat(name, F.lit(f"_{seed}")))
    rest = F.lit(0).cast("long")
    for i in range(4):
        rest = (rest * ((1 << 32) % 1_000_000) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % 1_000_000
    ratio = rest / 1_000_000.0
    out, edge = F.lit(shares[-1][0]), 1.0
    for split, share in reversed(shares[:-1]):
        edge = sum(s for n, s in shares[: [n for n, _ in shares].index(split) + 1])
        out = F.when(ratio < edge, split).otherwise(out)
    return out


def batches(items: DataFrame, size: str, key: str, limit: float) -> DataFrame:
    """``batch``: items in order of key are put into batches by the running sum of size over ``limit``, within hash parts.

    A batch starts where the running sum passes a multiple of the limit, so no batch exceeds it by more than one item.
    """
    part = F.pmod(F.xxhash64(key), F.lit(partitions(items.sparkSession)))
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    at = items.withColumn("_part", part).withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return at.withColumn("batch", F.concat_ws("-", "_part", F.floor(F.col("_before") / limit))).drop("_part", "_before")


def fill_ground(points: DataFrame, spacing: float, apart: float, tile: str = "tile", ground: int = 2) -> DataFrame:
    """Synthetic ground points on a grid where no ground point is within ``apart``, at the height of the ground around.

    The grid covers each tile's extent; a node's height is the mean of the ground points of the 3 x 3 cells of 10 m around
    it, and nodes without any get no point. Columns ``tile, x, y, z, synthetic``.
    """
    g = points.where(F.col("classification") == ground).select("x", "y", "z")
    span = points.groupBy(tile).agg(*[f(F.floor(F.col(c) / spacing)).cast("long").alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    nodes = span.withColumn("i", F.explode(F.sequence("x0", "x1"))).withColumn("j", F.explode(F.sequence("y0", "y1"))).select(tile, (F.col("i") * spacing).alias("x"), (F.col("j") * spacing).alias("y"))
    wide = g.groupBy(F.floor(F.col("x") / 10).cast("long").alias("cx"), F.floor(F.col("y") / 10).cast("long").alias("cy")).agg(F.sum(F.round(F.col("z") * 10**6).cast("long")).alias("s"), F.count("z").alias("n"))
    for c in ("cx", "cy"):
        wide = wide.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    wide = wide.groupBy("cx", "cy").agg((F.sum("s").cast("double") / F.sum("n") / 10**6).alias("z"))  # whole micrometres: no order of rows changes a mean
    placed = nodes.withColumns({"cx": F.floor(F.col("x") / 10).cast("long"), "cy": F.floor(F.col("y") / 10).cast("long")}).join(wide, ["cx", "cy"]).drop("cx", "cy")
    cell = {f"k{c}": F.floor(F.col(c) / apart).cast("long") for c in "xy"}
    close = g.select(F.col("x").alias("gx"), F.col("y").alias("gy"), *[F.floor(F.col(c) / apart).cast("long").alias(f"k{c}") for c in "xy"])
    for c in "xy":
        close = close.withColumn(f"k{c}", F.explode(F.sequence(F.col(f"k{c}") - 1, F.col(f"k{c}") + 1)))
    dx, dy = F.col("x") - F.col("gx"), F.col("y") - F.col("gy")
    hit = placed.withColumns(cell).join(close, ["kx", "ky"]).where(dx * dx + dy * dy <= apart * apart).select(tile, "x", "y").distinct()
    return placed.join(hit, [tile, "x", "y"], "left_anti").select(tile, "x", "y", "z", F.lit(True).alias("synthetic"))
