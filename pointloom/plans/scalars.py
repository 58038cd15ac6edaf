"""Queries of the scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import shape, signal
from pointloom.functions.confidence import combine, confidence
from pointloom.operators.frames import current_features, with_group, with_total
from pointloom.plans.base import b, bands, f, features, p, points
from pointloom.runtime import table


def _eigen(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    """Three values per point, largest first, that stand for eigenvalues."""
    c = [F.col(x) for x in ("planarity", "linearity", "sphericity")]
    l1, l3 = F.greatest(*c), F.least(*c)
    df = features(spark, d, "planarity", "linearity", "sphericity", "nz").withColumns({"l1": l1, "l2": c[0] + c[1] + c[2] - l1 - l3, "l3": l3})
    return df, [F.col(x) for x in ("l1", "l2", "l3")]


def eigen_features(spark, d):
    df, e = _eigen(spark, d)
    return df.select("point_id", *[c.alias(n) for n, c in shape.eigen_features(*e).items()])


def curvature_features(spark, d):
    df, e = _eigen(spark, d)
    return df.select("point_id", *[c.alias(n) for n, c in shape.curvature_features(*e).items()])


def architectural_features(spark, d):
    df, e = _eigen(spark, d)
    df = with_group(df, ["tile"], {"z0": F.min("z"), "z1": F.max("z")})
    nz, plan = shape.clip(F.col("nz"), -1, 1), F.col("planarity")
    return df.select(
        "point_id", shape.verticality(nz).alias("verticality"), shape.horizontality(nz).alias("horizontality"), shape.wall_likelihood(nz, plan).alias("wall"), shape.roof_likelihood(nz, plan).alias("roof"),
        shape.facade_score(nz, F.col("z"), F.col("z0"), F.col("z1")).alias("facade"), shape.building_regularity(*e).alias("regularity"), shape.linearity(*e).alias("corner"),
    )


def normal_angles(spark, d):
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    unit = shape.normalize(n)
    up = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return features(spark, d, "nx", "ny", "nz").select("point_id", *[c.alias(f"u{a}") for a, c in zip("xyz", unit)], shape.angle_between(n, up).alias("slope"), shape.safe_divide(F.col("nx"), F.abs("nz")).alias("ratio"))


def height_above_ground(spark, d):
    lowest = F.coalesce(F.min(F.when(F.col("classification") == 2, F.col("z"))), F.min("z"))
    df = with_group(points(spark, d), ["tile"], {"ground": lowest})
    df = df.withColumn("height", F.greatest(F.col("z") - F.col("ground"), F.lit(0.0)))
    df = with_group(df.select("point_id", "tile", "height", "z", "ground"), ["tile"], {"top": F.max("height")})
    share = F.when(F.col("top") > 0, shape.clip(F.try_divide("height", "top"), 0, 1)).otherwise(0.0)
    return df.select("point_id", "height", (F.col("z") - F.col("ground")).alias("relative"), share.alias("normalized"), F.when(F.col("top") > 0, F.greatest(F.lit(0), F.least(F.lit(9), F.floor(F.try_divide(F.col("height") * 10, F.col("top")))))).otherwise(0).cast("int").alias("bin"))


def ground_flags(spark, d):
    is_ground = (F.col("classification") == 2).cast("int")
    return points(spark, d).select("point_id", F.coalesce(is_ground, F.lit(0)).alias("is_ground"), F.coalesce(F.when(F.col("return_number") == 1, is_ground), F.lit(0)).alias("is_first_ground"))


def rgb_features(spark, d):
    r, g, bl = (F.col(c) for c in ("red", "green", "blue"))
    return bands(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in signal.rgb_features(r, g, bl).items()])


def spectral_features(spark, d):
    cs = [F.col(c) for c in ("red", "green", "blue", "nir")]
    return bands(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in signal.spectral_features(*cs).items()], signal.to_uint8(cs[2]).alias("blue8"), signal.to_float(signal.to_uint8(cs[2])).alias("blue_back"))


def standardized(spark, d):
    df = features(spark, d, "height", "curvature").select("point_id", "height", "curvature")
    df = with_total(df, {"m": F.avg("height"), "s": F.stddev_pop("height"), "lo": F.min("curvature"), "hi": F.max("curvature")})
    z = (F.col("height") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return df.select("point_id", z.alias("z_height"), F.coalesce(F.try_divide(F.col("curvature") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("minmax_curvature"))


def validated_features(spark, d):
    """Repairs of three columns over all features, bad numbers included (NULL stays)."""
    df = current_features(table(spark, d, "point_features")).select("point_id", "planarity", "roughness", "height")
    ranges = {"planarity": (0, 1), "roughness": (0, 1), "height": (-5, 60)}
    fixed = df.withColumns({f"r_{c}": signal.repaired_range(F.col(c), *r) for c, r in ranges.items()})
    stats = with_total(fixed, {**{f"m_{c}": F.avg(f"r_{c}") for c in ranges}, **{f"s_{c}": F.stddev_pop(f"r_{c}") for c in ranges}})
    return stats.select("point_id", *[signal.validated(F.col(c), *r, F.col(f"m_{c}"), F.col(f"s_{c}")).alias(c) for c, r in ranges.items()], signal.fill_bad(F.col("height")).alias("filled_height"))


def confidences(spark, d):
    df = features(spark, d, "planarity", "curvature", "roughness").select("point_id", "planarity", "curvature", "roughness")
    s = F.col("planarity")
    parts = {"a": F.col("planarity"), "b": 1 - F.col("curvature"), "c": 1 - F.col("roughness")}
    w = {"a": 2.0, "b": 1.0, "c": 1.0}
    return df.select("point_id", *[confidence(s, m, 0.2, 0.9).alias(f"c_{m}") for m in ("binary", "linear", "sigmoid", "gaussian", "threshold", "exponential")], *[combine(parts, m, w).alias(f"k_{m}") for m in ("weighted", "max", "min", "product", "geometric", "harmonic")])


def morton_keys(spark, d):
    df = points(spark, d).withColumns({f"c{c}": F.pmod(F.floor(F.col(c)), F.lit(1024)).cast("long") for c in "xyz"})
    return df.select("point_id", signal.morton(F.col("cx"), F.col("cy"), F.col("cz")).alias("morton"))


QUERIES = {
    "eigen_features": eigen_features, "curvature_features": curvature_features, "architectural_features": architectural_features, "normal_angles": normal_angles, "height_above_ground": height_above_ground,
    "ground_flags": ground_flags, "rgb_features": rgb_features, "spectral_features": spectral_features, "standardized": standardized, "validated_features": validated_features, "confidences": confidences, "morton_keys": morton_keys,
}

_LPS = "planarity linearity sphericity nz"
_E = ", E AS (SELECT *, greatest(planarity, linearity, sphericity) AS l1, planarity + linearity + sphericity - greatest(planarity, linearity, sphericity) - least(planarity, linearity, sphericity) AS l2, least(planarity, linearity, sphericity) AS l3 FROM F)"
_01 = lambda e: f"greatest(0, least(1, {e}))"
_B = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_SHARES = [f"({c}) / (l1 + l2 + l3 + 1e-10)" for c in ("l1", "l2", "l3")]
_VALID = """greatest({lo}, least({hi}, greatest(greatest({lo}, CASE WHEN s_{c} > 1e-8 THEN m_{c} - 5 * s_{c} ELSE {lo} END), least(least({hi}, CASE WHEN s_{c} > 1e-8 THEN m_{c} + 5 * s_{c} ELSE {hi} END), r_{c})))) AS {c}"""
_RANGES = {"planarity": (0.0, 1.0), "roughness": (0.0, 1.0), "height": (-5.0, 60.0)}
_NORM = "sqrt(nx * nx + ny * ny + nz * nz)"
SQL = {
    "eigen_features": f(
        f"""SELECT point_id, {_01('(greatest(l1, 1e-6) - l2) / greatest(l1, 1e-6)')} AS linearity, {_01('(l2 - l3) / greatest(l1, 1e-6)')} AS planarity, {_01('l3 / greatest(l1, 1e-6)')} AS sphericity,
        {_01('(greatest(l1, 1e-6) - l3) / greatest(l1, 1e-6)')} AS anisotropy, cbrt(l1 * l2 * l3 + 1e-10) AS omnivariance, -({' + '.join(f'{x} * ln({x} + 1e-10)' for x in _SHARES)}) AS eigenentropy,
        l3 / (l1 + l2 + l3 + 2e-6) AS change_of_curvature, {_01('1 - abs(l3) / greatest(l1, 1e-6)')} AS eigen_verticality, l1 + l2 + l3 AS sum_eigenvalues FROM E""", _E, _LPS),
    "curvature_features": f(
        f"""SELECT point_id, l3 / (l1 + l2 + l3 + 1e-10) AS curvature_standard, l3 / (l1 + 1e-10) AS curvature_normalized, l2 * l3 / (l1 * l1 + 1e-10) AS curvature_gaussian, (l2 + l3) / (l1 + 1e-10) AS mean_curvature,
        {2 / math.pi} * atan2((l2 + l3) / (l1 + 1e-10), l2 / (l1 + 1e-10) - l3 / (l1 + 1e-10) + 1e-10) AS shape_index, sqrt((l2 * l2 + l3 * l3) / (2 * (l1 + 1e-10) * (l1 + 1e-10))) AS curvedness FROM E""", _E, _LPS),
    "architectural_features": f(
        f"""SELECT point_id, 1 - abs(n) AS verticality, abs(n) AS horizontality, {_01('sqrt((1 - abs(n)) * planarity)')} AS wall, {_01('sqrt(abs(n) * planarity)')} AS roof,
        (1 - abs(n)) * {_01('2 * (z - z0) / (z1 - z0 + 1e-10)')} AS facade, {_01('(l2 - l3) / greatest(l1, 1e-10)')} * (1 - l3 / (l1 + 1e-10)) AS regularity, {_01('(greatest(l1, 1e-6) - l2) / greatest(l1, 1e-6)')} AS corner
        FROM (SELECT *, greatest(-1, least(1, nz)) AS n, min(z) OVER (PARTITION BY tile) AS z0, max(z) OVER (PARTITION BY tile) AS z1 FROM E)""", _E, _LPS),
    "normal_angles": f(
        f"""SELECT point_id, nx / ({_NORM} + 1e-10) AS ux, ny / ({_NORM} + 1e-10) AS uy, nz / ({_NORM} + 1e-10) AS uz, CASE WHEN {_NORM} > 0 THEN acos(greatest(-1, least(1, nz / {_NORM}))) END AS slope, nx / (abs(nz) + 1e-10) AS ratio FROM F""", read="nx ny nz"),
    "height_above_ground": p(
        """SELECT point_id, height, z - ground AS relative, CASE WHEN top > 0 THEN least(1, height / top) ELSE 0 END AS normalized, CASE WHEN top > 0 THEN least(9, floor(height * 10 / top)) ELSE 0 END::INT AS bin
        FROM (SELECT *, max(height) OVER (PARTITION BY tile) AS top FROM (SELECT *, greatest(z - ground, 0) AS height FROM (
        SELECT *, coalesce(min(z) FILTER (classification = 2) OVER (PARTITION BY tile), min(z) OVER (PARTITION BY tile)) AS ground FROM P)))"""),
    "ground_flags": p("SELECT point_id, coalesce((classification = 2)::INT, 0) AS is_ground, coalesce((classification = 2 AND return_number = 1)::INT, 0) AS is_first_ground FROM P"),
    "rgb_features": b(
        f"""SELECT {_B}, (red + green + blue) / 3 AS rgb_mean, sqrt((pow(red - (red + green + blue) / 3, 2) + pow(green - (red + green + blue) / 3, 2) + pow(blue - (red + green + blue) / 3, 2)) / 3) AS rgb_std,
        greatest(red, green, blue) - least(red, green, blue) AS rgb_range, 2 * green - red - blue AS excess_green, (green - red) / (green + red + 1e-8) AS vegetation_index FROM B"""),
    "spectral_features": b(
        f"""SELECT {_B}, (nir - red) / (nir + red + 1e-8) AS ndvi, (red + green + blue) / 3 AS brightness, nir / (red + 1e-8) AS nir_red_ratio, nir / (green + 1e-8) AS nir_green_ratio, red / (green + 1e-8) AS red_green_ratio,
        blue / (green + 1e-8) AS blue_green_ratio, (greatest(red, green, blue) - least(red, green, blue)) / (greatest(red, green, blue) + 1e-8) AS saturation,
        trunc(greatest(0, least(255, blue * 255)))::INT AS blue8, trunc(greatest(0, least(255, blue * 255)))::INT / 255.0::DOUBLE AS blue_back FROM B"""),
    "standardized": f(
        """SELECT point_id, (height - avg(height) OVER ()) / (CASE WHEN stddev_pop(height) OVER () = 0 THEN 1 ELSE stddev_pop(height) OVER () END) AS z_height,
        coalesce((curvature - min(curvature) OVER ()) / nullif(max(curvature) OVER () - min(curvature) OVER (), 0), 0) AS minmax_curvature FROM F""", read="height curvature"),
    "validated_features": f"""WITH L AS (SELECT * FROM point_features WHERE point_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY enriched_at DESC NULLS LAST) = 1),
        R AS (SELECT point_id, height::DOUBLE AS raw, {', '.join(f"CASE WHEN isnan({c}) OR {c} = '-inf' THEN {lo} WHEN {c} = 'inf' THEN {hi} ELSE {c}::DOUBLE END AS r_{c}" for c, (lo, hi) in _RANGES.items())} FROM L),
        S AS (SELECT {', '.join(f'avg(r_{c}) AS m_{c}, stddev_pop(r_{c}) AS s_{c}' for c in _RANGES)} FROM R)
        SELECT point_id, {', '.join(f'CASE WHEN r_{c} IS NOT NULL THEN ' + _VALID.format(c=c, lo=lo, hi=hi).replace(f' AS {c}', f' END AS {c}') for c, (lo, hi) in _RANGES.items())},
        CASE WHEN raw IS NULL THEN NULL WHEN isfinite(raw) THEN raw ELSE 0 END AS filled_height FROM R, S""",
    "confidences": f(
        f"""SELECT point_id, CASE WHEN planarity >= 0.5 THEN 1.0 ELSE 0.0 END AS c_binary, {_01('(planarity - 0.2) / (0.9 - 0.2)')} AS c_linear, 1 / (1 + exp(-10 * (planarity - 0.5))) AS c_sigmoid,
        exp(-pow(planarity - 0.5, 2) / (2 * 0.2 * 0.2)) AS c_gaussian, CASE WHEN planarity < 0.5 - 0.1 THEN 0 WHEN planarity > 0.5 + 0.1 THEN 1 ELSE (planarity - 0.4) / 0.2 END AS c_threshold, {_01('exp(-planarity)')} AS c_exponential,
        planarity * 0.5 + b * 0.25 + c * 0.25 AS k_weighted, greatest(planarity, b, c) AS k_max, least(planarity, b, c) AS k_min, planarity * b * c AS k_product,
        pow(greatest(planarity, 1e-10), 0.5) * pow(greatest(b, 1e-10), 0.25) * pow(greatest(c, 1e-10), 0.25) AS k_geometric, 1 / (0.5 / greatest(planarity, 1e-10) + 0.25 / greatest(b, 1e-10) + 0.25 / greatest(c, 1e-10)) AS k_harmonic
        FROM (SELECT *, 1 - curvature AS b, 1 - roughness AS c FROM F)""", read="planarity curvature roughness"),
    "morton_keys": p(
        "SELECT point_id, (" + " + ".join(f"(((c{c} >> {i}) & 1) << {3 * i + j})" for i in range(10) for j, c in enumerate("xyz")) + """)::BIGINT AS morton
        FROM (SELECT point_id, (floor(x)::BIGINT % 1024 + 1024) % 1024 AS cx, (floor(y)::BIGINT % 1024 + 1024) % 1024 AS cy, (floor(z)::BIGINT % 1024 + 1024) % 1024 AS cz FROM P)"""),
}
