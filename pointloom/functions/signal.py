"""Height, colour and range functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.shape import clip

INF = float("inf")


def is_bad(c: Column) -> Column:
    """NaN or infinite (NULL is absent, not bad)."""
    return F.isnan(c) | (F.abs(c) == INF)


def fill_bad(c: Column, value: float = 0.0) -> Column:
    """NaN and infinities replaced; NULL stays."""
    return F.when(is_bad(c), F.lit(float(value))).otherwise(c)


def digitize(c: Column, top: Column, bins: int) -> Column:
    """The bin of ``c`` among equal bins of [0, top], clipped to 0 .. bins - 1; 0 where top is 0."""
    raw = F.when(top > 0, F.floor(c * bins / top)).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)).cast("int")


def ndvi(nir: Column, red: Column) -> Column:
    """(nir - red) / (nir + red + 1e-8), NaN as 0."""
    return F.nanvl((nir - red) / (nir + red + 1e-8), F.lit(0.0))


def rgb_features(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Mean, population deviation, range, excess green and green-red index of three values in 0..1."""
    mean = (r + g + b) / 3
    spread = F.sqrt(((r - mean) * (r - mean) + (g - mean) * (g - mean) + (b - mean) * (b - mean)) / 3)
    return {
        "rgb_mean": mean, "rgb_std": spread, "rgb_range": F.greatest(r, g, b) - F.least(r, g, b), "excess_green": g * 2 - r - b, "vegetation_index": F.nanvl((g - r) / (g + r + 1e-8), F.lit(0.0)),
    }


def spectral_features(r: Column, g: Column, b: Column, nir: Column) -> dict[str, Column]:
    """Ratios of the bands, brightness and saturation."""
    top, low, e = F.greatest(r, g, b), F.least(r, g, b), 1e-8
    return {
        "ndvi": (nir - r) / (nir + r + e), "brightness": (r + g + b) / 3, "nir_red_ratio": nir / (r + e), "nir_green_ratio": nir / (g + e), "red_green_ratio": r / (g + e),
        "blue_green_ratio": b / (g + e), "saturation": (top - low) / (top + e),
    }


def to_float(c: Column) -> Column:
    """0..255 to 0..1."""
    return c / 255.0


def to_uint8(c: Column) -> Column:
    """0..1 to 0..255, clipped, fractions cut off."""
    return clip(c * 255.0, 0, 255).cast("int")


def validated(c: Column, low: float, high: float, mean: Column, std: Column, sigma: float = 5.0) -> Column:
    """NaN and -Inf to low, +Inf to high, then within sigma deviations of the mean and within [low, high].

    ``mean`` and ``std`` are those of the column after the first step. NULL stays NULL.
    """
    a = F.greatest(F.lit(float(low)), F.when(std > 1e-8, mean - std * sigma).otherwise(F.lit(float(low))))
    b = F.least(F.lit(float(high)), F.when(std > 1e-8, mean + std * sigma).otherwise(F.lit(float(high))))
    repaired = repaired_range(c, low, high)
    inner = F.greatest(a, F.least(b, repaired))
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), inner)))


def repaired_range(c: Column, low: float, high: float) -> Column:
    return F.when(F.isnan(c) | (c == -INF), F.lit(float(low))).when(c == INF, F.lit(float(high))).otherwise(c)


def morton(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """The Morton key of three cell numbers of ``bits`` bits: z, y and x bits in turn, x lowest."""
    key = F.lit(0).cast("long")
    for i in range(bits):
        for j, c in enumerate((x, y, z)):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 3 * i + j))
    return key
