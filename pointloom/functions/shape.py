"""Scalar shape measures of a neighbourhood, as column expressions that stay in generated code.

Eigenvalues are given as three columns, largest first. NULL in any argument gives NULL; NaN stays NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` within [low, high]; NULL and NaN stay."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def safe_divide(n: Column, d: Column, eps: float = 1e-10) -> Column:
    """n / (d + eps): the offset is added, so d = -eps is an error as any division by zero."""
    return n / (d + eps)


def _share(n: Column, l1: Column, eps: float) -> Column:
    return clip(n / F.greatest(l1, F.lit(eps)), 0, 1)


def linearity(l1: Column, l2: Column, l3: Column, eps: float = 1e-6) -> Column:
    return _share(F.greatest(l1, F.lit(eps)) - l2, l1, eps)


def planarity(l1: Column, l2: Column, l3: Column, eps: float = 1e-6) -> Column:
    return _share(l2 - l3, l1, eps)


def sphericity(l1: Column, l2: Column, l3: Column, eps: float = 1e-6) -> Column:
    return _share(l3, l1, eps)


def anisotropy(l1: Column, l2: Column, l3: Column, eps: float = 1e-6) -> Column:
    return _share(F.greatest(l1, F.lit(eps)) - l3, l1, eps)


def eigen_verticality(l1: Column, l2: Column, l3: Column, eps: float = 1e-6) -> Column:
    return clip(1 - F.abs(l3) / F.greatest(l1, F.lit(eps)), 0, 1)


def omnivariance(l1: Column, l2: Column, l3: Column, eps: float = 1e-10) -> Column:
    return F.cbrt(l1 * l2 * l3 + eps)


def eigenentropy(l1: Column, l2: Column, l3: Column, eps: float = 1e-10) -> Column:
    total = l1 + l2 + l3 + eps
    return -sum(((x / total) * F.log(x / total + eps) for x in (l2, l3)), (l1 / total) * F.log(l1 / total + eps))


def change_of_curvature(l1: Column, l2: Column, l3: Column, eps: float = 1e-6) -> Column:
    return l3 / (l1 + l2 + l3 + 2 * eps)


def curvature(l1: Column, l2: Column, l3: Column, method: str = "standard", eps: float = 1e-10) -> Column:
    """Surface variation (standard), by the largest value (normalized) or a product (gaussian)."""
    forms = {"standard": lambda: l3 / (l1 + l2 + l3 + eps), "normalized": lambda: l3 / (l1 + eps), "gaussian": lambda: l2 * l3 / (l1 * l1 + eps)}
    if method not in forms:
        raise ValueError(f"unknown curvature method: {method}")
    return forms[method]()


def mean_curvature(l1: Column, l2: Column, l3: Column, eps: float = 1e-10) -> Column:
    return (l2 + l3) / (l1 + eps)


def shape_index(l1: Column, l2: Column, l3: Column, eps: float = 1e-10) -> Column:
    a, b = l2 / (l1 + eps), l3 / (l1 + eps)
    return F.atan2(a + b, a - b + eps) * (2 / math.pi)


def curvedness(l1: Column, l2: Column, l3: Column, eps: float = 1e-10) -> Column:
    a, b = l2 / (l1 + eps), l3 / (l1 + eps)
    return F.sqrt((a * a + b * b) / 2)


def eigen_features(l1: Column, l2: Column, l3: Column) -> dict[str, Column]:
    """All measures of one neighbourhood by name."""
    return {
        "linearity": linearity(l1, l2, l3), "planarity": planarity(l1, l2, l3), "sphericity": sphericity(l1, l2, l3), "anisotropy": anisotropy(l1, l2, l3),
        "omnivariance": omnivariance(l1, l2, l3), "eigenentropy": eigenentropy(l1, l2, l3), "change_of_curvature": change_of_curvature(l1, l2, l3),
        "eigen_verticality": eigen_verticality(l1, l2, l3), "sum_eigenvalues": l1 + l2 + l3,
    }


def curvature_features(l1: Column, l2: Column, l3: Column) -> dict[str, Column]:
    return {
        "curvature_standard": curvature(l1, l2, l3), "curvature_normalized": curvature(l1, l2, l3, "normalized"), "curvature_gaussian": curvature(l1, l2, l3, "gaussian"),
        "mean_curvature": mean_curvature(l1, l2, l3), "shape_index": shape_index(l1, l2, l3), "curvedness": curvedness(l1, l2, l3),
    }


def verticality(nz: Column) -> Column:
    return 1 - F.abs(nz)


def horizontality(nz: Column) -> Column:
    return F.abs(nz)


def wall_likelihood(nz: Column, planar: Column) -> Column:
    return clip(F.sqrt(verticality(nz) * planar), 0, 1)


def roof_likelihood(nz: Column, planar: Column) -> Column:
    return clip(F.sqrt(horizontality(nz) * planar), 0, 1)


def facade_score(nz: Column, z: Column, z_min: Column, z_max: Column) -> Column:
    return verticality(nz) * clip((z - z_min) / (z_max - z_min + 1e-10) * 2, 0, 1)


def building_regularity(l1: Column, l2: Column, l3: Column, eps: float = 1e-10) -> Column:
    return planarity(l1, l2, l3, eps) * (1 - l3 / (l1 + eps))


def angle_between(a: list[Column], b: list[Column]) -> Column:
    """The angle of two vectors in radians; NULL where one has no length."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    la, lb = norm(a), norm(b)
    return F.when((la > 0) & (lb > 0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (la * lb)))))


def norm(v: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def normalize(v: list[Column], eps: float = 1e-10) -> list[Column]:
    """The vector over its length plus eps; a zero vector stays zero."""
    return [x / (norm(v) + eps) for x in v]


def eigenvalues_3x3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3x3 matrix, largest first, in closed form (trigonometric), never below 0.

    One array expression holds all intermediate values, so each is computed once.
    """
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + (xy * xy + xz * xz + yz * yz) * 2
    p = F.sqrt(p2 / 6)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    half = F.when(p > 0, det / (p * p * p * 2)).otherwise(0.0)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    l1 = q + p * 2 * F.cos(phi)
    l3 = q + p * 2 * F.cos(phi + 2 * math.pi / 3)
    return [F.greatest(x, F.lit(0.0)) for x in (l1, q * 3 - l1 - l3, l3)]
