"""Confidence of a score and combinations of confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.shape import clip


def confidence(score: Column, method: str, low: Column | float = 0.0, high: Column | float = 1.0, **p) -> Column:
    """The confidence of a score by method: binary, linear (between low and high), sigmoid, gaussian, threshold, exponential."""
    if method == "binary":
        return F.when(score >= p.get("threshold", 0.5), 1.0).otherwise(0.0)
    if method == "linear":
        low, high = (F.lit(x) if not isinstance(x, Column) else x for x in (low, high))
        return F.when(high <= low, F.lit(1.0)).otherwise(clip(F.try_divide(score - low, high - low), 0, 1))
    if method == "sigmoid":
        return 1 / (1 + F.exp((score - p.get("center", 0.5)) * -p.get("steepness", 10.0)))
    if method == "gaussian":
        d, s = score - p.get("center", 0.5), p.get("sigma", 0.2)
        return F.exp(-(d * d) / (2 * s * s))
    if method == "threshold":
        t, m = p.get("threshold", 0.5), p.get("soft_margin", 0.1)
        return F.when(score < t - m, 0.0).when(score > t + m, 1.0).otherwise((score - (t - m)) / (2 * m))
    if method == "exponential":
        e = F.exp(score * -p.get("rate", 1.0))
        return clip(e if p.get("decay", True) else 1 - e, 0, 1)
    raise ValueError(f"unknown confidence method: {method}")


def combine(parts: dict[str, Column], method: str, weights: dict[str, float] | None = None) -> Column:
    """Combined confidences: weighted, max, min, product, geometric, harmonic; weights are normalised by their sum."""
    if not parts:
        raise ValueError("nothing to combine")
    weights = weights or dict.fromkeys(parts, 1.0)
    total = sum(weights.values())
    if not total:
        raise ValueError("the weights sum to zero")
    w = {n: weights.get(n, 0.0) / total for n in parts}
    columns = list(parts.values())
    safe = {n: F.greatest(c, F.lit(1e-10)) for n, c in parts.items()}
    if method == "weighted":
        return reduce(lambda a, b: a + b, [c * w[n] for n, c in parts.items()])
    if method in ("max", "min"):
        return columns[0] if len(columns) == 1 else (F.greatest if method == "max" else F.least)(*columns)
    if method == "product":
        return reduce(lambda a, b: a * b, columns)
    if method == "geometric":
        return reduce(lambda a, b: a * b, [F.pow(c, F.lit(w[n])) for n, c in safe.items()])
    if method == "harmonic":
        return 1 / reduce(lambda a, b: a + b, [F.lit(w[n]) / c for n, c in safe.items()])
    raise ValueError(f"unknown combination method: {method}")
