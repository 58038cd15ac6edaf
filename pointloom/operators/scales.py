"""Measures at several scales and their combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_radii(neighbours: DataFrame, value: str, radii: list[float]) -> DataFrame:
    """``point_id`` and per radius the count, mean and population variance of a neighbour's value, all in one aggregation.

    neighbours  ``point_id, d`` and the value; those up to the greatest radius.
    """
    out = []
    for i, r in enumerate(radii):
        v = F.when(F.col("d") <= r, F.col(value))
        out += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.var_pop(v).alias(f"var{i}")]
    return neighbours.groupBy("point_id").agg(*out)


def _weighted(values: list[Column], weights: list[Column]) -> Column:
    """The weighted mean of the values that are there; NULL where none is."""
    there = [v.isNotNull() & w.isNotNull() for v, w in zip(values, weights)]
    total = reduce(lambda a, b: a + b, [F.when(t, w).otherwise(0.0) for t, w in zip(there, weights)])
    return F.try_divide(reduce(lambda a, b: a + b, [F.when(t, v * w).otherwise(0.0) for t, v, w in zip(there, values, weights)]), total)


def variance_weighted(values: list[Column], variances: list[Column], weights: list[float], penalty: float = 1.0) -> Column:
    """Each scale weighs its weight over 1 + penalty x its variance."""
    return _weighted(values, [F.lit(w) / (1 + var * penalty) for w, var in zip(weights, variances)])


def plain_weighted(values: list[Column], weights: list[float]) -> Column:
    return _weighted(values, [F.lit(float(w)) for w in weights])


def adaptive(values: list[Column], complexity: Column) -> Column:
    """The finer the scale, the more it weighs where complexity (0..1) is high, and the other way round."""
    m = max(len(values) - 1, 1)
    return _weighted(values, [F.exp(-F.abs(1 - complexity - i / m) * 2) for i in range(len(values))])


def disagree(values: list[Column], limit: float) -> Column:
    """Whether the population variance over the scales that are there exceeds the limit."""
    a = F.array_compact(F.array(*values))
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
    return F.coalesce(F.when(n > 1, var > limit), F.lit(False))
