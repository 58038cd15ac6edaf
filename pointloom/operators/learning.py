"""Votes, uncertainty and distribution distances over predicted probabilities and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy(p: list[Column]) -> Column:
    return -sum((x * F.log(x + 1e-10) for x in p[1:]), p[0] * F.log(p[0] + 1e-10))


def margin(p: list[Column]) -> Column:
    """1 minus the gap between the two greatest probabilities."""
    s = F.sort_array(F.array(*p), asc=False)
    return 1 - (s[0] - s[1])


def least_confidence(p: list[Column]) -> Column:
    return 1 - F.array_max(F.array(*p))


def top_uncertain(df: DataFrame, score: Column, n: int, key: str) -> DataFrame:
    """The n rows of the highest score (a report), ties by key: a partial top-n in each partition, then one of them."""
    return df.withColumn("score", score).orderBy(F.col("score").desc(), key).limit(n)


def vote(votes: DataFrame, key: str, label: str, weight: str | None = None) -> DataFrame:
    """Majority vote: the label with the greatest weight (ties: the lowest), its share, and the entropy of the vote."""
    w = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    by = votes.where(F.col(label).isNotNull()).groupBy(key, label).agg(w.alias("w"))
    g = by.groupBy(key).agg(F.max(F.struct("w", (-F.col(label)).alias("m"))).alias("b"), F.sum("w").alias("t"), F.sum(F.col("w") * F.log(F.col("w"))).alias("wl"))
    return g.select(key, (-F.col("b.m")).alias(label), F.try_divide("b.w", "t").alias("share"), (F.log("t") - F.try_divide("wl", "t")).alias("vote_entropy"))


def soft_vote(probabilities: list[list[Column]], weights: list[float]) -> list[Column]:
    """Weighted mean of each class's probability over models."""
    total = sum(weights)
    return [sum((m[c] * (w / total) for m, w in zip(probabilities[1:], weights[1:])), probabilities[0][c] * (weights[0] / total)) for c in range(len(probabilities[0]))]


def scatter(df: DataFrame, columns: list[str]) -> DataFrame:
    """The upper triangle of the covariance matrix as rows ``i, j, c``, in one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    aggregates = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.covar_samp(columns[i], columns[j]).alias("c")) for i, j in pairs]
    return df.agg(F.array(*aggregates).alias("a")).select(F.inline("a"))


def coral(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The squared Frobenius distance of two covariance matrices over 4 d^2, one row."""
    d = len(columns)
    both = scatter(a, columns).join(scatter(b, columns).withColumnRenamed("c", "c2"), ["i", "j"])
    gap = (F.col("c") - F.col("c2")) * (F.col("c") - F.col("c2")) * F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    return both.agg((F.sum(gap) / (4 * d * d)).alias("coral"))


def mean_discrepancy(a: DataFrame, b: DataFrame, columns: list[str], features: int = 256, sigma: float = 1.0, seed: int = 7) -> DataFrame:
    """The maximum mean discrepancy of an RBF kernel by random Fourier features: one aggregation over each table.

    The exact form sums over all pairs of rows; here each row is mapped to ``features`` cosines whose products approximate
    the kernel to within about 1 / sqrt(features), so the cost is linear in rows. One row ``mmd``.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    w, o = rng.normal(size=(features, len(columns))) / sigma, rng.uniform(0, 2 * math.pi, features)

    def means(df: DataFrame, name: str) -> DataFrame:
        v = F.array(*[F.col(c).cast("double") for c in columns])

        def partial(batches):
            import pyarrow as pa

            total, n = np.zeros(features), 0
            for batch in batches:
                x = np.asarray(batch.column("v").flatten(), float).reshape(-1, len(columns))
                total += np.cos(x @ w.T + o).sum(0)
                n += len(x)
            yield pa.RecordBatch.from_arrays([pa.array(range(features), pa.int32()), pa.array(total), pa.array([n] * features, pa.int64())], names=["f", "s", "n"])

        parts = df.select(v.alias("v")).mapInArrow(partial, "f int, s double, n long")
        return parts.groupBy("f").agg((F.sum("s") / F.sum("n") * math.sqrt(2 / features)).alias(name))

    gap = F.col("ma") - F.col("mb")
    return means(a, "ma").join(means(b, "mb"), "f").agg(F.sum(gap * gap).alias("mmd"))
