"""Ranks and running sums over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], order: list[Column], part: Column, rank: str = "rank0") -> DataFrame:
    """Add ``rank bigint``, the 0-based place of each row in its group: parts in ascending order, then ``order`` in a part.

    ``part`` splits each group into parts small enough for one task (a hash bucket, a range). Rows are ranked within
    (group, part); a table of part sizes is prefix-summed per group and joined back on the same keys, so ``df`` is
    shuffled once. NULLs group together. ``order`` should be total, else ties are ranked in any order.
    """
    keyed = df.withColumn("_part", part)
    keys = [*group, "_part"]
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = keyed.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sizes = sizes.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    out = within.join(sizes, same)
    return out.withColumn(rank, F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before", *[f"_k{i}" for i in range(len(keys))])
