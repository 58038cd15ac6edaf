"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.runtime import cut, finite


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], step: float) -> DataFrame:
    """The keys, ``n`` and exact quantiles of ``value`` by name, with linear interpolation; no group is held in a task.

    Values are counted in cells of ``step`` (one pre-aggregated shuffle); running counts name the few cells that hold the
    wanted ranks; only values in these are counted one by one. ``step`` changes cost only. NULL, NaN and infinite values
    don't count, a group without any other is left out; NULL keys are a group. Empty table: no rows.
    """
    base = df.select(*keys, F.col(f"`{value}`").cast("double").alias("_v")).where(finite("_v")).withColumn("_b", F.floor(F.col("_v") / step).cast("long"))
    by = cut(base.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")))
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"_before": F.coalesce(F.sum("_c").over(run), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    wants = []
    for i, p in enumerate(probs.values()):
        rank = F.lit(p) * (F.col("_n") - 1)
        for upper, r in ((False, F.floor(rank)), (True, F.ceil(rank))):
            wants.append(F.struct(F.lit(i).alias("i"), F.lit(upper).alias("upper"), r.cast("long").alias("rank"), (rank - F.floor(rank)).alias("part")))
    held = F.filter(F.array(*wants), lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_c")))
    chosen = cut(by.withColumn("_w", held).where("size(_w) > 0").select(*[F.col(f"`{k}`").alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_b").alias("_kb"), "_before", "_n", "_w"))
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.col("_b") == F.col("_kb"))
    values = base.join(chosen.select(*[f"_k{j}" for j in range(len(keys))], "_kb"), same, "left_semi").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.sum("_c").over(upto)).join(chosen, same).drop(*[f"_k{j}" for j in range(len(keys))], "_kb")
    hit = values.select(*keys, "_v", "_n", F.explode(F.filter("_w", lambda w: (w["rank"] < F.col("_before") + F.col("_upto")) & (w["rank"] >= F.col("_before") + F.col("_upto") - F.col("_c")))).alias("w"))
    pick = lambda i, upper: F.max(F.when((F.col("w.i") == i) & (F.col("w.upper") == upper), F.col("_v")))
    part = lambda i: F.max(F.when(F.col("w.i") == i, F.col("w.part")))
    return hit.groupBy(*keys).agg(F.max("_n").alias("n"), *[(pick(i, False) + (pick(i, True) - pick(i, False)) * part(i)).alias(name) for i, name in enumerate(probs)])
