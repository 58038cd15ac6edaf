"""Per-key results when a few keys hold most rows.

A frequent-items sketch names the heavy keys in one pass. Their facts never move: they meet their dimension rows in a
broadcast join and are aggregated in parts. All other facts take the ordinary shuffle. Both are then united.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.runtime import cut, only


def heavy_keys(df: DataFrame, key: str, share: float) -> list:
    """The keys that may hold more than ``share`` of the rows: at most 2 / share of them, every truly heavy one included.

    The sketch (Misra-Gries kind, mergeable, partial on the map side) tracks 8 / share items, so its error is below
    share / 4 of all rows; keys whose estimate reaches half of ``share`` are kept. NULL keys are never heavy.
    Empty table: no keys.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    most = math.ceil(2 / share)
    tracked = 1 << math.ceil(math.log2(max(16, 8 / share)))
    row = (
        only(df, key)
        .where(F.col(f"`{key}`").isNotNull())
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top"))
        .first()
    )
    return [x["item"] for x in row["top"] or [] if x["count"] >= share * row["n"] / 2]


def with_rows(facts: DataFrame, dimension: DataFrame, key: str, share: float, heavy: list | None = None) -> DataFrame:
    """Every fact with its dimension row (an inner join on ``key``) and ``is_heavy``; facts of heavy keys never move.

    Facts of keys above ``share`` meet the rows of these keys, at most 2 / share of them, in a broadcast join; all others
    take the ordinary shuffle; both are united. Columns of the facts come first; a column of the dimension that has the name
    of one of the facts is an error, the key apart. Of repeated keys of the dimension every row meets the facts.
    """
    clash = (set(facts.columns) & set(dimension.columns)) - {key}
    if clash:
        raise ValueError(f"columns in facts and dimension: {', '.join(sorted(clash))}")
    heavy = heavy_keys(facts, key, share) if heavy is None else heavy
    k = F.col(f"`{key}`")
    known = facts.where(k.isNotNull())
    if not heavy:
        return known.join(dimension, key).withColumn("is_heavy", F.lit(False))
    light = known.where(~k.isin(heavy)).join(dimension.where(~k.isin(heavy)), key).withColumn("is_heavy", F.lit(False))
    rows = dimension.where(k.isin(heavy))
    # One row a key is at most 2 / share rows; a dimension with repeated keys has no such bound and is looked at first.
    most = 16 * math.ceil(2 / share)
    rows = F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
    return light.unionByName(known.where(k.isin(heavy)).join(rows, key).withColumn("is_heavy", F.lit(True)))


def per_key(facts: DataFrame, dimension: DataFrame, key: str, measures: dict[str, Column], share: float) -> DataFrame:
    """Each row of ``dimension`` with aggregates over its facts, the rows of heavy keys without moving their facts.

    facts      any rows; those with a NULL key or without a dimension row are in no result.
    dimension  one row per key (of repeated keys every row is kept and has its own measures).
    measures   name -> aggregate Column over the columns of ``facts`` and ``dimension``; each must be one whose parts Spark
               combines (of others see ``operators/quantile.py`` and ``distinct_per_key``).
    share      keys above this share of the facts take the broadcast path; it changes cost only, never the result.

    Facts meet their dimension rows (``with_rows``), then each task sums up what it holds and only these sums are shuffled.
    Result: all columns of ``dimension``, the measures (NULL where a key has no facts) and ``is_heavy boolean``.
    """
    clash = set(measures) & (set(dimension.columns) | {"is_heavy"})
    if clash:
        raise ValueError(f"measures named like columns of the dimension: {', '.join(sorted(clash))}")
    rows = cut(dimension.withColumn("_row", F.monotonically_increasing_id()))
    own = [c for c in facts.columns if c == key or c not in dimension.columns]
    met = with_rows(facts.select(*[F.col(f"`{c}`") for c in own]), rows, key, share)
    sums = met.groupBy(key, "_row").agg(*[c.alias(n) for n, c in measures.items()], F.max("is_heavy").alias("is_heavy")).drop(key)
    out = rows.join(sums, "_row", "left").drop("_row")
    return out.withColumn("is_heavy", F.coalesce("is_heavy", F.lit(False)))


def distinct_per_key(facts: DataFrame, key: str, value: str, salts: int = 64) -> DataFrame:
    """``key, n``: the number of different non-NULL values of each non-NULL key, exact.

    Counted within salts of the value's hash first, so a heavy key is spread over as many tasks; the counts are then added.
    """
    f = facts.select(F.col(f"`{key}`").alias(key), F.col(f"`{value}`").alias("_v")).where(F.col(key).isNotNull() & F.col("_v").isNotNull())
    part = f.groupBy(key, F.pmod(F.xxhash64("_v"), F.lit(salts)).alias("_s")).agg(F.count_distinct("_v").alias("_n"))
    return part.groupBy(key).agg(F.sum("_n").alias("n"))
