"""Filling containers of fixed capacity with items, planned over the histogram of sizes."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.rank import ranked
from pointloom.runtime import cut, partitions

#: Ranks of one size are cut into cells of so many; a cell is the unit in which items meet their slots.
CELL = 1024


def byte_tokens(text: Column) -> Column:
    """Size in tokens of the byte-level tokenizer: UTF-8 bytes plus one end token; 1 for an empty or NULL text."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: slots ``(size, rank_lo, rank_hi, container, per)`` and the number of containers.

    The items of one size with ranks in [rank_lo, rank_hi) go ``per`` to a container, the first ones to ``container``.
    Open containers are kept as runs (remaining space -> runs of equal containers), so the work grows with the number
    of different sizes, not with the number of items.
    """
    slots, containers = [], 0
    spaces: list[int] = []  # sorted remaining spaces that have runs
    runs: dict[int, list[tuple[int, int]]] = {}  # space -> (first container, how many)

    def put(space: int, first: int, n: int) -> None:
        if space not in runs:
            bisect.insort(spaces, space)
            runs[space] = []
        runs[space].append((first, n))

    for size in sorted((s for s in histogram if histogram[s] > 0), reverse=True):
        if size > capacity:
            raise ValueError(f"size {size} exceeds the capacity {capacity}")
        left, rank = histogram[size], 0
        while left:
            k = bisect.bisect_left(spaces, size)
            if k < len(spaces):  # the tightest space that holds the size; one item into each container of the run
                space = spaces[k]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space], spaces[k]
                used = min(n, left)
                slots.append((size, rank, rank + used, first, 1))
                if n > used:
                    put(space, first + used, n - used)
                put(space - size, first, used) if space > size else None
                rank, left = rank + used, left - used
            else:  # new containers, each filled with as many of this size as fit
                per = capacity // size
                full, rest = divmod(left, per)
                for number, each in ((full, per), (1 if rest else 0, rest)):
                    if number:
                        slots.append((size, rank, rank + number * each, containers, each))
                        if capacity > each * size:
                            put(capacity - each * size, containers, number)
                        containers, rank, left = containers + number, rank + number * each, left - number * each
    return slots, containers


def pack(items: DataFrame, id_col: str, size: Column, capacity: int) -> DataFrame:
    """``id, piece, pieces, offset, size, container``: every item, or every piece of one above the capacity, in one container.

    An item is cut only if it alone exceeds the capacity: into full pieces and one remainder, ``offset`` being the place
    of the piece in the item. Sizes of NULL or below 1 count as 1. Repeated ids are items of their own; NULL ids too.

    The driver sees one row per different size, at most ``capacity`` of them, and plans slots over counts. Items then
    take slots by their rank within their size (ranks are made in hash parts, slots met in cells of ranks, so one
    frequent size is no hot task).
    Empty table: no rows.
    """
    base = items.select(F.col(f"`{id_col}`").alias("id"), F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1)).alias("whole"))
    pieces = F.floor((F.col("whole") + capacity - 1) / capacity).cast("int")
    base = cut(base.withColumn("pieces", pieces))
    one = base.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    one = one.withColumn("offset", F.col("piece").cast("long") * capacity)
    one = one.select("id", "piece", "pieces", "offset", F.least(F.lit(capacity), F.col("whole") - F.col("offset")).alias("size"))
    histogram = {r["size"]: r["count"] for r in one.groupBy("size").count().collect()}  # at most ``capacity`` rows
    slots, _ = plan_slots(histogram, capacity)
    spark = items.sparkSession
    slots = spark.createDataFrame(slots, "size long, lo long, hi long, container0 long, per long")
    h = F.xxhash64("id", "piece")
    at = ranked(one.withColumn("h", h), ["size"], [F.col("h"), F.col("id"), F.col("piece")], F.pmod(F.col("h"), F.lit(partitions(spark))))
    met = _slot_of(at.drop("h"), slots)
    return met.select("id", "piece", "pieces", "offset", "size", (F.col("slot.container0") + F.floor((F.col("rank0") - F.col("slot.lo")) / F.col("slot.per"))).cast("long").alias("container"))


def _slot_of(ranked_items: DataFrame, slots: DataFrame) -> DataFrame:
    """The items with the slot of their size whose ranks hold theirs: the last one that starts at or before it.

    Slots are cut at the borders of rank cells, put among the items of (size, cell) and carried on to the items behind
    them. So a row is written per item and per slot and cell, however many slots a size has, and no task holds a size.
    """
    cells = slots.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))))
    starts = cells.select("size", "cell", F.greatest("lo", F.col("cell") * CELL).alias("rank0"), F.struct("lo", "container0", "per").alias("_slot"))
    items = ranked_items.withColumns({"cell": F.floor(F.col("rank0") / CELL), "_item": F.lit(True)})
    both = items.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy("size", "cell").orderBy("rank0", F.col("_item").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("slot", F.last("_slot", ignorenulls=True).over(w)).where("_item").drop("_slot", "_item", "cell")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row on the whole: containers, their tokens, the share of space used and the lower bound of containers."""
    by = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    total = F.sum("used")
    return by.agg(
        F.count(F.lit(1)).alias("containers"), total.alias("tokens"), F.try_divide(total.cast("double"), F.count(F.lit(1)) * capacity).alias("fill"),
        F.ceil(total / capacity).alias("least_containers"), F.max("used").alias("fullest"), F.max("items").alias("most_items"),
    )
