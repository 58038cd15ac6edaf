"""Cutting oversized files into pieces at natural boundaries, with overlap, without loading a whole file anywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.runtime import cut, only

#: A file is planned in independent stretches of so many window lengths, so no task sees more than a bounded number of cuts.
STRETCH = 4096


def ordered(points: DataFrame, file_col: str, id_col: str, time_col: str, gap: float) -> DataFrame:
    """All different points in ranges of (file, time, id), written once: ``file, id, t, part, pos, natural``.

    ``part`` is the range, ``pos`` the 0-based place among the points of the file within the range, ``natural`` says
    that the point comes at least ``gap`` after the point before it in the range; it is NULL for the first point of a
    file in a range, which ``starts`` settles from the rim of the range before. Rows of one (file, time, id) are one
    point. NULL files and ids are left out; a NULL or NaN time sorts behind all times and is never a boundary.
    """
    p = only(points, file_col, id_col, time_col).toDF("file", "id", "t").where("file IS NOT NULL AND id IS NOT NULL")
    p = p.select("file", "id", F.coalesce(F.nanvl(F.col("t").cast("double"), F.lit(None).cast("double")), F.lit(float("inf"))).alias("t"))
    p = p.repartitionByRange("file", "t", "id").sortWithinPartitions("file", "t", "id").withColumn("part", F.spark_partition_id())

    def mark(batches):
        last, count = None, 0
        for pdf in batches:
            f, t, i = pdf["file"].to_numpy(), pdf["t"].to_numpy(), pdf["id"].to_numpy()
            if not len(f):
                continue
            pf, pt, pi = (np.concatenate([[x[0] if last is None else y], x[:-1]]) for x, y in zip((f, t, i), last or (f, t, i)))
            new_file, same = f != pf, (f == pf) & (t == pt) & (i == pi)
            if last is None:
                new_file[0], same[0] = True, False
            pf, pt, pi = f[-1], t[-1], i[-1]
            keep = ~same
            with np.errstate(invalid="ignore"):
                prev = np.concatenate([[last[1] if last is not None else np.nan], t[:-1]])
                natural = (t - prev >= gap) & np.isfinite(t)
            f, t, i, new_file, natural = f[keep], t[keep], i[keep], new_file[keep], natural[keep]
            if len(f):
                place = np.arange(len(f))
                begin = np.maximum.accumulate(np.where(new_file, place, -1))
                pos = np.where(begin >= 0, place - begin, place + count)
                count = int(pos[-1]) + 1
                flags = pd.Series(natural, dtype="boolean")
                flags[new_file] = pd.NA
                yield pd.DataFrame({"file": f, "id": i, "t": t, "part": pdf["part"].iloc[0], "pos": pos, "natural": flags})
            last = (pf, pt, pi)

    kind = p.schema
    schema = f"file {kind['file'].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, t double, part int, pos long, natural boolean"
    return cut(p.mapInPandas(mark, schema))


def starts(rows: DataFrame, gap: float) -> DataFrame:
    """The boundary table of the ranges: ``file, part, n, start, total, natural`` for each file in each range.

    ``start`` is the prefix sum of lengths (the place in the file of its first point in the range), ``total`` the
    file's number of points, ``natural`` whether that first point lies ``gap`` behind the last one of the range before.
    A file has one row per range it spans, so the window below is as small as the number of ranges.
    """
    rim = rows.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    w = Window.partitionBy("file").orderBy("part")
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    natural = (F.col("t0") - F.lag("t1").over(w) >= gap) & (F.col("t0") < float("inf"))
    return rim.select("file", "part", "n", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("file")).alias("total"), F.coalesce(natural, F.lit(False)).alias("natural"))


def boundaries(rows: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """``file, id, at, total``: every natural boundary of the files with more than ``limit`` points; ``at`` is its place."""
    big = table.where(F.col("total") > limit)
    marks = rows.where("natural OR natural IS NULL").withColumnRenamed("natural", "known")
    met = marks.join(big, ["file", "part"]).where(F.coalesce("known", "natural"))
    return met.select("file", "id", (F.col("start") + F.col("pos")).alias("at"), "total")


def pieces(cuts: DataFrame, table: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``file, piece, first, last, n, natural``: the pieces of each oversized file, places inclusive and 0-based.

    Each piece has at most ``limit`` points and shares exactly ``overlap`` points with the one before it (with all of
    it, if that one is shorter). A piece ends before a natural boundary where its window of limit - overlap places
    holds one, else at the limit (``natural`` false).

    Of the boundaries of each window length the first and the last suffice for that, so the plan reads at most two rows
    per limit - overlap points. A file is planned in stretches of STRETCH windows; each begins at the last boundary
    before it or, without one, at its own edge, so the piece before it may be short.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    window = limit - overlap
    cell = F.floor(F.col("at") / window).cast("long")
    thin = cuts.groupBy("file", cell.alias("cell")).agg(F.min("at").alias("a"), F.max("at").alias("b"))
    edge = table.where(F.col("total") > limit).groupBy("file").agg(F.max("total").alias("total"))
    stretch = F.floor(F.col("cell") / STRETCH).cast("long")
    thin = thin.withColumn("stretch", stretch)
    # The last cell before a stretch settles where the stretch begins; it is also read as the stretch's first candidates.
    shown = thin.withColumn("stretch", F.explode(F.when((F.col("cell") + 1) % STRETCH == 0, F.array("stretch", F.col("stretch") + 1)).otherwise(F.array("stretch"))))
    every = edge.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / (window * STRETCH)).cast("long"))))
    got = shown.groupBy("file", "stretch").agg(F.array_sort(F.collect_set(F.col("a"))).alias("a"), F.array_sort(F.collect_set(F.col("b"))).alias("b"))
    plan = every.join(got, ["file", "stretch"], "left").select("file", "stretch", "total", F.coalesce(F.array_sort(F.array_union("a", "b")), F.array().cast("array<long>")).alias("marks"))
    plan = plan.withColumn("edge", F.col("stretch") * window * STRETCH)
    begin = F.coalesce(F.array_max(F.filter("marks", lambda m: (m <= F.col("edge")) & (F.col("edge") > 0))), F.col("edge"))
    plan = plan.withColumn("begin", F.when(F.col("stretch") == 0, 0).otherwise(begin))
    plan = plan.withColumn("end", F.coalesce(F.lead("begin").over(Window.partitionBy("file").orderBy("stretch")), F.col("total")))

    def cut_up(batches):
        for pdf in batches:
            out = []
            for file, stretch, total, marks, begin, end in zip(pdf["file"], pdf["stretch"], pdf["total"], pdf["marks"], pdf["begin"], pdf["end"]):
                marks = np.asarray(marks, np.int64)
                first, own, whole = int(begin), 0, True
                own_start = first  # new points of the piece begin here; it also shows the overlap before them
                while own_start < end:
                    first = max(0, own_start - overlap) if own_start else 0
                    top = first + limit
                    if top >= end:
                        stop, natural = int(end), bool(end == total or (len(marks) and end in marks))
                    else:
                        k = np.searchsorted(marks, top, side="right") - 1
                        natural = bool(k >= 0 and marks[k] > own_start)
                        stop = int(marks[k]) if natural else top
                    out.append((file, stretch, own, first, stop - 1, stop - first, natural))
                    own_start, own = stop, own + 1
            if out:
                yield pd.DataFrame(out, columns=["file", "stretch", "own", "first", "last", "n", "natural"])

    kind = plan.schema["file"].dataType.simpleString()
    flat = plan.select("file", "stretch", "total", "marks", "begin", "end").repartition("file", "stretch").mapInPandas(cut_up, f"file {kind}, stretch long, own long, first long, last long, n long, natural boolean")
    # Pieces are numbered over the counts of stretches, not over the pieces.
    flat = cut(flat)
    w = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offset = flat.groupBy("file", "stretch").count().withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0))).drop("count")
    return flat.join(offset, ["file", "stretch"]).select("file", (F.col("before") + F.col("own")).alias("piece"), "first", "last", "n", "natural")


def members(rows: DataFrame, table: DataFrame, plan: DataFrame, limit: int) -> DataFrame:
    """``file, piece, id, at``: the points of every piece (shared points once in each), by offset: an equi-join on blocks of ``limit`` places."""
    at: Column = F.col("start") + F.col("pos")
    placed = rows.join(table.where(F.col("total") > limit).select("file", "part", "start"), ["file", "part"]).select("file", "id", at.alias("at"))
    placed = placed.withColumn("block", F.floor(F.col("at") / limit).cast("long"))
    blocks = plan.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / limit).cast("long"), F.floor(F.col("last") / limit).cast("long"))))
    met = placed.join(blocks, ["file", "block"]).where("at BETWEEN first AND last")
    return met.select("file", "piece", "id", "at")
