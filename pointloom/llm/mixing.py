"""Mixing sources to target shares of the total size, by systematic sampling."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.packing import byte_tokens
from pointloom.operators.rank import ranked
from pointloom.runtime import cut, partitions


def source_key(source: Column) -> Column:
    """A source without regard to case and surrounding white space (blanks, tabs, line ends, no-break spaces)."""
    return F.lower(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", ""))


def sized(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of the documents whose source is a target's, named as there; written once."""
    t = targets.select(source_key(F.col("source")).alias("_key"), F.col("source").alias("_as"))
    d = documents.select("doc_id", source_key(F.col("source")).alias("_key"), byte_tokens(F.col("text")).alias("size"))
    return cut(d.join(F.broadcast(t), "_key").select("doc_id", F.col("_as").alias("source"), "size"))  # targets: a list made by hand


def rates(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per target source: ``source, target_share, max_repeats, docs, tokens, wanted, copies, short``.

    ``total`` is the size of the mixture, by default the tokens of all documents of the target sources. A source is
    short if its tokens times its cap are less than its share of that; its copies stay at the cap, and the shares that
    are reached are reported. The driver sees one row per source. Shares are used as given, not normalised.
    """
    by = {r["source"]: r for r in sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("tokens")).collect()}
    total = sum(r["tokens"] for r in by.values()) if total is None else total
    out = []
    for t in sorted(targets.collect(), key=lambda t: t["source"]):
        r = by.get(t["source"])
        docs, tokens = (r["docs"], r["tokens"]) if r else (0, 0)
        wanted, cap = t["target_share"] * total, t["max_repeats"]
        out.append(
            {"source": t["source"], "target_share": t["target_share"], "max_repeats": cap, "docs": docs, "tokens": tokens, "wanted": wanted,
             "copies": min(float(cap), wanted / tokens) if tokens else 0.0, "short": tokens * cap < wanted}
        )
    return out


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture ``doc_id, source, size, copy`` and the report, one row per target source.

    Within a source the expected copies of its documents are prefix-summed in order of size (so that long and short
    texts are drawn evenly), one random offset is added, and a document comes out once per integer crossed: the floor
    or the ceiling of its expected copies, never above the cap. Ranks come from parts by size band and hash, so a source
    holding a third of all rows is no hot task. Documents of other or NULL sources are left out, empty and NULL texts
    count one token, repeated ids are documents of their own, a source without documents reports zero.
    """
    spark = documents.sparkSession
    sizes = sized(documents, targets)
    plan = rates(sizes, targets, total)
    offset = {r["source"]: zlib.crc32(f"{seed}:{r['source']}".encode()) / 2**32 for r in plan}
    per = spark.createDataFrame([(r["source"], r["copies"], offset[r["source"]]) for r in plan] or [("", 0.0, 0.0)], "source string, e double, o double")
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    n = partitions(spark)
    part = F.floor(F.log2("size") * 4) * n + F.pmod(F.col("h"), F.lit(n))
    at = ranked(sizes.withColumn("h", h), ["source"], [F.col("size"), F.col("h"), F.col("doc_id")], part)
    at = at.join(F.broadcast(per), "source")
    low = F.floor(F.col("rank0") * F.col("e") + F.col("o"))
    high = F.floor((F.col("rank0") + 1) * F.col("e") + F.col("o"))
    at = at.withColumn("k", (high - low).cast("int")).where("k > 0")
    mixture = at.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))
    kind = "source string, target_share double, max_repeats int, docs long, tokens long, wanted double, copies double, short boolean"
    rows = spark.createDataFrame([tuple(r.values()) for r in plan], kind)
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("rows_out"), F.sum("size").alias("tokens_out"), F.max("copy").alias("most_copies"))
    report = rows.join(got, "source", "left").fillna(0, ["rows_out", "tokens_out", "most_copies"])
    all_out = F.sum("tokens_out").over(Window.partitionBy())  # one row per target source
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens_out").cast("double"), all_out), F.lit(0.0)))
    return mixture, report
