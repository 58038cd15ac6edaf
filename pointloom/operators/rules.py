"""A rule engine whose rules are columns: conditions, confidences and labels become one expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A label where a condition holds, with a confidence. NULL conditions and confidences do not hold (count as 0)."""

    name: str
    condition: Column
    label: int
    confidence: Column
    priority: int = 0
    weight: float = 1.0


def _candidates(rules: list[Rule]) -> list[Column]:
    return [F.when(F.coalesce(r.condition, F.lit(False)), F.struct(F.coalesce(r.confidence.cast("double"), F.lit(0.0)).alias("confidence"), F.lit(-i).alias("order"), F.lit(r.label).alias("label"), F.lit(r.name).alias("rule"))) for i, r in enumerate(rules)]


def decide(rules: list[Rule], strategy: str = "first") -> Column:
    """``struct<confidence, order, label, rule>`` of the deciding rule, NULL where none holds.

    first: in list order; priority: the highest priority, then list order; best: the highest confidence, then list order;
    weighted: the label whose rules have the highest sum of weight times confidence (ties: the smallest label), with that
    sum over the sum of weights of the rules that hold as its confidence.
    """
    if not rules:
        raise ValueError("no rules")
    if strategy in ("first", "priority"):
        order = rules if strategy == "first" else sorted(rules, key=lambda r: -r.priority)
        return F.coalesce(*_candidates(order))
    if strategy == "best":
        return F.array_max(F.array_compact(F.array(*_candidates(rules))))
    if strategy == "weighted":
        holds = [F.coalesce(r.condition, F.lit(False)) for r in rules]
        total = reduce(lambda a, b: a + b, [F.when(h, r.weight).otherwise(0.0) for h, r in zip(holds, rules)])
        per = []
        for label in sorted({r.label for r in rules}):
            own = [(h, r) for h, r in zip(holds, rules) if r.label == label]
            score = reduce(lambda a, b: a + b, [F.when(h, F.coalesce(r.confidence, F.lit(0.0)) * r.weight).otherwise(0.0) for h, r in own])
            any_ = reduce(lambda a, b: a | b, [h for h, _ in own])
            per.append(F.when(any_, F.struct((score / total).alias("confidence"), F.lit(-label).alias("order"), F.lit(label).alias("label"), F.lit("weighted").alias("rule"))))
        return F.array_max(F.array_compact(F.array(*per)))
    raise ValueError(f"unknown strategy: {strategy}")


def apply_levels(df: DataFrame, levels: list[tuple[list[Rule], str]], current: str | None = None) -> DataFrame:
    """Add ``label, confidence, rule``: levels are tried in turn, the first that decides counts; rows left keep ``current`` (or 0)."""
    made = F.coalesce(*[decide(rules, strategy) for rules, strategy in levels])
    keep = F.col(current) if current else F.lit(0)
    out = df.withColumn("_d", made)
    return out.withColumns({"label": F.coalesce(F.col("_d.label"), keep), "confidence": F.coalesce(F.col("_d.confidence"), F.lit(0.0)), "rule": F.col("_d.rule")}).drop("_d")


def merge_results(results: DataFrame, strategy: str = "highest_confidence") -> DataFrame:
    """``point_id, label, confidence`` of several results a point (``point_id, source int, label, confidence, priority``).

    highest_confidence, first, last (by source), highest_priority, weighted_vote (the label with the greatest sum of
    confidences). Ties: the smaller source, in the vote the smaller label. Rows with a NULL or 0 label don't take part.
    """
    r = results.where(F.col("label").isNotNull() & (F.col("label") != 0))
    if strategy == "weighted_vote":
        by = r.groupBy("point_id", "label").agg(F.sum("confidence").alias("s"))
        best = by.groupBy("point_id").agg(F.max(F.struct("s", (-F.col("label")).alias("m"))).alias("b"))
        return best.select("point_id", (-F.col("b.m")).alias("label"), F.col("b.s").alias("confidence"))
    orders = {
        "highest_confidence": ["confidence", (-F.col("source")).alias("o")], "first": [(-F.col("source")).alias("o")], "last": ["source"],
        "highest_priority": ["priority", (-F.col("source")).alias("o")],
    }
    if strategy not in orders:
        raise ValueError(f"unknown strategy: {strategy}")
    best = r.groupBy("point_id").agg(F.max(F.struct(*orders[strategy], F.col("label").alias("l"), F.col("confidence").alias("c"))).alias("b"))
    return best.select("point_id", F.col("b.l").alias("label"), F.col("b.c").alias("confidence"))
