"""Labels by stages: ordered rewrites of one label, each a condition over the columns and the label so far."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """Where ``where`` holds the label becomes ``to``; both are SQL expressions that may read the label so far as ``label``.

    A NULL condition does not hold.
    """

    where: str
    to: str


def run(df: DataFrame, stages: list[Stage], start: str = "classification") -> DataFrame:
    """Add ``label``: the expression ``start``, rewritten by the stages in order, so a later one overwrites an earlier one."""
    out = df.withColumn("label", F.expr(start).cast("int"))
    for s in stages:
        out = out.withColumn("label", F.when(F.coalesce(F.expr(s.where), F.lit(False)), F.expr(s.to).cast("int")).otherwise(F.col("label")))
    return out


@dataclass(frozen=True)
class Signature:
    """What a class looks like: a name and the bounds of its features (least, greatest; either may be None), inclusive."""

    name: str
    bounds: dict[str, tuple[float | None, float | None]]

    def checks(self) -> list[str]:
        """One condition per bound, as SQL."""
        out = []
        for c, (low, high) in self.bounds.items():
            out += [f"{c} >= {low}"] if low is not None else []
            out += [f"{c} <= {high}"] if high is not None else []
        return out

    def share(self) -> Column:
        """The share of bounds that hold; a feature that is NULL is not asked. NULL where none is known."""
        tests = [F.expr(c) for c in self.checks()]
        asked = sum((t.isNotNull().cast("int") for t in tests[1:]), tests[0].isNotNull().cast("int"))
        held = sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests[1:]), F.coalesce(tests[0].cast("int"), F.lit(0)))
        return F.try_divide(held.cast("double"), asked.cast("double"))


def best_score(scores: dict[str, Column], least: float, otherwise: str) -> Column:
    """``struct<score, kind>``: the kind with the greatest score (ties: the first named), ``otherwise`` where that is below ``least``."""
    each = [F.struct(F.round(c, 9).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("kind")) for i, (n, c) in enumerate(scores.items())]
    top = F.array_max(F.array(*each))
    return F.struct(top["score"].alias("score"), F.when(top["score"] < least, otherwise).otherwise(top["kind"]).alias("kind"))
