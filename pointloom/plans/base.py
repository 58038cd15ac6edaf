"""The frames that queries start from, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.frames import FEATURE, current_features, current_points
from pointloom.runtime import finite, table


def points(spark: SparkSession, d: str) -> DataFrame:
    return current_points(table(spark, d, "points"))


def features(spark: SparkSession, d: str, *read: str) -> DataFrame:
    """Points with the features of their latest enrichment: those that a query reads (all where none are named), each finite."""
    read = read or tuple(FEATURE)
    f = current_features(table(spark, d, "point_features"), list(read)).where(finite(*read))
    return points(spark, d).join(f, "point_id")


def bands(spark: SparkSession, d: str) -> DataFrame:
    """Four bands in 0..1 per line item (the colours of a scan are not among the tables)."""
    li = table(spark, d, "lineitem")
    cast = lambda c: F.col(c).cast("double")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (cast("l_discount") * 10).alias("red"), (cast("l_tax") * 10).alias("green"), (cast("l_quantity") / 50).alias("blue"), (1 - cast("l_tax") * 10).alias("nir"))


#: The same frames as common table expressions.
POINTS = """
P AS (SELECT *, coalesce(tile_id, printf('T%04d_%04d', floor(x / 1000)::INT, floor(y / 1000)::INT)) AS tile FROM points WHERE point_id IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(z)
      QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC NULLS LAST, classification DESC NULLS LAST) = 1)
"""
LATEST = """, L AS (SELECT * FROM point_features WHERE point_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY enriched_at DESC NULLS LAST) = 1),
F AS (SELECT P.*, {columns} FROM P JOIN L USING (point_id) WHERE {good})"""
BANDS = """
B AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount::DOUBLE * 10 AS red, l_tax::DOUBLE * 10 AS green, l_quantity::DOUBLE / 50 AS blue, 1 - l_tax::DOUBLE * 10 AS nir FROM lineitem)
"""


def p(sql: str, more: str = "") -> str:
    return f"WITH {POINTS}{more} {sql}"


def f(sql: str, more: str = "", read: str = "") -> str:
    """SQL over F, the points with the features in ``read`` (blanks between), all where it is empty."""
    names = read.split() or FEATURE
    good = " AND ".join(f"isfinite(L.{c})" for c in names)
    latest = LATEST.format(columns=", ".join(f"L.{c}::DOUBLE AS {c}" for c in names), good=good)
    return f"WITH {POINTS}{latest}{more} {sql}"


def b(sql: str, more: str = "") -> str:
    return f"WITH {BANDS}{more} {sql}"
