"""How good labels are: distributions, confusion, agreement, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and percentage of each label (NULL is one of them)."""
    by = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))  # a row per label


def confusion(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    """``reference, predicted, n`` over rows with both labels."""
    both = df.where(F.col(reference).isNotNull() & F.col(predicted).isNotNull())
    return both.groupBy(F.col(reference).alias("reference"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, F1 and intersection over union, 0 where undefined."""
    hit = matrix.where("reference = predicted").select(F.col("reference").alias("label"), F.col("n").alias("tp"))
    rows = matrix.groupBy(F.col("reference").alias("label")).agg(F.sum("n").alias("support"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("found"))
    all_ = rows.join(cols, "label", "full").join(hit, "label", "left").fillna(0, ["support", "found", "tp"])
    p, r = (F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col(c)), F.lit(0.0)) for c in ("found", "support"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("found") + F.col("support")), F.lit(0.0))
    iou = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("found") + F.col("support") - F.col("tp")), F.lit(0.0))
    return all_.select("label", "support", "found", p.alias("precision"), r.alias("recall"), f1.alias("f1"), iou.alias("iou"))


def agreement(matrix: DataFrame) -> DataFrame:
    """One row: number of rows, accuracy and Cohen's kappa (0 where chance agreement is whole or nothing is there)."""
    rows = matrix.groupBy(F.col("reference").alias("label")).agg(F.sum("n").alias("r"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "label").agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("rc"))
    total = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("reference") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    both = total.withColumn("_one", F.lit(1)).join(chance.withColumn("_one", F.lit(1)), "_one")  # one row each
    po, pe = F.try_divide(F.col("hit").cast("double"), F.col("n")), F.coalesce(F.try_divide(F.col("rc"), F.col("n").cast("double") * F.col("n")), F.lit(0.0))
    return both.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(po, F.lit(0.0)).alias("accuracy"), F.coalesce(F.when(pe < 1, F.try_divide(po - pe, 1 - pe)), F.lit(0.0)).alias("kappa"))


def confused_pairs(matrix: DataFrame, k: int = 5) -> DataFrame:
    """The k unordered pairs of different labels that are confused most; ties by label."""
    wrong = matrix.where("reference <> predicted")
    by = wrong.groupBy(F.least("reference", "predicted").alias("label_a"), F.greatest("reference", "predicted").alias("label_b")).agg(F.sum("n").alias("n"))
    return by.orderBy(F.col("n").desc(), "label_a", "label_b").limit(k)


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Per bin of confidence: rows, accuracy and mean confidence; bins without rows have accuracy 0 and their middle."""
    spark = df.sparkSession
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins)).cast("int")
    by = df.where(F.col(confidence).between(0, 1)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(correct), 1.0).otherwise(0.0)).alias("accuracy"), F.avg(confidence).alias("confidence"))
    middle = (F.col("bin") + 0.5) / bins
    return spine.join(by, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("confidence", middle).alias("confidence"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """The expected calibration error over the bins of ``calibration``."""
    return bins.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n")), F.lit(0.0)).alias("ece"))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column over its finite values: count, mean, sample deviation, least, greatest; and how many are NULL, NaN, infinite.

    All columns are aggregated in one pass and then turned into rows.
    """
    parts = []
    for c in columns:
        v = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"),
                F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.isnan(c)).alias("nans"), F.count_if(F.abs(F.nanvl(F.col(c), F.lit(0.0))) == float("inf")).alias("infs"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
