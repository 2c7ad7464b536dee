"""Sample statistics of benchmark reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(samples: Column) -> list[Column]:
    """p50 and p95 by linear interpolation; null without samples."""
    return [F.percentile(samples, p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95)]


def summary(samples: Column) -> list[Column]:
    return [F.min(samples).alias("least"), F.max(samples).alias("most"), F.avg(samples).alias("mean"), F.median(samples).alias("median")]


def all_same(values: Column) -> Column:
    return F.countDistinct(values) <= 1


def segments(log: DataFrame, key: str, order: list[str], opens: Column) -> DataFrame:
    """Number of the segment each row of a log is in; a row where `opens` holds begins the next."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("segment", F.sum(opens.cast("int")).over(w))


def first_by_order(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
