"""Islands of intervals: union, coverage, growth around a primary one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: list[str], start: str, end: str, slack: Column | float) -> DataFrame:
    """`df` with island: the number, from 1 within the key, of the run of intervals with gaps up to the slack."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col(start) <= reach + slack, 0).otherwise(1)
    return df.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def union_spans(df: DataFrame, key: list[str], start: str, end: str, slack: Column | float) -> DataFrame:
    """(key, island, start, end, members): the hull of each island."""
    found = islands(df, key, start, end, slack)
    return found.groupBy(*key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def coverage(spans: DataFrame, key: list[str], start: str, end: str, low: str, high: str) -> DataFrame:
    """(key, covered, share): what hulls cover of [low, high], where a gap inside a hull counts as covered."""
    total = F.first(F.col(high) - F.col(low))
    covered = F.sum(F.col(end) - F.col(start))
    return spans.groupBy(*key).agg(covered.alias("covered"), F.least(F.lit(1.0), F.try_divide(covered, total)).alias("share"))
