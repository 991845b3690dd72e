"""First-wins dedupe, top-k, keyed counts: the primitives under most operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(value: Column, quantum: float) -> Column:
    """Half-even rounding of value / quantum, as an integer key."""
    return F.rint(value / F.lit(quantum)).cast("long")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key, the first in order. Partial aggregation keeps one row a key and task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank from 1. Spark limits each task's groups before the shuffle."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(over)).where(F.col(rank) <= k)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, prefix: str, width: int = 5) -> DataFrame:
    """Ids such as EQ00001 in order within each key."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.format_string(f"{prefix}%0{width}d", F.row_number().over(over)))


def evidence_grade(occurrences: Column, files: Column) -> Column:
    return (
        F.when((occurrences >= 100) & (files >= 20), "high")
        .when((occurrences >= 20) & (files >= 5), "medium")
        .otherwise("exploratory")
    )


def keyed_counts(
    df: DataFrame, keys: list[str], file: str = "file", weight: str | None = None, at_least: int = 1, files_at_least: int = 1
) -> DataFrame:
    """occurrences, file_count and evidence_grade of each key, where both reach their thresholds.

    weight: a column that says how many occurrences a row stands for. Files are counted distinct after a
    first aggregation by key and file, so a hot key shuffles one row a file and task.
    """
    by_file = df.groupBy(*keys, file).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    counted = by_file.groupBy(*keys).agg(F.sum("_n").cast("long").alias("occurrences"), F.count("*").alias("file_count"))
    return counted.where((F.col("occurrences") >= at_least) & (F.col("file_count") >= files_at_least)).withColumn(
        "evidence_grade", evidence_grade(F.col("occurrences"), F.col("file_count"))
    )


def class_pairs(members: DataFrame, group: list[str], cls: str = "class") -> DataFrame:
    """(group, class_a, class_b, pairs): how many unordered pairs of distinct members have these classes.

    Counted from each group's class histogram, so a group costs the square of its classes, not of its members.
    """
    counts = members.groupBy(*group, cls).agg(F.count("*").alias("n"))
    a = counts.select(*group, F.col(cls).alias("class_a"), F.col("n").alias("n_a"))
    b = counts.select(*group, F.col(cls).alias("class_b"), F.col("n").alias("n_b"))
    pairs = F.when(F.col("class_a") == F.col("class_b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
    joined = a.join(b, group).where("class_a <= class_b").withColumn("pairs", pairs.cast("long"))
    return joined.where("pairs > 0").select(*group, "class_a", "class_b", "pairs")


def histogram_text(cls: Column | str, n: Column | str, *, where: Column | None = None) -> Column:
    """An aggregate: `class:n` of all rows, sorted by class, joined by commas."""
    c, k = (F.col(x) if isinstance(x, str) else x for x in (cls, n))
    item = F.struct(c.alias("c"), k.alias("n"))
    items = F.collect_list(F.when(where, item) if where is not None else item)
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(x["c"], F.lit(":"), x["n"].cast("string"))), ",")
