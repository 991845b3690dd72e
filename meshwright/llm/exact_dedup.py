"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. New rows are reduced to
one candidate a digest before any shuffle by digest, thrown against the index with a sort-merge anti-join,
and what is new is appended to the same buckets.

Defined cases: a null text counts as empty, so null and blank texts are copies of each other. Rows that
repeat an id and a text are copies; exactly one row of a group stays. A row without id stays only where
no row of its group has one. An empty batch appends nothing. Columns other than id and text are carried
along untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm.common import SPACES, blank, cut, join_uneven, remove, shared_dir


def normal_text(text: str | Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(blank(text), SPACES, " ")


class DigestIndex:
    """One row per distinct text ever seen: its digest and the id of the row that stayed."""

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int = 32) -> None:
        """Opens the index at `location`, or makes it there. `buckets` holds for the index's whole life."""
        self.spark, self.name, self.location, self.buckets = spark, name, location, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (_digest BINARY, _keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (_digest) SORTED BY (_digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 32) -> DigestIndex:
        name = f"digest_index_{uuid.uuid4().hex}"
        return cls(spark, name, f"{shared_dir(spark)}/{name}", buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def admit(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decisions on a batch, one row per row: id, _digest, _text_hash, keep_id, group_size, kept.

        group_size counts the batch's rows with this text; kept is true on the one row that stays, which
        is none if an earlier batch had the text. The batch's new digests are in the index on return.
        """
        marked = cut(
            docs.select(
                F.col(id_col).alias("_id"),
                F.unhex(F.sha2(normal_text(text_col), 256)).alias("_digest"),
                F.xxhash64(text_col).alias("_text_hash"),
                F.monotonically_increasing_id().alias("_uid"),
            )
        )
        # min and count combine in each task first: a hot group reaches the shuffle as one row a task
        first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_uid").alias("uid")))
        groups = cut(marked.groupBy("_digest").agg(first.alias("_first"), F.count("*").alias("group_size")))
        fresh = groups.join(self.rows().hint("merge"), "_digest", "left_anti")
        fresh = cut(fresh.select("_digest", F.col("_first.id").alias("_keep_id"), F.col("_first.uid").alias("_keep_uid")))
        (
            fresh.select("_digest", "_keep_id")
            .repartition(self.buckets, "_digest")
            .sortWithinPartitions("_digest")
            .write.insertInto(self.name)
        )
        keep = (
            groups.select("_digest", "group_size")
            .join(self.rows().hint("merge"), "_digest", "left")
            .join(fresh.select("_digest", "_keep_uid"), "_digest", "left")
        )
        keep = cut(keep.withColumn("_copies", F.col("group_size")))
        total = keep.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
        return join_uneven(marked, keep, ["_digest"], "_copies", total).select(
            F.col("_id").alias(id_col),
            F.col("_keep_id").alias("keep_id"),
            "group_size",
            F.coalesce(F.col("_uid") == F.col("_keep_uid"), F.lit(False)).alias("kept"),
            "_digest",
            "_text_hash",
        )

    def compact(self) -> None:
        """Rewrites the index at a new place, so that each bucket is one sorted file again, and drops the old files."""
        old, self.location = self.location, f"{self.location.rstrip('/')}-{uuid.uuid4().hex[:8]}"
        made = f"{self.name}_{uuid.uuid4().hex[:8]}"
        fresh = DigestIndex(self.spark, made, self.location, self.buckets)
        self.rows().repartition(self.buckets, "_digest").sortWithinPartitions("_digest").write.insertInto(made)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {fresh.name} RENAME TO {self.name}")
        remove(self.spark, [old])

    def drop(self) -> None:
        """The table and its files; decisions that admit() has given stay valid."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, [self.location])


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns.

    The decisions go back to the rows by id and text hash, a key that no group of copies makes hot.
    """
    kept = index.admit(docs, id_col, text_col).where("kept").select(
        F.col(id_col).alias("_id"), F.col("_text_hash").alias("_hash")
    )
    # the rows travel as one column, so that no name of theirs can clash
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    same = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id"))
    matched = rows.alias("a").join(
        kept.alias("b"), F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._hash") == F.col("b._hash")), "left_semi"
    )
    return matched.withColumn("_same", same).where("_same = 1").select("_row.*")
