"""Files as rows: a sorted listing with an optional limit, contents in bounded batches, pairs of files by stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files and bytes that go to Python together: a file is parsed as a whole, so a batch is held as a whole.
BATCH_FILES, BATCH_BYTES = 64, 32 << 20


def stem(path: Column) -> Column:
    """The file's name without folders and its last ending."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def listing(spark: SparkSession, folder: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """(path, name, stem) of the files that match, by path; the first `most` of them, if given. No content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    own = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), stem(F.col("path")).alias("stem")).orderBy("path")
    return own if most is None else own.limit(most)


def contents(spark: SparkSession, folder: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """(path, name, stem, content: binary) of the same files."""
    for key, bound in (("maxRecordsPerBatch", BATCH_FILES), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        own = spark.conf.get(name, None) or "0"
        if not own.isdigit() or not 0 < int(own) <= bound:
            spark.conf.set(name, str(bound))
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    rows = read.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), stem(F.col("path")).alias("stem"), "content")
    return rows if most is None else rows.join(listing(spark, folder, pattern, most).select("path"), "path", "left_semi")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """(stem, left, right): each file of a listing with the one of the other listing that has its stem, or null.

    Of several with one stem the first by path counts.
    """
    first = lambda df, name: df.groupBy("stem").agg(F.min("path").alias(name))
    return first(left, "left").join(first(right, "right"), "stem", "left")
