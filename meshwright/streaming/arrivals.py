"""New files as they arrive: each micro-batch goes through the same tables as a batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def on_arrival(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_at_once: int = 100) -> StreamingQuery:
    """Starts a query that hands the contents of new files (path, value) to `handle`, batch by batch.

    The checkpoint remembers which files are done; `handle` may see a batch again after a failure, with the same
    number, and should write it under that number.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).load(path).selectExpr("_metadata.file_path AS path", "value")
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
