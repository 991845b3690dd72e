"""What the operators of this subpackage share: the shared folder, lineage cuts, numbering."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: the space and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only after a count has shown that it has no more rows than this,
BROADCAST_ROWS = 10_000
#: or that its rows, at a stated width, are no more bytes than this.
BROADCAST_BYTES = 4 << 20
#: A key is hot if more than one row in this many has it, so there are never more hot keys than this.
HOT_SHARE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes in a batch that goes to Python: texts may be long, and a worker holds a batch a few times over.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bounds on Arrow batches, unless the caller's are closer; they hold for later queries too."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        own = spark.conf.get(name, None) or "0"
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(name, str(most))


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task of Python that gives its memory back to the system when it is done, as its worker lives on for other tasks."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library's
            trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only in local mode may it be one of our own.

    Every operator asks for it before it runs, so batches for Python are bounded here too.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="meshwright-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once: later stages and retries read them from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """The same rows as Parquet in the shared folder; small files are read many at a time, and their size is known.

    paths: a list that gets the new path, for remove() once nothing reads it any more.
    """
    path = scratch(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of the shared file system."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


#: Rows that one partition of a packed table holds.
PACK_ROWS = 20_000


def packed(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) in as many partitions as its counted rows are worth, so that few rows make few files; and the count."""
    done = cut(df)
    rows = done.count()
    return done.coalesce(rows // PACK_ROWS + 1), rows


def on_small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows are few; else the planner's own choice."""
    return F.broadcast(df) if rows <= most else df


def if_light(df: DataFrame, rows: int, width: int) -> DataFrame:
    """A broadcast hint if the counted rows, of `width` bytes at most, are light; else the planner's own choice."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def join_uneven(rows: DataFrame, table: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """rows joined with a table of one row a key, without a task that sees all rows of a hot key.

    copies: the table's column with the number of rows of each key; total: their sum. Hot keys, of which there
    are HOT_SHARE at most, meet their rows by a broadcast, the others by the planner's choice.
    """
    hot = F.col(copies) > max(total // HOT_SHARE, HOT_SHARE)
    few = table.where(hot).drop(copies)
    met = rows.join(F.broadcast(few), keys)
    return met.unionByName(rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.where(~hot).drop(copies), keys))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a total order, without a task that sees them all.

    Rows are dealt by range, numbered within each range, and moved by the sizes of the ranges before.
    The row per range is all that one task gathers.
    """
    ranged = cut(
        df.withColumn("_part", F.lit(0)).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
        .drop("_n")
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        ranged.withColumn("_row", within)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_row") + F.col("_before")).cast("long"))
        .drop("_row", "_before", "_part")
    )


def blank(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: A side of this many rows of a few plain columns (some tens of MB) is still broadcast; beyond, it is shuffled.
LABEL_ROWS = 500_000


def with_labels(docs: DataFrame, labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """`docs` with _fold (crc32 of the id as text, modulo 5; null without id) and _label (null where there is none).

    Several labels of one id count as their largest. Label rows are counted before they are broadcast.
    """
    own = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(column).cast("int").alias("_label"))
    if labels.count() <= LABEL_ROWS:
        own = F.broadcast(own)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)).cast("int")
    return docs.withColumn("_fold", fold).join(own, F.col(id_col) == F.col("_label_id"), "left").drop("_label_id")
