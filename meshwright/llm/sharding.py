"""Sharding whole groups of equal texts into byte-balanced shards by Karmarkar-Karp differencing.

A partial partition is a vector of shard sums. Differencing takes the two partial partitions with the
largest spread (largest minus smallest sum) and adds them in opposite order, until one is left. It does
not care whether a partial partition holds one group or a million, so it runs as a reduction tree: groups
meet in buckets of bounded size, the buckets' partial partitions meet in buckets of buckets.

Law `bytes`: sizes near equal. A group of equal texts is never split; one above a shard's share sets the
largest shard. Defined cases: a null text has no bytes and the fixed overhead, and goes with the empty
texts; rows that repeat an id are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import blank, cut, if_light, join_uneven

#: Groups, and then partial partitions, that meet in one task on average.
BUCKET, FAN = 4096, 512
#: Bytes counted for a row beside its text.
OVERHEAD = 16


def difference(parts: list[np.ndarray], shards: int) -> list[np.ndarray]:
    """For each partial partition, given as sums, the shard that each of its parts ends in.

    Parts that meet become a node of a forest; walking it from the roots gives every leaf its shard.
    """
    children: list[tuple[int, int]] = []
    leaves = len(parts) * shards
    heap = []
    tick = itertools.count()
    for i, sums in enumerate(parts):
        order = np.argsort(-sums, kind="stable")
        nodes = np.where(sums[order] > 0, i * shards + order, -1 - (i * shards + order))
        heapq.heappush(heap, (-int(sums.max() - sums.min()), next(tick), sums[order], nodes))
    empty_fate: list[tuple[np.ndarray, int]] = []
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        b, bn = b[::-1], bn[::-1]
        sums = a + b
        nodes = np.where(an >= 0, an, bn)
        for j in np.flatnonzero((an >= 0) & (bn >= 0)):
            children.append((int(an[j]), int(bn[j])))
            nodes[j] = leaves + len(children) - 1
        order = np.argsort(-sums, kind="stable")
        heapq.heappush(heap, (-int(sums[order[0]] - sums[order[-1]]), next(tick), sums[order], nodes[order]))
    fate = np.zeros(leaves + len(children), np.int32)
    if heap:
        for shard, node in enumerate(heap[0][3]):
            if node >= 0:
                fate[node] = shard
    for k in range(len(children) - 1, -1, -1):
        fate[list(children[k])] = fate[leaves + k]
    return list(fate[:leaves].reshape(-1, shards))


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row; slots are gapless in a shard."""
    raw = blank(text_col).cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).alias("_hash"),
        )
    )
    key = ["_hash", "text_crc32", "size"]
    groups = cut(rows.groupBy(*key).agg((F.count("*") * F.col("size")).alias("_bytes"), F.count("*").alias("_rows")))
    n_groups, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()

    buckets = -(-n_groups // BUCKET) or 1
    dealt = groups.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_bytes", *key], ascending=False)
        parts = []
        for b in frame["_bytes"]:
            parts.append(np.zeros(shards, np.int64))
            parts[-1][0] = b
        return frame.assign(_part=[int(x[0]) for x in difference(parts, shards)])

    # level 0: groups to parts of their bucket
    placed = cut(
        dealt.groupBy("_bucket").applyInPandas(first, "_hash long, text_crc32 long, size long, _bytes long, _rows long, _bucket long, _part int")
    )
    sums = placed.groupBy("_bucket", "_part").agg(F.sum("_bytes").alias("_bytes"))
    fates = []  # by level: (_bucket, _part) to (_up, _fate), and how many there are
    while True:
        ups = -(-buckets // FAN)

        def merge(frame: pd.DataFrame) -> pd.DataFrame:
            out, parts, names = [], [], []
            for bucket, own in frame.sort_values(["_bucket", "_part"]).groupby("_bucket"):
                parts.append(np.zeros(shards, np.int64))
                parts[-1][own["_part"].to_numpy()] = own["_bytes"].to_numpy()
                names.append(bucket)
            for bucket, fate, own in zip(names, difference(parts, shards), parts, strict=True):
                out.append(pd.DataFrame({"_bucket": bucket, "_part": np.arange(shards, dtype=np.int32), "_fate": fate, "_bytes": own}))
            return pd.concat(out).assign(_up=int(frame["_up"].iloc[0]))

        met = cut(
            sums.withColumn("_up", F.pmod(F.xxhash64("_bucket", F.lit(len(fates))), F.lit(ups)))
            .groupBy("_up")
            .applyInPandas(merge, "_bucket long, _part int, _fate int, _bytes long, _up long")
        )
        fates.append((met.select("_bucket", "_part", "_up", "_fate"), buckets * shards))
        if ups <= 1:
            break
        sums = met.groupBy(F.col("_up").alias("_bucket"), F.col("_fate").alias("_part")).agg(F.sum("_bytes").alias("_bytes"))
        buckets = ups
    for level, n in fates:
        placed = placed.join(if_light(level, n, 32), ["_bucket", "_part"]).select(*key, "_rows", F.col("_up").alias("_bucket"), F.col("_fate").alias("_part"))
    assigned = join_uneven(rows, cut(placed.select(*key, "_rows", F.col("_part").alias("shard"))), key, "_rows", n_rows)

    # slots: rows are numbered in small runs of a shard, then moved by the runs before
    runs = max(64, n_rows // 400_000)
    slotted = cut(assigned.withColumn("_run", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(runs))).select("_id", "size", "text_crc32", "shard", "_run"))
    before = Window.partitionBy("shard").orderBy("_run")
    sizes = slotted.groupBy("shard", "_run").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before) - F.col("_n"))
    within = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_id", "size", "text_crc32")) - 1
    return (
        slotted.withColumn("_row", within)
        .join(sizes.drop("_n"), ["shard", "_run"])
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_row") + F.col("_before")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the rows of `docs` in the shards of shard_by_bytes(), a folder each, in slot order."""
    rows = docs.join(placed.select(F.col(id_col).alias("_shard_id"), "shard", "slot"), F.col(id_col).eqNullSafe(F.col("_shard_id")))
    rows.drop("_shard_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
