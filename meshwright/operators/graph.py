"""Connected components and greedy choices on graphs, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshwright.operators.lineage import cut


#: Counted edges up to which one task joins them, in some tens of MB.
LOCAL_EDGES = 200_000


def connected_components(vertices: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """`vertices` with component: the least node reachable over undirected edges; isolated ones are their own.

    Rounds link each node's larger neighbours, then the node and its smaller ones, to the least of them,
    until every component is a star. The rounds grow with the logarithm of the longest path. Once the counted
    edges are at most LOCAL_EDGES, one task joins them, with the same result.
    """
    links = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = cut(links)
    state, stars, count = None, None, links.count()
    while count > LOCAL_EDGES:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state and now[0] == now[1]:
            stars = links.select(F.col("u").alias(node), F.col("v").alias("_c"))
            break
        state, count = now, now[0]
    if stars is None:
        kind = links.schema["u"].dataType
        stars = links.coalesce(1).mapInArrow(_joined, StructType().add(node, kind).add("_c", kind))
    return vertices.join(stars, node, "left").withColumn("component", F.coalesce("_c", node)).drop("_c")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node of its component) of the edges (u, v), by union with path halving."""
    above: dict[Any, Any] = {}
    whole: dict[Any, Any] = {}  # the value of each key: a struct is compared by its fields

    def key(value: Any) -> Any:
        k = tuple(value.values()) if isinstance(value, dict) else value
        whole.setdefault(k, value)
        above.setdefault(k, k)
        return k

    def top(x: Any) -> Any:
        while (up := above[x]) != x:
            above[x] = x = above[up]
        return x

    kind, names = None, ["u", "v"]
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = top(key(u)), top(key(v))
            above[max(x, y)] = min(x, y)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array([whole[k] for k in above], kind), pa.array([whole[top(k)] for k in above], kind)], names)


def greedy_independent(items: DataFrame, conflicts: DataFrame, rank: str = "rank") -> DataFrame:
    """The items a sequential pass in rank order accepts when it skips whoever conflicts with an accepted one.

    items: (item, rank) with distinct ranks. conflicts: symmetric (item, other, other_rank) rows.
    A round accepts the items that precede all their live conflicts and drops these; the outcome is that
    of the sequential pass, in rounds whose number grows slowly unless conflicts form long chains.
    """
    live, accepted = cut(items.select("item", rank)), None
    conflicts = cut(conflicts)
    while True:
        best = conflicts.groupBy("item").agg(F.min("other_rank").alias("_best"))
        won = cut(live.join(best, "item", "left").where(F.col("_best").isNull() | (F.col(rank) < F.col("_best"))).select("item", rank))
        accepted = won if accepted is None else accepted.unionByName(won)
        gone = conflicts.join(won, "item", "left_semi").select(F.col("other").alias("item")).distinct()
        out = cut(won.select("item").unionByName(gone))
        live = cut(live.join(out, "item", "left_anti"))
        if live.isEmpty():
            return accepted
        conflicts = conflicts.join(out, "item", "left_anti")
        conflicts = cut(conflicts.join(out.select(F.col("item").alias("other")), "other", "left_anti"))


def greedy_disjoint(candidates: DataFrame, item: str, handles: str, order: list, group: list[str]) -> DataFrame:
    """The candidates accepted in order such that no two of a group share a handle (an array column)."""
    from pyspark.sql import Window

    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    own = ranked.select(*group, F.col(item).alias("item"), "rank", F.explode(F.array_distinct(handles)).alias("_h"))
    other = own.select(*group, "_h", F.col("item").alias("other"), F.col("rank").alias("other_rank"))
    conflicts = own.join(other, [*group, "_h"]).where("item <> other").select("item", "other", "other_rank").distinct()
    chosen = greedy_independent(ranked.select(F.col(item).alias("item"), "rank"), conflicts)
    return ranked.join(chosen.select(F.col("item").alias(item)), item, "left_semi")


def leader_clusters(items: DataFrame, near: DataFrame, item: str, rank: str = "rank") -> DataFrame:
    """(item, leader): in rank order an item joins the first leader near it, or becomes one itself.

    near: symmetric (item, other, other_rank) pairs within the tolerance. Not transitive.
    """
    own = items.select(F.col(item).alias("item"), rank)
    leaders = cut(greedy_independent(own, near, rank).select("item"))
    joined = near.join(leaders.select(F.col("item").alias("other")), "other").groupBy("item").agg(F.min_by("other", "other_rank").alias("leader"))
    rest = own.join(leaders, "item", "left_anti").join(joined, "item").select("item", "leader")
    return leaders.select("item", F.col("item").alias("leader")).unionByName(rest)
