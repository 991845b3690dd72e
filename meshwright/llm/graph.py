"""Connected components of edges that need not fit anywhere in particular."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import remove, stored

#: Counted edges up to which one task finishes them, in some tens of MB.
LOCAL_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the least node reachable) for every node of the edges (a, b), of any type with an order.

    Alternating large-star and small-star rounds: every node links its larger neighbours, then its smaller
    ones, to the least of them, until each component is a star around its least node. A round is two
    aggregations by node; the rounds grow with the logarithm of the longest path. Once the counted edges are
    at most LOCAL_EDGES, one task joins them, with the same result.
    """
    spark, used = edges.sparkSession, []
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = stored(ends.distinct(), used)
    kind = dict(links.dtypes)["u"]
    state, count = None, links.count()
    while count > LOCAL_EDGES:
        # large star: neighbours larger than the node go to the least of its neighbourhood
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, used = used, []
        links = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), used)
        remove(spark, old)
        now = links.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        count = now[0]
        if now == state and now[0] == now[1]:
            stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
    return links.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}")


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union by least node, with path halving."""
    above: dict[Any, Any] = {}

    def top(x: Any) -> Any:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(above), "component": [top(x) for x in above]})
