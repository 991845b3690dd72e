"""Exact top-k inner products over vectors sorted by length, with SVD-rotated partial sums.

The candidates' second moments give an orthogonal rotation that puts most of every product into the first
coordinates. Vectors are dealt by ranges of descending length and met in that order. For a block of
candidates and a query, Cauchy-Schwarz bounds the score three times: by the product of the lengths, which
ends a task for all queries at once when it falls below what they have; by the head of the rotated vectors
plus the product of the lengths of the tails; and what is left is scored exactly, in integers. A candidate
is left out only if its bound is strictly below the k-th best score so far, so ties are whole.

Queries are met in waves of bounded size, each a pass over the candidates; a wave's queries and the best
scores against the longest vectors (a bounded number of these) are what is broadcast.

Defined cases: vectors that are null or hold a null or a number that is not finite take no part, as
queries or as candidates. Shorter vectors count as filled up with zeros. A vector is not its own candidate;
rows that repeat an id are all left out for a query of that id, and each of them is a candidate for others
(and one query). Scores are exact while components stay below 2**25 in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import cut, numbered

#: Queries in a wave; longest vectors that set the first thresholds; candidates in a block; queries in a block.
WAVE, SEEDS, BLOCK, QUERY_BLOCK = 16_384, 2_048, 1_024, 512


def scaled_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x: array of floor(scale * component), norm2) of the vectors that take part."""
    v = F.col(vector_col)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    own = rows.where(v.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))
    return own.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row, ties to smaller ids."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


NONE = -np.inf


class Wave:
    """Queries against blocks of candidates of descending length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, head: int, k: int, floor: np.ndarray) -> None:
        self.ids, self.queries, self.rotation, self.head, self.k = ids, queries, rotation, head, k
        turned = queries @ rotation
        self.heads, self.tails = turned[:, :head], np.sqrt((turned[:, head:] ** 2).sum(1))
        self.norms = np.sqrt((queries**2).sum(1))
        #: What others are known to have: a candidate must reach it.
        self.floor = floor
        self.scores = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> bool:
        """Takes a block in; false if no later block, of shorter vectors, can matter to any query."""
        norms = np.sqrt((x**2).sum(1))
        turned = x @ self.rotation
        heads, tails = turned[:, : self.head], np.sqrt((turned[:, self.head :] ** 2).sum(1))
        longest = norms.max(initial=0.0)
        any_open = False
        for at in range(0, len(self.ids), QUERY_BLOCK):
            part = slice(at, at + QUERY_BLOCK)
            need = np.maximum(self.scores[part, -1], self.floor[part])
            slack = 1e-9 * (self.norms[part] * longest + 1)  # of the rotation's rounding
            open_ = self.norms[part] * longest + slack >= need
            if not open_.any():
                continue
            any_open = True
            q = np.flatnonzero(open_) + at
            bound = self.heads[q] @ heads.T + np.outer(self.tails[q], tails) + slack[open_][:, None]
            hopeful = (bound >= need[open_][:, None]) & (ids[None, :] != self.ids[q][:, None])
            columns = np.flatnonzero(hopeful.any(0))
            if not len(columns):
                continue
            exact = np.where(hopeful[:, columns], self.queries[q] @ x[columns].T, NONE)
            keep = min(self.k, len(columns))
            top, which = _best(exact, np.broadcast_to(ids[columns], exact.shape), keep)
            which = np.where(top == NONE, np.iinfo(np.int64).max, which)
            both, names = np.hstack([self.scores[q], top]), np.hstack([self.found[q], which])
            self.scores[q], self.found[q] = _best(both, names, self.k)
        return any_open

    def rows(self) -> pd.DataFrame:
        got = self.scores > NONE
        query = np.broadcast_to(self.ids[:, None], got.shape)[got]
        return pd.DataFrame({"query_id": query, "vec_id": self.found[got], "score": np.rint(self.scores[got]).astype(np.int64)})


def exact_top_k(
    rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", head: int = 16
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best. Queries: the rows whose id is divisible by `every`."""
    spark = rows.sparkSession
    vectors = cut(scaled_vectors(rows, id_col, vector_col, scale))
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 1

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            x = _matrix(frame["x"], width)
            total += x.T @ x
        i, j = np.indices((width, width)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "v": total.reshape(-1)})

    # a fixed number of sums, whatever the rows
    sums = vectors.select("x").mapInPandas(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    second = np.zeros((width, width))
    second[sums["i"], sums["j"]] = sums["v"]
    rotation = np.linalg.eigh((second + second.T) / 2)[1][:, ::-1].copy()
    head = min(head, width)

    order = [F.col("norm2").desc(), F.col("id")]
    seeds = vectors.orderBy(*order).limit(SEEDS).toPandas()
    seed_ids, seed_x = seeds["id"].to_numpy(np.int64), _matrix(seeds["x"], width)
    ranged = cut(vectors.repartitionByRange(*order).sortWithinPartitions(*order))
    asked = vectors.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id"])
    asked = cut(numbered(asked.select("id", "x"), [F.col("id")], "place").withColumn("wave", F.floor(F.col("place") / WAVE)))
    found = None
    for w in range(-(-asked.count() // WAVE)):
        own = asked.where(F.col("wave") == w).orderBy("place").toPandas()  # WAVE rows at most
        ids, queries = own["id"].to_numpy(np.int64), _matrix(own["x"], width)
        first = Wave(ids, queries, rotation, head, k, np.full(len(ids), NONE))
        for at in range(0, len(seed_ids), BLOCK):
            first.meet(seed_ids[at : at + BLOCK], seed_x[at : at + BLOCK])
        shared = spark.sparkContext.broadcast((ids, queries, rotation, first.scores[:, -1].copy()))

        def task(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, queries, rotation, floor = shared.value
            wave, done = Wave(ids, queries, rotation, head, k, floor), False
            for frame in frames:
                for at in range(0, len(frame), BLOCK):
                    if done:
                        break
                    part = frame.iloc[at : at + BLOCK]
                    done = not wave.meet(part["id"].to_numpy(np.int64), _matrix(part["x"], width))
            yield wave.rows()

        met = ranged.select("id", "x").mapInPandas(task, "query_id long, vec_id long, score long")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
