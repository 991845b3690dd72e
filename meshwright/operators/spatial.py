"""Joins of boxes and points by nearness, as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long")))


def _celled(df: DataFrame, grow: float, cell: float, side: str) -> DataFrame:
    """One row for each cell that the box, grown on all sides, touches."""
    out = df
    for lo, hi, name in (("x0", "x1", "_cx"), ("y0", "y1", "_cy")):
        low, high = F.col(lo) - grow, F.col(hi) + grow
        out = out.withColumn(f"{side}{name}", F.floor(low / cell).cast("long")).withColumn(name, _cells(low, high, cell))
    return out


def box_join(left: DataFrame, right: DataFrame, key: list[str], reach: float, cell: float, gap: str = "axis") -> DataFrame:
    """Pairs of boxes of a key at most `reach` apart: left's columns as l_*, right's as r_*, the key once.

    gap: 'axis' for the largest gap along an axis, 'euclid' for the distance. Both sides have x0, y0, x1, y1.
    Left boxes are grown by the reach; a pair is kept only in the first cell that both touch, so no
    distinct is needed. The cell should not be much smaller than usual boxes, or they touch many.
    """
    a, b = _celled(left, reach, cell, "_l"), _celled(right, 0.0, cell, "_r")
    joint = [*key, "_cx", "_cy"]
    a = a.select(*joint, "_l_cx", "_l_cy", *(F.col(c).alias(f"l_{c}") for c in left.columns if c not in key))
    b = b.select(*joint, "_r_cx", "_r_cy", *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in key))
    first = (F.col("_cx") == F.greatest("_l_cx", "_r_cx")) & (F.col("_cy") == F.greatest("_l_cy", "_r_cy"))
    pairs = a.join(b, joint).where(first).drop("_cx", "_cy", "_l_cx", "_l_cy", "_r_cx", "_r_cy")
    dx = F.greatest(F.lit(0.0), F.col("l_x0") - F.col("r_x1"), F.col("r_x0") - F.col("l_x1"))
    dy = F.greatest(F.lit(0.0), F.col("l_y0") - F.col("r_y1"), F.col("r_y0") - F.col("l_y1"))
    if gap == "axis":
        return pairs.where((dx <= reach) & (dy <= reach))
    return pairs.withColumn("gap", F.sqrt(dx * dx + dy * dy)).where(F.col("gap") <= reach)


def points_in_boxes(points: DataFrame, boxes: DataFrame, key: list[str], cell: float) -> DataFrame:
    """(key, l_* of the point, r_* of the box) for every point (x, y) in a closed box of its key."""
    as_boxes = points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    found = box_join(as_boxes, boxes, key, 0.0, cell)
    return found.drop("l_x0", "l_y0", "l_x1", "l_y1")
