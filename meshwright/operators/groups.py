"""Groups of shapes that may be one symbol: growing them, and candidates with a stub of a nearby line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import geometry as g
from meshwright.operators.lineage import cut
from meshwright.operators.spatial import box_join

#: Shapes of a grown group, rounds of growth, and lengths of stubs by the size of what they touch.
MOST, ROUNDS = 24, 2
CIRCLE_STUBS, POLYGON_STUBS = (0.75, 1.0, 1.125, 1.25, 1.5), (0.75, 1.0, 1.25, 1.5)


def _box_of(members: DataFrame) -> DataFrame:
    return members.groupBy("drawing", "group").agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"), F.count("*").alias("held"))


def expand_groups(groups: DataFrame, shapes: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, group, shape): groups with the parts of their symbol that lie near, in two rounds.

    groups: (drawing, group, shape); shapes: (drawing, shape, kind, closed, length, annotation, x0, y0, x1, y1). What
    is near grows with the group: a gap of 0.3 of its size, and a centre within 1.8 of it. Closed or curved parts join, and
    short lines. A group takes its nearest parts up to 24 shapes; one that finds none in a round stays as it is.
    """
    own = cut(groups.select("drawing", "group", "shape").distinct())
    for _ in range(ROUNDS):
        box = _box_of(own.join(shapes, ["drawing", "shape"]))
        scale = F.greatest(F.col("c") - F.col("a"), F.col("d") - F.col("b"), F.lit(h))
        box = box.withColumns({"scale": scale, "mx": (F.col("a") + F.col("c")) / 2, "my": (F.col("b") + F.col("d")) / 2}).withColumn("reach", F.greatest(F.lit(0.15 * h), F.col("scale") * 0.3))
        # the boxes are grown by their own reach, so that a grid finds what may be near
        grown = box.where(F.col("held") < MOST).select("*", *((F.col(c) + F.col("reach") * side).alias(n) for c, side, n in (("a", -1, "x0"), ("b", -1, "y0"), ("c", 1, "x1"), ("d", 1, "y1"))))
        met = box_join(shapes.where("not annotation"), grown, ["drawing"], 0.0, 10 * h)
        kept = [F.col(f"l_{c}").alias(c) for c in shapes.columns if c != "drawing"]
        near = met.select("drawing", *kept, *(F.col(f"r_{c}").alias(c) for c in box.columns if c != "drawing"))
        dx = F.greatest(F.lit(0.0), F.col("x0") - F.col("c"), F.col("a") - F.col("x1"))
        dy = F.greatest(F.lit(0.0), F.col("y0") - F.col("d"), F.col("b") - F.col("y1"))
        cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        near = near.withColumns({"gap": g.length(dx, dy), "away": g.length(cx - F.col("mx"), cy - F.col("my"))}).where("gap <= reach and away <= scale * 1.8")
        flat, upright = g.along_axis(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        line = F.col("kind").isin("line", "polyline") & ~F.col("closed")
        part = F.col("kind").isin("circle", "polygon", "arc") | F.col("closed") | (line & (F.col("length") <= F.col("scale") * F.when(flat | upright, 1.5).otherwise(1.0)))
        beside = ((F.col("x0") <= F.col("c") + F.col("reach")) & (F.col("x1") >= F.col("a") - F.col("reach"))) | ((F.col("y0") <= F.col("d") + F.col("reach")) & (F.col("y1") >= F.col("b") - F.col("reach")))
        fresh = near.where(part & beside).join(own, ["drawing", "group", "shape"], "left_anti")
        place = F.row_number().over(Window.partitionBy("drawing", "group").orderBy("gap", "away", "length", "shape"))
        taken = fresh.withColumn("place", place).where(F.col("place") <= MOST - F.col("held"))
        own = cut(own.unionByName(taken.select("drawing", "group", "shape")))
    return own


def stub(start: Column, end: Column, gap: Column, other_gap: Column, most_gap: Column, length: Column) -> Column:
    """The part of a line that begins at its end nearer to a symbol, cut to a length; null if that end is too far.

    gap, other_gap: of the line's start and end from the symbol. The start wins a tie.
    """
    first = gap <= other_gap
    near, far = F.when(first, start).otherwise(end), F.when(first, end).otherwise(start)

    def clipped(s: Column) -> Column:
        whole = g.distance(s["far"], s["near"])
        share = F.try_divide(F.least(length, whole), whole)
        tip = g.point(s["near"]["x"] + share * (s["far"]["x"] - s["near"]["x"]), s["near"]["y"] + share * (s["far"]["y"] - s["near"]["y"]))
        return F.when(whole > 1e-12, F.struct(s["near"].alias("a"), tip.alias("b")))

    return F.when(F.least(gap, other_gap) <= most_gap, g.let(F.struct(near.alias("near"), far.alias("far")), clipped))


def circle_pairs(circles: DataFrame) -> DataFrame:
    """(group, left, right, radius): circles of one group about as large, whose centres are about a radius apart.

    circles: (group, shape, center, radius).
    """
    a = circles.select("group", F.col("shape").alias("left"), F.col("center").alias("lc"), F.col("radius").alias("lr"))
    b = circles.select("group", F.col("shape").alias("right"), F.col("center").alias("rc"), F.col("radius").alias("rr"))
    mean = (F.col("lr") + F.col("rr")) / 2
    alike = F.abs(F.col("lr") - F.col("rr")) / F.greatest("lr", "rr") <= 0.15
    apart = F.abs(g.distance(F.col("lc"), F.col("rc")) / mean - 1) <= 0.35
    return a.join(b, "group").where("left < right").where(alike & apart).select("group", "left", "right", "lc", "rc", "lr", "rr", mean.alias("radius"))


def circle_stubs(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(group, left, right, line, ratio, stub): pairs of circles with a stub of a line of their group that touches one.

    lines: (group, line, a, b). The stub begins at the end nearer to a rim, within a fifth of the mean radius.
    """
    met = pairs.join(lines, "group")
    rim = lambda p: F.least(F.abs(g.distance(p, F.col("lc")) - F.col("lr")), F.abs(g.distance(p, F.col("rc")) - F.col("rr")))
    ratio = F.explode(F.array(*map(F.lit, CIRCLE_STUBS))).alias("ratio")
    met = met.select("*", rim(F.col("a")).alias("ga"), rim(F.col("b")).alias("gb"), ratio)
    cut_ = stub(F.col("a"), F.col("b"), F.col("ga"), F.col("gb"), F.col("radius") * 0.2, F.col("radius") * F.col("ratio"))
    return met.select("group", "left", "right", "line", "ratio", cut_.alias("stub")).where("stub is not null")


def polygon_stubs(polygons: DataFrame, lines: DataFrame) -> DataFrame:
    """(group, shape, line, ratio, stub): polygons (group, shape, points, scale) with a stub of a line that touches their outline."""
    met = polygons.join(lines, "group")
    to = lambda p: F.array_min(F.transform("points", lambda q: g.distance(p, q)))
    ratio = F.explode(F.array(*map(F.lit, POLYGON_STUBS))).alias("ratio")
    met = met.select("group", "shape", "line", "a", "b", "scale", to(F.col("a")).alias("ga"), to(F.col("b")).alias("gb"), ratio)
    cut_ = stub(F.col("a"), F.col("b"), F.col("ga"), F.col("gb"), F.col("scale") * 0.2, F.col("scale") * F.col("ratio"))
    return met.select("group", "shape", "line", "ratio", cut_.alias("stub")).where("stub is not null")


def attach_labels(things: DataFrame, labels: DataFrame, reach: float) -> DataFrame:
    """(drawing, thing, label, distance): in the order of x and y each thing takes its nearest label that is left.

    things: (drawing, thing, x, y); labels: (drawing, label, x, y). The order decides, so a drawing is one group;
    drawings are many and small.
    """
    import pandas as pd

    def task(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        near = near.sort_values("label")
        for t in own.sort_values(["x", "y", "thing"]).itertuples():
            gaps = [(((t.x - m.x) ** 2 + (t.y - m.y) ** 2) ** 0.5, m.label) for m in near.itertuples() if m.label not in used]
            gaps = [p for p in gaps if p[0] <= reach]
            if gaps:
                gap, label = min(gaps, key=lambda p: p[0])
                used.add(label)
                out.append((key[0], t.thing, label, gap))
        return pd.DataFrame(out, columns=["drawing", "thing", "label", "distance"])

    kinds = dict(things.dtypes) | {"label": dict(labels.dtypes)["label"]}
    schema = f"drawing {kinds['drawing']}, thing {kinds['thing']}, label {kinds['label']}, distance double"
    left, right = things.select("drawing", "thing", "x", "y"), labels.select("drawing", "label", "x", "y")
    return left.groupBy("drawing").cogroup(right.groupBy("drawing")).applyInPandas(task, schema)
