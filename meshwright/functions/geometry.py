"""Column functions of plane geometry. Points are structs (x, y); boxes have x0, y0, x1, y1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances in multiples of the drawing's unit H, and the angle that still counts as along an axis.
CANONICAL_H = 100.0
ENDPOINT_SNAP_H = 0.10
TERMINAL_ATTACH_H = 0.20
MINIMUM_WIRE_H = 1.50
CURVE_FLATTEN_H = 0.025
DOT_RADIUS_H = 0.35
T_JUNCTION_H = 0.25
AXIS_ANGLE_DEGREES = 1.0
INITIAL_GROUP_GAP_H = 0.25
NEARBY_LINE_H = 5.0

AXIS_SINE = math.sin(math.radians(AXIS_ANGLE_DEGREES))
AXIS_TANGENT = math.tan(math.radians(AXIS_ANGLE_DEGREES))


def let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def length(dx: Column, dy: Column) -> Column:
    """Square root of a sum of squares: the same bits in any engine, unlike hypot."""
    return F.sqrt(dx * dx + dy * dy)


def distance(a: Column, b: Column) -> Column:
    return length(a["x"] - b["x"], a["y"] - b["y"])


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def along_axis(dx: Column, dy: Column) -> tuple[Column, Column]:
    """(horizontal, vertical), within the axis angle."""
    x, y = F.abs(dx), F.abs(dy)
    return y <= F.greatest(F.lit(1e-9), x * AXIS_TANGENT), x <= F.greatest(F.lit(1e-9), y * AXIS_TANGENT)


def project(p: Column, a: Column, b: Column) -> Column:
    """(gap, x, y, t) of a point on a segment, t clamped to it; a segment without length is its start."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    raw = F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, square)
    t = F.when(square <= 1e-18, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    x, y = a["x"] + t * dx, a["y"] + t * dy
    return F.struct(length(p["x"] - x, p["y"] - y).alias("gap"), x.alias("x"), y.alias("y"), t.alias("t"))


def interval_distance(value: Column, low: Column, high: Column) -> Column:
    return F.when((value >= low) & (value <= high), F.lit(0.0)).otherwise(F.least(F.abs(value - low), F.abs(value - high)))


def boundary_ports(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Midpoints of a box's sides: top, bottom, left, right."""
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return F.array(point(cx, y1), point(cx, y0), point(x0, cy), point(x1, cy))


def sample_line(a: Column, b: Column, count: int = 48) -> Column:
    step = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(step, lambda i: point(a["x"] + (i / (count - 1)) * (b["x"] - a["x"]), a["y"] + (i / (count - 1)) * (b["y"] - a["y"])))


def sample_circle(center: Column, radius: Column, count: int = 96) -> Column:
    step = F.sequence(F.lit(0), F.lit(count - 1))
    turn = 2 * math.pi / count
    return F.transform(step, lambda i: point(center["x"] + radius * F.cos(i * turn), center["y"] + radius * F.sin(i * turn)))


def sample_polyline(vertices: Column, closed: Column, per_edge: int = 32) -> Column:
    """Every edge sampled; a closed line repeats its first vertex unless it already ends there."""
    first, last = F.element_at(vertices, 1), F.element_at(vertices, -1)
    ring = F.when(closed & (first != last), F.concat(vertices, F.array(first))).otherwise(vertices)
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(ring) < 2, F.array().cast("array<struct<x:double,y:double>>")).otherwise(
        F.flatten(F.transform(edges, lambda e: sample_line(e["a"], e["b"], per_edge)))
    )


def _each(points: Column, coordinate: str) -> Column:
    return F.transform(points, lambda p: p[coordinate])


def bounds(points: Column) -> tuple[Column, Column, Column, Column]:
    return F.array_min(_each(points, "x")), F.array_min(_each(points, "y")), F.array_max(_each(points, "x")), F.array_max(_each(points, "y"))


def normalised(points: Column) -> Column:
    """Centred on the box and divided by its longer side."""

    def scaled(b: Column) -> Column:
        scale = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(1e-12))
        cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
        frame = F.struct(b["p"].alias("p"), cx.alias("x"), cy.alias("y"), scale.alias("s"))
        return let(frame, lambda f: F.transform(f["p"], lambda p: point(F.try_divide(p["x"] - f["x"], f["s"]), F.try_divide(p["y"] - f["y"], f["s"]))))

    return let(points, lambda p: let(F.struct(p.alias("p"), *(v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), bounds(p), strict=True))), scaled))


#: The quarter turns and their mirror images, as 2 x 2 matrices by row.
DIHEDRAL = {
    "rotate_0": (1, 0, 0, 1),
    "rotate_90": (0, -1, 1, 0),
    "rotate_180": (-1, 0, 0, -1),
    "rotate_270": (0, 1, -1, 0),
    "mirror_x+rotate_0": (-1, 0, 0, 1),
    "mirror_x+rotate_90": (0, -1, -1, 0),
    "mirror_x+rotate_180": (1, 0, 0, -1),
    "mirror_x+rotate_270": (0, 1, 1, 0),
}


def dihedral(points: Column) -> Column:
    """Array of (transform, points), one for each of the eight."""

    def turned(m: tuple[int, int, int, int]) -> Column:
        return F.transform(points, lambda p: point(m[0] * p["x"] + m[1] * p["y"], m[2] * p["x"] + m[3] * p["y"]))

    return F.array(*(F.struct(F.lit(name).alias("transform"), turned(m).alias("points")) for name, m in DIHEDRAL.items()))


def downsampled(points: Column, most: int) -> Column:
    """Points at equally spaced indices, cut to integers, if there are more than `most`."""

    def picked(p: Column) -> Column:
        n = F.size(p)
        some = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(p, (F.floor(i * (n - 1) / (most - 1)) + 1).cast("int")))
        return F.when(n <= most, p).otherwise(some)

    return let(points, picked)


def mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def centred(points: Column) -> Column:
    """Moved so that the mean is the origin."""

    def moved(p: Column) -> Column:
        mean = F.struct(p.alias("p"), mean_of(_each(p, "x")).alias("x"), mean_of(_each(p, "y")).alias("y"))
        return let(mean, lambda m: F.transform(m["p"], lambda q: point(q["x"] - m["x"], q["y"] - m["y"])))

    return let(points, moved)


def radial_descriptor(points: Column, bins: int = 16) -> Column:
    """Shares of the points' distances from their mean, in equal bins up to the largest; the last bin is closed."""

    def binned(radii: Column) -> Column:
        largest = F.struct(radii.alias("r"), F.greatest(F.array_max(radii), F.lit(1e-12)).alias("m"))
        return let(largest, lambda f: F.transform(f["r"], lambda r: F.least(F.floor(F.try_divide(r, f["m"]) * bins), F.lit(bins - 1)).cast("int")))

    def shares(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(at, lambda a: a == k)) / F.greatest(F.size(at), F.lit(1)))

    radii = F.transform(centred(points), lambda p: length(p["x"], p["y"]))
    return let(let(radii, binned), shares)


def _moments(c: Column) -> Column:
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("xx", "yy", "xy")))
    return F.aggregate(
        c, zero, lambda a, p: F.struct((a["xx"] + p["x"] * p["x"]).alias("xx"), (a["yy"] + p["y"] * p["y"]).alias("yy"), (a["xy"] + p["x"] * p["y"]).alias("xy"))
    )


def principal_angle(points: Column) -> Column:
    """Of the axis of most variance, from the second moments; arbitrary where both are equal."""
    return let(_moments(centred(points)), lambda m: F.atan2(2 * m["xy"], m["xx"] - m["yy"]) / 2)


def axis_aligned(points: Column) -> Column:
    """Centred and turned so that the axis of most variance lies along x. Scale stays."""

    def turned(c: Column) -> Column:
        angle = let(_moments(c), lambda m: F.atan2(2 * m["xy"], m["xx"] - m["yy"]) / 2)
        frame = let(angle, lambda a: F.struct(c.alias("p"), F.cos(-a).alias("c"), F.sin(-a).alias("s")))
        return let(frame, lambda f: F.transform(f["p"], lambda p: point(p["x"] * f["c"] - p["y"] * f["s"], p["x"] * f["s"] + p["y"] * f["c"])))

    return let(centred(points), turned)


def multiset_similarity(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Sum of least over sum of largest counts of two maps; `empty` where both have none."""
    # map_zip_with fills a missing key with null
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y")))
    low = F.aggregate(F.map_values(both), F.lit(0).cast("long"), lambda s, v: s + F.least(v["x"], v["y"]))
    high = F.aggregate(F.map_values(both), F.lit(0).cast("long"), lambda s, v: s + F.greatest(v["x"], v["y"]))
    return F.coalesce(F.try_divide(low, high), F.lit(empty))
