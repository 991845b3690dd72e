"""The conductor graph of a drawing: segments, how they meet, nodes, terminals, device edges.

segments: (drawing, segment, evidence, x1, y1, x2, y2), `segment` a number in drawing order. Tolerances are
multiples of h, the drawing's unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import geometry as g
from meshwright.operators.graph import connected_components
from meshwright.operators.keys import first_wins, quantised, top_k_per
from meshwright.operators.spatial import box_join


def with_properties(segments: DataFrame) -> DataFrame:
    """`segments` with length, horizontal, vertical and the box."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    horizontal, vertical = g.along_axis(dx, dy)
    return segments.withColumns(
        {
            "length": g.length(dx, dy),
            "horizontal": horizontal,
            "vertical": vertical,
            "x0": F.least("x1", "x2"),
            "y0": F.least("y1", "y2"),
            "bx1": F.greatest("x1", "x2"),
            "by1": F.greatest("y1", "y2"),
        }
    )


def dedupe_segments(segments: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """Segments no shorter than a wire, the first of those with the same rounded ends in either direction."""
    q = max(h * 0.01, 1e-8)
    a, b = (g.point(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2))
    lo, hi = F.least(a, b), F.greatest(a, b)
    keyed = segments.where(g.length(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= h * g.MINIMUM_WIRE_H)
    keys = {f"_k{i}": quantised(v, q) for i, v in enumerate((lo["x"], lo["y"], hi["x"], hi["y"]))}
    return first_wins(keyed.withColumns(keys), ["drawing", *keys], ["segment"]).drop(*keys)


def pair_events(segments: DataFrame, h: float = g.CANONICAL_H, markers: DataFrame | None = None, marked: Column | None = None) -> DataFrame:
    """(drawing, left, right, left_evidence, right_evidence, kind, x, y, joined) for pairs that meet.

    kind is the first that holds: endpoint_connection, collinear (joined without a point of its own),
    t_junction, x_connected (a marker at the crossing), x_not_connected. Markers are points
    (drawing, x, y), or a condition on the crossing's x and y.
    """
    snap, slack = h * g.ENDPOINT_SNAP_H, h * g.T_JUNCTION_H
    boxed = segments.withColumns({"x0": F.least("x1", "x2"), "y0": F.least("y1", "y2"), "_bx": F.greatest("x1", "x2"), "_by": F.greatest("y1", "y2")})
    boxed = boxed.select("drawing", "segment", "evidence", "x0", "y0", F.col("_bx").alias("x1"), F.col("_by").alias("y1"), F.col("x1").alias("sx"), F.col("y1").alias("sy"), F.col("x2").alias("ex"), F.col("y2").alias("ey"))
    pairs = box_join(boxed, boxed, ["drawing"], slack, 10 * h).where("l_segment < r_segment")
    c = F.col
    ends = []
    for a in ("s", "e"):
        for b in ("s", "e"):
            ax, ay, bx, by = c(f"l_{a}x"), c(f"l_{a}y"), c(f"r_{b}x"), c(f"r_{b}y")
            ends.append(F.struct(g.length(ax - bx, ay - by).alias("gap"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")))
    lx, ly, rx, ry = c("l_ex") - c("l_sx"), c("l_ey") - c("l_sy"), c("r_ex") - c("r_sx"), c("r_ey") - c("r_sy")
    ox, oy = c("r_sx") - c("l_sx"), c("r_sy") - c("l_sy")
    pairs = pairs.withColumns({"end": F.array_min(F.array(*ends)), "ll": g.length(lx, ly), "rl": g.length(rx, ry), "det": g.cross(lx, ly, rx, ry)})
    # along the left one: where the right one's ends fall. Each step is a column, so that no expression repeats another
    ux, uy = F.try_divide(lx, c("ll")), F.try_divide(ly, c("ll"))
    pairs = pairs.withColumns(
        {
            "p1": (c("r_sx") - c("l_sx")) * ux + (c("r_sy") - c("l_sy")) * uy,
            "p2": (c("r_ex") - c("l_sx")) * ux + (c("r_ey") - c("l_sy")) * uy,
            "beside": F.abs(g.cross(ox, oy, lx, ly)) / F.greatest(c("ll"), F.lit(1e-12)),
            "lt": F.try_divide(g.cross(ox, oy, rx, ry), c("det")),
            "rt": F.try_divide(g.cross(ox, oy, lx, ly), c("det")),
            "ls": slack / F.greatest(c("ll"), F.lit(1e-12)),
            "rs": slack / F.greatest(c("rl"), F.lit(1e-12)),
        }
    )
    pairs = pairs.withColumns(
        {
            "parallel": F.abs("det") <= c("ll") * c("rl") * g.AXIS_SINE,
            "overlap": (c("beside") <= snap) & (F.greatest(F.lit(0.0), F.least("p1", "p2")) <= F.least(c("ll"), F.greatest("p1", "p2")) + snap),
            "crosses": c("lt").between(-c("ls"), 1 + c("ls")) & c("rt").between(-c("rs"), 1 + c("rs")),
            "cx": c("l_sx") + c("lt") * lx,
            "cy": c("l_sy") + c("lt") * ly,
        }
    )
    to = lambda x, y: g.length(c("cx") - c(x), c("cy") - c(y))
    pairs = pairs.withColumn("to_end", F.least(to("l_sx", "l_sy"), to("l_ex", "l_ey"), to("r_sx", "r_sy"), to("r_ex", "r_ey")))
    near_end = c("to_end") <= slack
    kind = (
        F.when(c("end.gap") <= snap, "endpoint_connection")
        .when(c("parallel"), F.when(c("overlap"), "collinear"))
        .when(c("crosses"), F.when(near_end, "t_junction").otherwise("x"))
    )
    met = pairs.withColumn("kind", kind).where("kind is not null")
    at_end = c("kind") == "endpoint_connection"
    no_point = c("kind") == "collinear"
    met = met.select(
        "drawing",
        c("l_segment").alias("left"),
        c("r_segment").alias("right"),
        c("l_evidence").alias("left_evidence"),
        c("r_evidence").alias("right_evidence"),
        "kind",
        F.when(at_end, (c("end.ax") + c("end.bx")) / 2).when(~no_point, c("cx")).alias("x"),
        F.when(at_end, (c("end.ay") + c("end.by")) / 2).when(~no_point, c("cy")).alias("y"),
    )
    if markers is not None:
        at = markers.select("drawing", *(F.col(a).alias(b) for a, b in (("x", "x0"), ("y", "y0"), ("x", "x1"), ("y", "y1"))))
        crossings = met.where("kind = 'x'").select("drawing", "left", "right", c("x").alias("x0"), c("y").alias("y0"), c("x").alias("x1"), c("y").alias("y1"))
        hits = box_join(crossings, at, ["drawing"], snap, 10 * h, gap="euclid").select("drawing", c("l_left").alias("left"), c("l_right").alias("right")).distinct()
        met = met.join(hits.withColumn("_marked", F.lit(True)), ["drawing", "left", "right"], "left")
        marked = F.coalesce("_marked", F.lit(False))
    connected = F.lit(False) if marked is None else marked
    kind = F.when(c("kind") != "x", c("kind")).otherwise(F.when(connected, "x_connected").otherwise("x_not_connected"))
    return met.withColumn("kind", kind).withColumn("joined", c("kind") != "x_not_connected").drop("_marked")


def conductor_components(segments: DataFrame, events: DataFrame) -> DataFrame:
    """(drawing, segment, root): segments joined by events, by the least segment of their component."""
    vertices = segments.select("drawing", "segment").withColumn("node", F.struct("drawing", "segment"))
    edges = events.where("joined").select(F.struct("drawing", F.col("left").alias("segment")).alias("a"), F.struct("drawing", F.col("right").alias("segment")).alias("b"))
    found = connected_components(vertices, edges)
    return found.select("drawing", "segment", F.col("component.segment").alias("root"))


def distinct_events(events: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """Events with a point, the first pair of those of one kind at one rounded point, with state and handles."""
    q = max(h * 0.005, 1e-8)
    own = events.where("x is not null").withColumns({"_qx": quantised(F.col("x"), q), "_qy": quantised(F.col("y"), q)})
    first = first_wins(own, ["drawing", "kind", "_qx", "_qy"], ["left", "right"]).drop("_qx", "_qy")
    state = F.when(F.col("joined"), "connected").otherwise("not_connected")
    return first.withColumn("state", state).withColumn("handles", F.array_sort(F.array_distinct(F.array("left_evidence", "right_evidence"))))


#: Which event speaks for a point where several meet.
EVENT_PRIORITY = {"t_junction": 5, "endpoint_connection": 4, "x_connected": 3, "x_not_connected": 1}


def merge_events(events: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, kind, x, y, state, handles, raw_kinds, raw_states, conflict): one event a rounded point.

    The event of highest priority speaks, the first of these; any connected one connects the point.
    """
    q = max(h * 0.02, 1e-8)
    priority = F.coalesce(F.create_map(*(F.lit(x) for kv in EVENT_PRIORITY.items() for x in kv))[F.col("kind")], F.lit(0))
    own = events.withColumns({"_qx": quantised(F.col("x"), q), "_qy": quantised(F.col("y"), q)})
    best = F.min_by(F.struct("kind", "x", "y"), F.struct(-priority, (F.col("state") != "connected"), "left", "right"))
    merged = own.groupBy("drawing", "_qx", "_qy").agg(
        best.alias("b"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("handles")))).alias("handles"),
        F.array_sort(F.collect_set("kind")).alias("raw_kinds"),
        F.array_sort(F.collect_set("state")).alias("raw_states"),
    )
    state = F.when(F.array_contains("raw_states", "connected"), "connected").otherwise("not_connected")
    return merged.select("drawing", "b.*", state.alias("state"), "handles", "raw_kinds", "raw_states", (F.size("raw_states") > 1).alias("conflict"))


def nearest_segments(equipment: DataFrame, segments: DataFrame) -> DataFrame:
    """(drawing, equipment, port, px, py, segment, gap, qx, qy): each boundary port's nearest segment.

    equipment: (drawing, equipment, x0, y0, x1, y1). Ports number 0 to 3: top, bottom, left, right. Ties go
    to the first segment. The search is within the drawing, and the aggregation keeps one row a port and task.
    """
    ports = equipment.select("drawing", "equipment", F.posexplode(g.boundary_ports(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).alias("port", "p"))
    ports = ports.select("drawing", "equipment", "port", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    # each step is a column, so that no expression repeats another and the stage's code stays small
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    lines = segments.select("drawing", "segment", "x1", "y1", dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("square"))
    raw = F.try_divide((F.col("px") - F.col("x1")) * F.col("dx") + (F.col("py") - F.col("y1")) * F.col("dy"), F.col("square"))
    met = ports.join(lines, "drawing").withColumn("t", F.when(F.col("square") <= 1e-18, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))))
    # along an axis the port's own coordinate is kept: t * dx would round it, and gaps that are equal would differ
    straight = ((F.col("dx") == 0) | (F.col("dy") == 0)) & (F.col("square") > 1e-18)

    def foot(p: str, a: str, d: str) -> Column:
        start, end = F.col(a), F.col(a) + F.col(d)
        kept = F.greatest(F.least(start, end), F.least(F.greatest(start, end), F.col(p)))
        return F.when(straight, kept).otherwise(start + F.col("t") * F.col(d))

    met = met.withColumns({"qx": foot("px", "x1", "dx"), "qy": foot("py", "y1", "dy")})
    met = met.withColumn("gap", g.length(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")))
    near = met.groupBy("drawing", "equipment", "port", "px", "py").agg(F.min(F.struct("gap", "segment", "qx", "qy")).alias("n"))
    return near.select("drawing", "equipment", "port", "px", "py", "n.segment", "n.gap", "n.qx", "n.qy")


def attach_terminals(equipment: DataFrame, segments: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """nearest_segments() rows chosen as terminals, with rank and confidence ('high', 'review' or 'too_far').

    equipment has terminal_count, clamped to 1..4. Ports come by gap; a segment serves one port, unless it
    is the drawing's only one. Those too far away are issues, not terminals.
    """
    near = nearest_segments(equipment, segments)
    lines = segments.groupBy("drawing").agg(F.count("*").alias("_lines"))
    per = Window.partitionBy("drawing", "equipment", "segment").orderBy("gap", "port")
    own = near.join(lines, "drawing").withColumn("_first", F.row_number().over(per)).where("_first = 1 or _lines = 1")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("drawing", "equipment").orderBy("gap", "port")))
    count = F.greatest(F.lit(1), F.least(F.col("terminal_count").cast("int"), F.lit(4)))
    chosen = ranked.join(equipment.select("drawing", "equipment", count.alias("_count")), ["drawing", "equipment"]).where("rank <= _count")
    confidence = F.when(F.col("gap") > 2 * h, "too_far").when(F.col("gap") <= h * g.TERMINAL_ATTACH_H, "high").otherwise("review")
    return chosen.withColumn("confidence", confidence).drop("_lines", "_first", "_count")


def connectivity(terminals: DataFrame, components: DataFrame, segments: DataFrame) -> DataFrame:
    """(drawing, root, equipment, terminals, handles): components that have terminals, as nodes."""
    own = terminals.where("confidence <> 'too_far'").join(components, ["drawing", "segment"])
    nodes = own.groupBy("drawing", "root").agg(F.array_sort(F.collect_set("equipment")).alias("equipment"), F.count("*").alias("terminals"))
    handles = components.join(segments.select("drawing", "segment", "evidence"), ["drawing", "segment"])
    handles = handles.groupBy("drawing", "root").agg(F.array_sort(F.collect_set("evidence")).alias("handles"))
    return nodes.join(handles, ["drawing", "root"])


def device_edges(nodes: DataFrame) -> DataFrame:
    """(drawing, root, source, target): pairs of devices at one node, the lesser id first."""
    a = nodes.select("drawing", "root", F.explode("equipment").alias("source"))
    b = nodes.select("drawing", "root", F.explode("equipment").alias("target"))
    return a.join(b, ["drawing", "root"]).where("source < target")


def active_events(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with a handle any segment of which is in a component with terminals."""
    live = nodes.select("drawing", F.explode("handles").alias("handle")).distinct()
    keyed = events.withColumn("_id", F.struct("kind", "left", "right"))
    hit = keyed.select("drawing", "_id", F.explode("handles").alias("handle")).join(live, ["drawing", "handle"], "left_semi").select("drawing", "_id").distinct()
    return keyed.join(hit, ["drawing", "_id"], "left_semi").drop("_id")


def shape_clusters(shapes: DataFrame, h: float = g.CANONICAL_H, reach: float = g.INITIAL_GROUP_GAP_H) -> DataFrame:
    """(drawing, shape, group): shapes whose boxes are within the reach, joined; by the least shape."""
    pairs = box_join(shapes, shapes, ["drawing"], reach * h, 10 * h, gap="euclid").where("l_shape < r_shape")
    vertices = shapes.select("drawing", "shape").withColumn("node", F.struct("drawing", "shape"))
    edges = pairs.select(F.struct("drawing", F.col("l_shape").alias("shape")).alias("a"), F.struct("drawing", F.col("r_shape").alias("shape")).alias("b"))
    found = connected_components(vertices, edges)
    return found.select("drawing", "shape", F.col("component.shape").alias("group"))


def local_windows(shapes: DataFrame, anchors: DataFrame, h: float = g.CANONICAL_H, most: int = 12) -> DataFrame:
    """(drawing, anchor, shapes): each anchor's nearest shapes within 2 H of its box and 6 H of its centre.

    Windows of the same shapes are one, named by the first anchor.
    """
    pairs = box_join(anchors, shapes, ["drawing"], 2 * h, 10 * h, gap="euclid")
    mid = lambda s, a: (F.col(f"{s}_{a}0") + F.col(f"{s}_{a}1")) / 2
    pairs = pairs.withColumn("centre_gap", g.length(mid("l", "x") - mid("r", "x"), mid("l", "y") - mid("r", "y"))).where(F.col("centre_gap") <= 6 * h)
    near = top_k_per(pairs, ["drawing", "l_shape"], [F.col("gap"), F.col("centre_gap"), F.col("r_shape")], most)
    sets = near.groupBy("drawing", F.col("l_shape").alias("anchor")).agg(F.array_sort(F.collect_list("r_shape")).alias("shapes"))
    return sets.groupBy("drawing", "shapes").agg(F.min("anchor").alias("anchor"))


def bus_growth(buses: DataFrame, primaries: DataFrame, same: float, reach: float) -> DataFrame:
    """(drawing, label, segment): the buses that belong to each primary one.

    buses: (drawing, segment, y, x0, x1). primaries: (drawing, label, segment). Buses at the primary's height
    join while the gap to the hull so far is within the reach, which is the island that holds the primary.
    """
    from meshwright.operators.intervals import islands

    primary = buses.join(primaries, ["drawing", "segment"]).select("drawing", "label", F.col("segment").alias("primary"), F.col("y").alias("py"))
    level = buses.join(primary, "drawing").where(F.abs(F.col("y") - F.col("py")) <= same)
    run = islands(level, ["drawing", "label"], "x0", "x1", reach)
    own = run.where("segment = primary").select("drawing", "label", "island")
    return run.join(own, ["drawing", "label", "island"], "left_semi").select("drawing", "label", "segment")


def container_clusters(containers: DataFrame, segments: DataFrame, components: DataFrame, h: float = g.CANONICAL_H, reach: float = 2.0, band: float = 50.0) -> DataFrame:
    """(drawing, container, cluster): containers that a conductor touches both of, in one band of the drawing.

    containers: (drawing, container, x0, y0, x1, y1). Touching counts within `reach` H; the centres of two that
    join are at most `band` H apart in height.
    """
    boxes = segments.select("drawing", "segment", F.least("x1", "x2").alias("x0"), F.least("y1", "y2").alias("y0"), F.greatest("x1", "x2").alias("x1"), F.greatest("y1", "y2").alias("y1"))
    touch = box_join(containers, boxes, ["drawing"], reach * h, 10 * h).select(
        "drawing", F.col("l_container").alias("container"), ((F.col("l_y0") + F.col("l_y1")) / 2).alias("cy"), F.col("r_segment").alias("segment")
    )
    roots = touch.join(components, ["drawing", "segment"]).select("drawing", "root", "container", "cy").distinct()
    other = roots.select("drawing", "root", F.col("container").alias("other"), F.col("cy").alias("oy"))
    edges = roots.join(other, ["drawing", "root"]).where((F.col("container") < F.col("other")) & (F.abs(F.col("cy") - F.col("oy")) <= band * h))
    vertices = containers.select("drawing", "container").withColumn("node", F.struct("drawing", "container"))
    found = connected_components(
        vertices, edges.select(F.struct("drawing", "container").alias("a"), F.struct("drawing", F.col("other").alias("container")).alias("b"))
    )
    return found.select("drawing", "container", F.col("component.container").alias("cluster"))
