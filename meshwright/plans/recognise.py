"""Recovering a drawing's network: from its entities to shapes, equipment, conductors, nodes and device edges.

Input are the rows of sources.dxf.read_drawings() and, if there is one, a template library. Every step is a table
keyed by drawing, so any number of drawings is one job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import geometry as g
from meshwright.operators import conductors, matching, text
from meshwright.operators.intervals import islands
from meshwright.operators.keys import first_wins, histogram_text, numbered, quantised, top_k_per
from meshwright.operators.lineage import cut
from meshwright.operators.spatial import box_join

#: The type of equipment that each template family stands for.
TYPE_BY_FAMILY = {
    "PowerTransformer": "PowerTransformer", "PT": "VoltageTransformer", "CT": "CurrentTransformer", "ConnectivePoint": "CableTermination",
    "Breaker": "SwitchCombination", "Disconnector": "SwitchCombination", "LoadSwitch": "SwitchCombination", "GroundDisconnector": "SwitchCombination",
    "Fuse": "SwitchCombination", "Arrester": "Arrester", "AutomationTerminal": "AutomationTerminal", "FaultIndicator": "FaultIndicator",
    "HVMotor": "HVMotor", "Capacitor": "Capacitor", "ChargeIndicator": "ChargeIndicator", "Reactor": "Reactor", "VolRegulator": "VoltageRegulator",
}
#: Confidence of an equipment type by where its name was found.
SOURCES = [("attributes", "ATTRIB", 0.99), ("defaults", "ATTDEF", 0.97), ("block", "block_name", 0.94)]


def texts_of(rows: DataFrame) -> DataFrame:
    """(drawing, seq, evidence, text, x, y, height, layer): distinct visible texts."""
    p = F.get("points", F.lit(0))
    own = rows.where("record = 'entity' and text <> ''").select("drawing", "seq", "evidence", "text", p["x"].alias("x"), p["y"].alias("y"), "height", "layer")
    return text.dedupe_texts(own, ["drawing"], ["seq"])


def scale_units(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(drawing, h): 100, unless eight texts or more have a median height below 25, which then is it."""
    own = texts.where("height > 0").groupBy("drawing").agg(F.count("*").alias("n"), F.median("height").alias("m"))
    h = F.when((F.col("n") >= 8) & (F.col("m") < 0.25 * g.CANONICAL_H), F.greatest("m", F.lit(1e-6))).otherwise(g.CANONICAL_H)
    return rows.select("drawing").distinct().join(own, "drawing", "left").select("drawing", h.alias("h"))


def in_canonical_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """`rows` with all lengths in hundredths of their drawing's unit H, so that every drawing has H = 100.

    units: (drawing, h), a row a drawing.
    """
    factor = F.lit(g.CANONICAL_H) / F.col("h")
    scaled = lambda p: F.when(p.isNotNull(), g.point(p["x"] * factor, p["y"] * factor))
    changed = {"points": F.transform("points", scaled), "center": scaled(F.col("center")), "radius": F.col("radius") * factor, "height": F.col("height") * factor}
    return rows.join(units, "drawing").withColumns(changed).select(*rows.columns)


def exclusion_counts(rows: DataFrame) -> DataFrame:
    """(drawing, reason, layer, entities, inserts): what visibility left out, by reason and layer."""
    own = rows.where("record = 'excluded'")
    return own.groupBy("drawing", "reason", "layer").agg(F.count("*").alias("entities"), F.sum((F.col("kind") == "INSERT").cast("long")).alias("inserts"))


def provenance(things: DataFrame, rows: DataFrame) -> DataFrame:
    """(drawing, thing, provenance): where each handle of a thing comes from, in the order of its handles.

    things: (drawing, thing, handles: array). A handle that no entity has is left out.
    """
    own = things.select("drawing", "thing", F.posexplode("handles").alias("place", "evidence"))
    names = F.transform("insert_path", lambda p: F.substring_index(p, ":", -1))
    known = rows.where("record = 'entity'").select("drawing", "evidence", "source_handle", "insert_path", names.alias("block_names"), F.col("kind").alias("entity_type"), "layer", "virtual")
    met = own.join(known, ["drawing", "evidence"])
    item = F.struct("place", "evidence", "source_handle", "insert_path", "block_names", "entity_type", "layer", "virtual")
    listed = met.groupBy("drawing", "thing").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    found = things.select("drawing", "thing").distinct().join(listed, ["drawing", "thing"], "left")
    dropped = F.transform(F.coalesce("_p", F.array().cast(listed.schema["_p"].dataType)), lambda x: x.dropFields("place"))
    return found.select("drawing", "thing", dropped.alias("provenance"))


def shapes_of(rows: DataFrame) -> DataFrame:
    """(drawing, seq, evidence, entity, layer, kind, points, closed, length, x0, y0, x1, y1): what has a plane shape.

    Boxes and lengths are those of the raw vertices; points are sampled for matching.
    """
    ring = F.when(F.col("closed") & (F.size("points") > 1), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    steps = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), g.distance)
    circle = F.col("kind") == "CIRCLE"
    span = F.when(circle, 2 * math.pi * F.col("radius")).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, v: a + v))
    kind = F.when(F.col("kind") == "LINE", "line").when(circle, "circle").when(F.col("closed"), "polygon").otherwise("polyline")
    sampled = (
        F.when(circle, g.sample_circle(F.col("center"), F.col("radius")))
        .when(F.col("kind") == "LINE", g.sample_line(F.get("points", F.lit(0)), F.get("points", F.lit(1))))
        .otherwise(g.sample_polyline(F.col("points"), F.col("closed")))
    )
    low = lambda a: F.when(circle, F.col(f"center.{a}") - F.col("radius")).otherwise(F.array_min(F.transform("points", lambda p: p[a])))
    high = lambda a: F.when(circle, F.col(f"center.{a}") + F.col("radius")).otherwise(F.array_max(F.transform("points", lambda p: p[a])))
    own = rows.where("record = 'entity' and text is null").where(circle | (F.size("points") >= 2))
    own = own.withColumn("length", span).where(F.col("length") > 1e-9)
    return own.select(
        "drawing", "seq", "evidence", F.col("kind").alias("entity"), "layer", kind.alias("kind"), "insert_path", F.col("points").alias("vertices"), sampled.alias("points"), "closed", "length",
        low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"),
    )


def dedupe_shapes(shapes: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """The first of shapes of one kind with the same rounded box and length."""
    q = max(h * 0.005, 1e-8)
    keys = {f"_{n}": quantised(F.col(n), q) for n in ("x0", "y0", "x1", "y1", "length")}
    return first_wins(shapes.withColumns(keys), ["drawing", "kind", *keys], ["seq"]).drop(*keys)


def device_seed(h: float = g.CANONICAL_H) -> Column:
    """Whether a shape can anchor a symbol: closed, curved or oblique, and small. Strokes along an axis can't."""
    w, t = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat, upright = g.along_axis(w, t)
    small = F.greatest(w, t) <= 8 * h
    closed = F.col("kind").isin("circle", "polygon", "arc") | F.col("closed")
    oblique = ~(flat | upright) & F.col("length").between(0.05 * h, 8 * h)
    return ~text.annotation_layer(F.col("layer")) & F.when(closed, small).otherwise(oblique)


def insert_members(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """(drawing, insert_seq, evidence): each INSERT's shapes, at any depth, by an equi-join on path prefixes."""
    name = lambda p: F.array_join(p, "\0")
    inserts = rows.where("record = 'insert'").select("drawing", F.col("seq").alias("insert_seq"), name("insert_path").alias("path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("insert_path")), lambda n: name(F.slice("insert_path", 1, n)))
    inside = shapes.where(F.size("insert_path") > 0).select("drawing", "evidence", F.explode(prefixes).alias("path"))
    return inside.join(inserts, ["drawing", "path"]).select("drawing", "insert_seq", "evidence")


def block_equipment(rows: DataFrame, shapes: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(drawing, equipment, physical_type, family, terminal_count, confidence, source, handles, box): equipment that
    block attributes, their defaults or block names speak of.

    Instances of a type that lie on one another within 0.02 H count once, as the most confident and largest one.
    """
    texts = {"attributes": F.coalesce("attributes", F.array().cast("array<string>")), "defaults": F.coalesce("defaults", F.array().cast("array<string>")), "block": F.array("block")}
    meaning = text.prioritised([(texts[c], name, v) for c, name, v in SOURCES], rules)
    named = rows.where("record = 'insert'").withColumn("m", meaning).where("m is not null").select("drawing", F.col("seq").alias("insert_seq"), "m.*")
    own = insert_members(rows, shapes).join(shapes.select("drawing", "evidence", "x0", "y0", "x1", "y1"), ["drawing", "evidence"])
    boxes = own.groupBy("drawing", "insert_seq").agg(
        F.array_sort(F.collect_set("evidence")).alias("handles"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    found = named.join(boxes, ["drawing", "insert_seq"])
    order = [F.col("confidence").desc(), F.size("handles").desc(), F.col("insert_seq")]
    rank = F.row_number().over(Window.partitionBy("drawing", "physical_type").orderBy(*order))
    found = cut(found.withColumns({"rank": rank, "item": F.struct("drawing", "insert_seq")}))
    spots = found.select("drawing", "physical_type", "item", "rank", ((F.col("x0") + F.col("x1")) / 2).alias("x0"), ((F.col("y0") + F.col("y1")) / 2).alias("y0"))
    spots = spots.withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    near = box_join(spots, spots, ["drawing", "physical_type"], 0.02 * g.CANONICAL_H, 10 * g.CANONICAL_H, gap="euclid").where("l_item <> r_item")
    from meshwright.operators.graph import leader_clusters

    led = leader_clusters(found, near.select(F.col("l_item").alias("item"), F.col("r_item").alias("other"), F.col("r_rank").alias("other_rank")), "item")
    handles = led.join(found.select("item", F.col("handles").alias("own")), "item").groupBy("leader").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("handles"))
    kept = found.drop("handles").join(handles, found["item"] == handles["leader"]).drop("leader", "item", "rank")
    middle = [(F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("insert_seq")]
    return numbered(kept, ["drawing"], middle, "equipment", "EQ").withColumnRenamed("terminals", "terminal_count")


def geometry_equipment(groups: DataFrame, scores: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates that their best template, margin and size accept: facts has (candidate, owned, closed, circles, span)."""
    best = top_k_per(scores.drop("rank"), ["candidate"], [F.col("combined_score").desc(), F.col("template")], 1).drop("rank")
    own = best.join(matching.family_margin(scores).select("candidate", "margin"), "candidate").join(facts, "candidate").join(groups, "candidate")
    scope = F.col("family").isin(*TYPE_BY_FAMILY)
    accepted, reason = matching.acceptance(F.col("family"), F.col("combined_score"), F.col("margin"), F.col("owned"), F.col("closed"), F.col("circles"), F.col("span"), scope)
    return own.withColumns({"accepted": accepted, "reason": reason})


def complete_transformers(equipment: DataFrame, shapes: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, equipment, handles, x0, y0, x1, y1): each transformer with the details of its motif.

    Its two largest circles set a zone; closed details and short stems in the middle with their centre in it belong to it.
    """
    own = equipment.where("physical_type = 'PowerTransformer'").select("drawing", "equipment", F.explode("handles").alias("evidence"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    sized = shapes.withColumn("span", span)
    circles = own.join(sized.where("kind = 'circle'"), ["drawing", "evidence"])
    main = top_k_per(circles, ["drawing", "equipment"], [F.col("span").desc(), F.col("seq")], 2)
    zone = main.groupBy("drawing", "equipment").agg(
        F.count("*").alias("n"), F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"), F.greatest(F.median("span"), F.lit(h)).alias("w"),
        F.collect_list("evidence").alias("main"),
    )
    zone = zone.where("n = 2").withColumn("mid", (F.col("a") + F.col("c")) / 2)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("mid") - F.col("w") * 1.05, F.col("mid") + F.col("w") * 1.05) & cy.between(F.col("b") - F.col("w") * 2.3, F.col("d") + F.col("w") * 0.15)
    detail = (F.col("kind").isin("circle", "polygon", "arc") | F.col("closed")) & (F.col("span") <= F.col("w") * 1.2)
    stem = F.col("kind").isin("line", "polyline") & (F.col("span") <= F.col("w") * 3) & (F.abs(cx - F.col("mid")) <= F.col("w") * 0.25)
    near = sized.where(~text.annotation_layer(F.col("layer"))).join(zone, "drawing")
    claimed = near.where((inside & (detail | stem)) | F.array_contains("main", F.col("evidence")))
    return claimed.groupBy("drawing", "equipment").agg(
        F.array_sort(F.collect_set("evidence")).alias("handles"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def wires_of(shapes: DataFrame, consumed: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, segment, evidence, x1, y1, x2, y2): open lines that no equipment owns, edge by edge, long enough and distinct."""
    kinds = F.col("entity").isin("LINE", "LWPOLYLINE", "POLYLINE") & F.col("kind").isin("line", "polyline") & ~F.col("closed")
    free = shapes.where(kinds & ~text.annotation_layer(F.col("layer"))).join(consumed.select("drawing", "evidence"), ["drawing", "evidence"], "left_anti")
    n = F.size("vertices") - 1
    edges = F.zip_with(F.slice("vertices", 1, n), F.slice("vertices", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cuts = free.select("drawing", "seq", "evidence", F.posexplode(edges).alias("k", "e"))
    flat = cuts.select(
        "drawing", (F.col("seq") * (1 << 31) + F.col("k")).alias("segment"), "evidence", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")
    )
    return conductors.dedupe_segments(flat, h)


def vertical_coverage(paths: DataFrame, segments: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, path, coverage): how much of a vertical path (x, low, high) upright segments near it cover.

    Gaps up to a quarter H between segments count as covered.
    """
    upright = conductors.with_properties(segments).where("vertical").select("drawing", ((F.col("x1") + F.col("x2")) / 2).alias("sx"), "y0", "by1")
    met = paths.join(upright, "drawing").where(F.abs(F.col("sx") - F.col("x")) <= 0.75 * h)
    clipped = met.withColumns({"s": F.greatest("low", "y0"), "e": F.least("high", "by1")}).where("e > s")
    spans = islands(clipped, ["drawing", "path"], "s", "e", 0.25 * h).groupBy("drawing", "path", "island", "low", "high").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    share = spans.groupBy("drawing", "path").agg(F.least(F.lit(1.0), F.sum(F.col("e") - F.col("s")) / F.first(F.col("high") - F.col("low"))).alias("coverage"))
    return paths.where("high > low").select("drawing", "path").join(share, ["drawing", "path"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


@dataclass
class Network:
    """What is recognised in all drawings, as lazy tables."""

    equipment: DataFrame
    segments: DataFrame
    events: DataFrame
    terminals: DataFrame
    nodes: DataFrame
    edges: DataFrame


def recognise(rows: DataFrame, rules: list[tuple] | None = None, h: float | None = None, library: DataFrame | None = None) -> Network:
    """The detailed network of drawings, from what their blocks, free shapes and wires say.

    h: the unit of all drawings; without it each drawing's own, from its texts, is made 100. library: templates of
    plans.templates.prepared(); without it free shapes are no equipment.
    """
    if h is None:
        rows, h = cut(in_canonical_units(rows, scale_units(rows, texts_of(rows)))), g.CANONICAL_H
    shapes = cut(dedupe_shapes(shapes_of(rows), h))
    equipment = cut(block_equipment(rows, shapes, rules))
    if library is not None:
        from meshwright.plans.free_geometry import free_equipment, with_free

        equipment = cut(with_free(equipment, free_equipment(shapes, equipment, library, h)))
    moved = complete_transformers(equipment, shapes, h).select("drawing", "equipment", *(F.col(c).alias(f"_{c}") for c in ("handles", "x0", "y0", "x1", "y1")))
    better = {c: F.coalesce(f"_{c}", c) for c in ("handles", "x0", "y0", "x1", "y1")}
    equipment = cut(equipment.join(moved, ["drawing", "equipment"], "left").withColumns(better).drop(*(f"_{c}" for c in better)))
    owned = equipment.select("drawing", F.explode("handles").alias("evidence"))
    segments = cut(wires_of(shapes, owned, h))
    dots = shapes.where((F.col("kind") == "circle") & (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2 <= g.DOT_RADIUS_H * h))
    dots = dots.select("drawing", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    met = cut(conductors.pair_events(segments, h, markers=dots))
    components = cut(conductors.conductor_components(segments, met))
    terminals = cut(conductors.attach_terminals(equipment.select("drawing", "equipment", "x0", "y0", "x1", "y1", "terminal_count"), segments, h))
    nodes = cut(conductors.connectivity(terminals, components, segments))
    events = conductors.merge_events(conductors.active_events(conductors.distinct_events(met, h), nodes), h)
    return Network(equipment, segments, events, terminals.where("confidence <> 'too_far'"), nodes, conductors.device_edges(nodes))


def documents(network: Network) -> DataFrame:
    """(drawing, document): one JSON document a drawing."""
    parts = {
        "equipment": network.equipment, "terminals": network.terminals, "connectivity_nodes": network.nodes, "crossings": network.events, "device_edges": network.edges,
    }
    out = None
    for name, table in parts.items():
        own = table.groupBy("drawing").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*(c for c in table.columns if c != "drawing"))))).alias(name))
        out = own if out is None else out.join(own, "drawing", "full")
    body = [F.concat(F.lit(f'"{n}":['), F.coalesce(F.array_join(n, ","), F.lit("")), F.lit("]")) for n in parts]
    return out.select("drawing", F.concat(F.lit('{"truth_used_during_recognition":false,'), F.concat_ws(",", *body), F.lit("}")).alias("document"))


def statistics(rows: DataFrame, network: Network) -> DataFrame:
    """One row a drawing with its counters: what was read, what was left out and what was recognised."""
    kind = lambda c: F.sum(c.cast("long"))
    entity, insert, excluded = (F.col("record") == r for r in ("entity", "insert", "excluded"))
    out = rows.groupBy("drawing").agg(
        kind(entity).alias("expanded_entity_count"),
        kind(entity & F.coalesce("virtual", F.lit(False))).alias("virtual_entity_count"),
        kind(insert).alias("expanded_insert_count"),
        kind(excluded).alias("excluded_source_entity_count"),
        kind(excluded & (F.col("kind") == "INSERT")).alias("excluded_insert_count"),
    )
    reasons = exclusion_counts(rows)
    for column, name in (("reason", "excluded_reason_counts"), ("layer", "excluded_layer_counts")):
        by = reasons.groupBy("drawing", column).agg(F.sum("entities").alias("n"))
        out = out.join(by.groupBy("drawing").agg(histogram_text(column, "n").alias(name)), "drawing", "left")
    for table, name in ((network.equipment, "accepted_equipment_count"), (network.segments, "conductor_candidate_count"), (network.terminals, "terminal_count"), (network.nodes, "connectivity_node_count"), (network.edges, "derived_device_edge_count"), (network.events, "active_crossing_count")):
        out = out.join(table.groupBy("drawing").agg(F.count("*").alias(name)), "drawing", "left")
    own = network.equipment.groupBy("drawing", "source").agg(F.count("*").alias("n"))
    out = out.join(own.groupBy("drawing").agg(histogram_text("source", "n").alias("equipment_source_counts")), "drawing", "left")
    types = network.equipment.groupBy("drawing", "physical_type").agg(F.count("*").alias("n"))
    out = out.join(types.groupBy("drawing").agg(histogram_text("physical_type", "n").alias("equipment_type_counts")), "drawing", "left")
    texts = [c for c in out.columns if c.endswith("_counts")]
    return out.fillna("", texts).fillna(0)


def totals(stats: DataFrame) -> DataFrame:
    """One row: the drawings and the sum of every counter of statistics()."""
    counters = [c for c in stats.columns if c.endswith("_count")]
    return stats.agg(F.count("*").alias("drawings"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))


#: The share of a drawing's extent that is left free around it.
MARGIN = 0.08


def render_list(segments: DataFrame, boxes: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(drawing, layer, item, x0, y0, x1, y1): what an overlay draws, and as layer `frame` its extent with a margin.

    segments: (drawing, segment, x1, y1, x2, y2); boxes: (drawing, equipment, x0, y0, x1, y1); relations: (drawing,
    source, target), drawn between the middles of two boxes.
    """
    ends = lambda df, layer, item, a, b, c, d: df.select("drawing", F.lit(layer).alias("layer"), F.col(item).cast("string").alias("item"), *(F.col(x).cast("double").alias(y) for x, y in zip((a, b, c, d), ("x0", "y0", "x1", "y1"), strict=True)))
    out = ends(segments, "segment", "segment", "x1", "y1", "x2", "y2").unionByName(ends(boxes, "box", "equipment", "x0", "y0", "x1", "y1"))
    if relations is not None:
        middle = boxes.select("drawing", "equipment", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
        a = middle.select("drawing", F.col("equipment").alias("source"), F.col("mx").alias("ax"), F.col("my").alias("ay"))
        b = middle.select("drawing", F.col("equipment").alias("target"), F.col("mx").alias("bx"), F.col("my").alias("by"))
        lines = relations.join(a, ["drawing", "source"]).join(b, ["drawing", "target"]).withColumn("item", F.concat_ws("-", "source", "target"))
        out = out.unionByName(ends(lines, "relation", "item", "ax", "ay", "bx", "by"))
    low = lambda c: F.min(F.least(f"{c}0", f"{c}1"))
    high = lambda c: F.max(F.greatest(f"{c}0", f"{c}1"))
    frame = out.groupBy("drawing").agg(low("x").alias("a"), low("y").alias("b"), high("x").alias("c"), high("y").alias("d"))
    wide, tall = (F.col("c") - F.col("a")) * MARGIN, (F.col("d") - F.col("b")) * MARGIN
    framed = frame.select("drawing", F.lit("frame").alias("layer"), F.lit("").alias("item"), (F.col("a") - wide).alias("x0"), (F.col("b") - tall).alias("y0"), (F.col("c") + wide).alias("x1"), (F.col("d") + tall).alias("y1"))
    return out.unionByName(framed)
