"""The engineering level of a drawing: cabinets, what they hold, what they feed, and the nodes between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geometry as g
from meshwright.operators import conductors, text
from meshwright.operators.keys import numbered
from meshwright.operators.lineage import cut
from meshwright.operators.spatial import points_in_boxes
from meshwright.plans.recognise import vertical_coverage


def frames_of(shapes: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, frame, x0, y0, x1, y1): closed shapes of a cabinet's size and proportions."""
    w, t = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = w.between(12 * h, 80 * h) & t.between(12 * h, 80 * h) & (w / F.greatest(t, F.lit(1e-9))).between(0.35, 3.0)
    return shapes.where((F.col("closed") | (F.col("kind") == "polygon")) & sized).select("drawing", F.col("seq").alias("frame"), "x0", "y0", "x1", "y1")


def buses_of(segments: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, segment, y, x0, x1): long horizontal segments."""
    own = conductors.with_properties(segments).where(F.col("horizontal") & (F.col("length") >= 15 * h))
    return own.select("drawing", "segment", ((F.col("y1") + F.col("y2")) / 2).alias("y"), "x0", F.col("bx1").alias("x1"))


def detect(texts: DataFrame, shapes: DataFrame, segments: DataFrame, components: DataFrame, equipment: DataFrame, h: float = g.CANONICAL_H) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cabinets (drawing, container, family, name, box, basis), their buses and their members.

    A label takes the nearest frame in its window if no label before it has; else the nearest bus below it and
    the buses that continue that one. Labels without either are none. Members have their centre in the box and are no transformers.
    """
    family = text.cabinet_family(F.col("text"))
    labels = cut(texts.withColumn("family", family).where("family is not null").select("drawing", F.col("seq").alias("label"), "text", "x", "y", "height", "family"))
    buses = cut(buses_of(segments, h))
    framed = text.labels_to_frames(labels, frames_of(shapes, h), ["drawing"], h).join(frames_of(shapes, h), ["drawing", "frame"])
    framed = framed.join(labels.select("drawing", "label", F.col("text").alias("name"), "family"), ["drawing", "label"])
    by_frame = framed.select("drawing", "label", "name", "family", "x0", "y0", "x1", "y1", F.lit("closed_cabinet_frame").alias("basis"))
    grown = by_frame.withColumns({"x0": F.col("x0") - h, "y0": F.col("y0") - h, "x1": F.col("x1") + h, "y1": F.col("y1") + h})
    middles = buses.select("drawing", "segment", ((F.col("x0") + F.col("x1")) / 2).alias("x"), "y")
    in_frame = points_in_boxes(middles, grown.select("drawing", "label", "x0", "y0", "x1", "y1"), ["drawing"], 20 * h)
    bus_rows = in_frame.select("drawing", F.col("r_label").alias("label"), F.col("l_segment").alias("segment"))

    loose = labels.join(framed.select("drawing", "label"), ["drawing", "label"], "left_anti")
    primary = cut(text.labels_to_buses(loose, buses, ["drawing"], h))
    run = conductors.bus_growth(buses, primary, 0.2 * h, 40 * h).join(buses, ["drawing", "segment"])
    hull = run.groupBy("drawing", "label").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    level = primary.join(buses.select("drawing", "segment", F.col("y").alias("level")), ["drawing", "segment"]).select("drawing", "label", "level")
    own = hull.join(level, ["drawing", "label"]).join(loose, ["drawing", "label"])
    by_bus = own.select(
        "drawing", "label", F.col("text").alias("name"), "family", (F.col("a") - 2 * h).alias("x0"), (F.col("level") - 18 * h).alias("y0"), (F.col("b") + 2 * h).alias("x1"),
        F.greatest(F.col("y") + F.greatest(F.coalesce("height", F.lit(0.0)), F.lit(h)), F.col("level") + 4 * h).alias("y1"), F.lit("label_associated_horizontal_bus").alias("basis"),
    )
    both = by_frame.unionByName(by_bus)
    order = [(F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2, F.col("label")]
    containers = cut(numbered(both, ["drawing"], order, "container", "CAB"))
    held = bus_rows.unionByName(run.select("drawing", "label", "segment")).join(containers.select("drawing", "label", "container"), ["drawing", "label"])
    held = held.join(components, ["drawing", "segment"]).select("drawing", "container", "segment", "root")
    centres = equipment.where("physical_type <> 'PowerTransformer'").select("drawing", "equipment", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    members = points_in_boxes(centres, containers.select("drawing", "container", "x0", "y0", "x1", "y1"), ["drawing"], 20 * h)
    return containers, cut(held), members.select("drawing", F.col("r_container").alias("container"), F.col("l_equipment").alias("equipment"))


def feeds(containers: DataFrame, held: DataFrame, equipment: DataFrame, segments: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, container, transformer, root, coverage, confidence): the cabinet bus above each transformer, and how
    much of the way down to it is drawn."""
    own = equipment.where("physical_type = 'PowerTransformer'").select("drawing", F.col("equipment").alias("transformer"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("top"))
    buses = buses_of(segments, 0.0).join(held, ["drawing", "segment"])
    best = text.transformers_to_buses(own, buses.select("drawing", "container", "segment", "y", "x0", "x1"), ["drawing"], h)
    placed = best.join(own, ["drawing", "transformer"]).join(buses.select("drawing", "container", "segment", "y", "root"), ["drawing", "container", "segment"])
    paths = placed.select("drawing", F.col("transformer").alias("path"), "x", F.col("top").alias("low"), F.col("y").alias("high"))
    share = vertical_coverage(paths, segments, h).withColumnRenamed("path", "transformer")
    out = placed.join(share, ["drawing", "transformer"], "left").withColumn("coverage", F.round(F.coalesce("coverage", F.lit(0.0)), 3))
    return out.select("drawing", "container", "transformer", "root", "coverage", F.when(F.col("coverage") >= 0.55, "high").otherwise("medium").alias("confidence"))


def engineering_nodes(containers: DataFrame, held: DataFrame, relations: DataFrame, segments: DataFrame, components: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, node, members, state): cabinets that share a route are one node with all they feed; a cabinet alone
    has a node for each of its buses, or one of its own."""
    clusters = cut(conductors.container_clusters(containers.select("drawing", "container", "x0", "y0", "x1", "y1"), segments, components, h))
    sizes = clusters.groupBy("drawing", "cluster").agg(F.count("*").alias("n"))
    own = clusters.join(sizes, ["drawing", "cluster"])
    fed = relations.select("drawing", "container", "root", "transformer")
    joint = own.where("n > 1").select("drawing", "cluster", "container")
    parts = joint.select("drawing", "cluster", F.col("container").alias("member")).unionByName(joint.join(fed, ["drawing", "container"]).select("drawing", "cluster", F.col("transformer").alias("member")))
    routes = parts.groupBy("drawing", F.col("cluster").alias("key")).agg(F.array_sort(F.collect_set("member")).alias("members")).withColumn("state", F.lit("automatic_inter_cabinet_route"))
    single = own.where("n = 1").select("drawing", "container")
    roots = held.select("drawing", "container", "root").unionByName(fed.select("drawing", "container", "root")).distinct()
    by_root = single.join(roots, ["drawing", "container"]).join(fed, ["drawing", "container", "root"], "left").groupBy("drawing", "container", "root").agg(F.collect_set("transformer").alias("t"))
    sections = by_root.select("drawing", F.concat_ws("/", "container", F.col("root").cast("string")).alias("key"), F.array_sort(F.array_union(F.array("container"), "t")).alias("members"), F.lit("automatic_engineering_bus_section").alias("state"))
    alone = single.join(roots, ["drawing", "container"], "left_anti").select("drawing", F.col("container").alias("key"), F.array("container").alias("members"), F.lit("automatic_isolated_cabinet").alias("state"))
    return numbered(routes.unionByName(sections).unionByName(alone), ["drawing"], [F.col("key")], "node", "EN").drop("key")
