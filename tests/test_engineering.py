import pytest

from meshwright.functions import geometry as g
from meshwright.operators import conductors, groups
from meshwright.plans import containers

SEGMENTS = "drawing string, segment long, evidence string, x1 double, y1 double, x2 double, y2 double"
EQUIPMENT = "drawing string, equipment string, physical_type string, x0 double, y0 double, x1 double, y1 double"
TEXTS = "drawing string, seq long, evidence string, text string, x double, y double, height double, layer string"
SHAPES = "drawing string, seq long, kind string, closed boolean, x0 double, y0 double, x1 double, y1 double"


def test_engineering_level(spark):
    # a cabinet by its frame at the left, one by its bus at the right, a route between them, a transformer below the right bus
    wires = [(100, 1000, 1900, 1000), (6000, 1000, 7800, 1000), (8000, 1000, 9700, 1000), (1900, 1000, 1900, 1200), (1900, 1200, 6000, 1200), (6000, 1200, 6000, 1000), (7000, 1000, 7000, -1500)]
    segments = spark.createDataFrame([("d", i, f"h{i}", *map(float, w)) for i, w in enumerate(wires)], SEGMENTS)
    shapes = spark.createDataFrame([("d", 50, "polygon", True, 0.0, 0.0, 2000.0, 2000.0), ("d", 51, "polygon", True, 0.0, 0.0, 100.0, 100.0)], SHAPES)
    texts = spark.createDataFrame([("d", 1, "t1", "1号公用柜", 1000.0, 2200.0, 100.0, "W"), ("d", 2, "t2", "DTU柜", 7000.0, 2000.0, 100.0, "W"), ("d", 3, "t3", "接至3号柜", 7000.0, 2000.0, 100.0, "W")], TEXTS)
    equipment = spark.createDataFrame([("d", "EQ1", "SwitchCombination", 900.0, 900.0, 1100.0, 1100.0), ("d", "EQ2", "PowerTransformer", 6900.0, -2000.0, 7100.0, -1600.0)], EQUIPMENT)
    roots = conductors.conductor_components(segments, conductors.pair_events(segments))
    found, held, members = containers.detect(texts, shapes, segments, roots, equipment)
    cabinets = {r.container: (r.family, r.basis) for r in found.collect()}
    assert sorted(cabinets.values()) == [("DTUCabinet", "label_associated_horizontal_bus"), ("PublicCabinet", "closed_cabinet_frame")]
    framed = next(k for k, v in cabinets.items() if v[0] == "PublicCabinet")
    other = next(k for k in cabinets if k != framed)
    assert {(r.container, r.segment) for r in held.collect()} == {(framed, 0), (other, 1), (other, 2)}
    assert [(r.container, r.equipment) for r in members.collect()] == [(framed, "EQ1")]
    relations = containers.feeds(found, held, equipment, segments)
    assert [(r.container, r.transformer, r.confidence) for r in relations.collect()] == [(other, "EQ2", "high")]
    nodes = containers.engineering_nodes(found, held, relations, segments, roots).collect()
    assert [(r.node, r.members, r.state) for r in nodes] == [("EN00001", sorted([framed, other, "EQ2"]), "automatic_inter_cabinet_route")]


def test_growing_a_group(spark):
    rows = [(1, "circle", True, 0, 0, 100, 100), (2, "line", False, 50, 110, 50, 200), (3, "line", False, 50, 230, 50, 900), (4, "circle", True, 900, 900, 990, 990), (5, "line", False, 120, 0, 120, 60)]
    shapes = spark.createDataFrame([("d", i, k, c, float(max(x1 - x0, y1 - y0)), i == 5, *map(float, (x0, y0, x1, y1))) for i, k, c, x0, y0, x1, y1 in rows], "drawing string, shape long, kind string, closed boolean, length double, annotation boolean, x0 double, y0 double, x1 double, y1 double")
    start = spark.createDataFrame([("d", 1, 1)], "drawing string, group long, shape long")
    assert sorted(r.shape for r in groups.expand_groups(start, shapes).collect()) == [1, 2]


def test_stubs(spark):
    pt = lambda x, y: (float(x), float(y))
    kind = "struct<x:double,y:double>"
    circles = spark.createDataFrame([(1, 1, pt(0, 0), 50.0), (1, 2, pt(0, 50), 50.0), (1, 3, pt(0, 400), 50.0), (1, 4, pt(0, 60), 20.0)], f"group int, shape int, center {kind}, radius double")
    pairs = groups.circle_pairs(circles)
    assert [(r.left, r.right) for r in pairs.collect()] == [(1, 2)]
    lines = spark.createDataFrame([(1, 7, pt(0, 300), pt(0, 105)), (1, 8, pt(300, 300), pt(400, 400))], f"group int, line int, a {kind}, b {kind}")
    stubs = {r.ratio: r.stub for r in groups.circle_stubs(pairs, lines).collect()}
    assert len(stubs) == 5 and (stubs[1.0].a.y, stubs[1.0].b.y) == (105.0, 155.0)
    square = spark.createDataFrame([(1, 9, [pt(-50, 0), pt(50, 0), pt(0, 100)], 100.0)], f"group int, shape int, points array<{kind}>, scale double")
    assert {r.line for r in groups.polygon_stubs(square, lines).collect()} == {7}


def test_labels_are_used_once(spark):
    things = spark.createDataFrame([("d", "A", 0.0, 0.0), ("d", "B", 10.0, 0.0), ("e", "C", 0.0, 0.0)], "drawing string, thing string, x double, y double")
    labels = spark.createDataFrame([("d", 1, 8.0, 0.0), ("d", 2, 40.0, 0.0), ("d", 3, 500.0, 0.0)], "drawing string, label long, x double, y double")
    got = {r.thing: (r.label, r.distance) for r in groups.attach_labels(things, labels, 100.0).collect()}
    assert got == {"A": (1, 8.0), "B": (2, 30.0)}


def test_unit_angle():
    assert g.AXIS_TANGENT == pytest.approx(0.017455, abs=1e-6)
